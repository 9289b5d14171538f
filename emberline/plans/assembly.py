"""Queries that choose training patches, put their cells together from many sources, and build spectral windows."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import functions as F

from ..operators.grid import persist_table
from ..operators.learning import spread
from ..operators.patches import CHANNELS, ELEVATION, NDVI, OPTICAL, RAIN, SLOPE, TEMPERATURE, assemble_patches, select_patches, spectral_windows
from .registry import query, r6, read
from .stacks import STACK, stack

#: Patches of 16 cells, every 8; enough burned cells for about half of them.
TILE, STRIDE, LEAST = 16, 8, 14

_LABEL = "CASE WHEN cloud_after < 1 THEN greatest(0, round(nbr_before - nbr_after - 0.6e0, 6)) END"
_PATCHES = f"""{STACK}, lab AS (SELECT w, row, col, {_LABEL} AS dnbr FROM stack), b AS (SELECT w, row // {STRIDE} AS br, col // {STRIDE} AS bc, count(dnbr) AS v, count(*) FILTER (dnbr > 0) AS f FROM lab GROUP BY ALL),
p AS (SELECT w, br - i AS patch_row, bc - j AS patch_col, sum(v)::BIGINT AS valid_cells, sum(f)::BIGINT AS fire_cells FROM b, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), side WHERE br - i BETWEEN 0 AND (s - {TILE}) // {STRIDE} AND bc - j BETWEEN 0 AND (s - {TILE}) // {STRIDE} GROUP BY ALL),
q AS (SELECT *, fire_cells >= {LEAST} AS is_fire FROM p WHERE fire_cells >= {LEAST} OR valid_cells > {TILE * TILE // 2}),
pa AS (SELECT * FROM q QUALIFY is_fire OR row_number() OVER (PARTITION BY w, is_fire ORDER BY md5(w || '-' || patch_row || '-' || patch_col)) <= greatest(1, floor(0.15e0 * count(*) OVER (PARTITION BY w, is_fire))))"""


def _chosen(spark, d, s):
    labels = s.select("w", "row", "col", F.expr(_LABEL).alias("dnbr"))
    n = isqrt(read(spark, d, "lineitem").count() // 8)
    return labels, select_patches(labels, "w", "dnbr", n, n, TILE, STRIDE, LEAST)


@query(f"WITH {_PATCHES} SELECT * FROM pa")
def i19_patch_selection(spark, d):
    """Every patch with enough burned cells, 15 in 100 of the other valid ones, by scene."""
    return _chosen(spark, d, stack(spark, d))[1].withColumns({c: F.col(c).cast("long") for c in ("patch_row", "patch_col")})


@query(f"""WITH {_PATCHES}, m AS (SELECT max(o_orderdate::DATE) AS last FROM orders), day AS (SELECT o_orderdate::DATE AS date, sum(o_orderkey % 350) AS t, count(*) AS n FROM orders GROUP BY 1),
sc AS (SELECT w, last - 400 + w::INT * 75 AS day FROM (SELECT unnest(range(4)) AS w), m), wx AS (SELECT w, sum(t) FILTER (date = day) / sum(n) FILTER (date = day) AS today, sum(t) / sum(n) AS week FROM sc LEFT JOIN day ON date BETWEEN day - 6 AND day GROUP BY w),
c AS (SELECT pa.w, patch_row, patch_col, is_fire, row, col, dnbr FROM pa JOIN lab ON lab.w = pa.w AND row // {STRIDE} BETWEEN patch_row AND patch_row + 1 AND col // {STRIDE} BETWEEN patch_col AND patch_col + 1),
ground AS (SELECT row, col, min(k) % 60 AS slope, min(k) % 9 AS cover FROM cells GROUP BY row, col), scar AS (SELECT c.w, c.row, c.col, max(o.w) AS last FROM (SELECT DISTINCT w, row, col FROM c) c JOIN stack o ON o.row = c.row AND o.col = c.col AND o.w < c.w AND o.nbr_before - o.nbr_after > 0.3 GROUP BY ALL)
SELECT c.w, patch_row, patch_col, any_value(CASE WHEN NOT is_fire THEN 'NEGATIVE' WHEN c.w % 2 = 0 THEN 'GOLD' ELSE 'BRONZE' END) AS tier, any_value(['train', 'train', 'val', 'test'][c.w + 1]) AS split, count(*) AS cells, count(dnbr) AS labelled, round(sum(dnbr), 6) AS dnbr,
 {", ".join(f"count(f{i}.nir_after) AS frame_{i}, round(sum(f{i}.nir_after), 5) AS nir_{i}, round(sum(f{i}.ndvi_after), 5) AS ndvi_{i}" for i in range(3))}, sum(slope)::BIGINT AS slope, count(*) FILTER (cover = 4) AS crops, round(avg(exp(-(c.w - last) * 75 / 180e0)), 5) AS burn_recency, round(any_value(today), 5) AS today, round(any_value(week), 5) AS week
FROM c JOIN wx ON wx.w = c.w JOIN ground USING (row, col) LEFT JOIN scar ON scar.w = c.w AND scar.row = c.row AND scar.col = c.col {" ".join(f"LEFT JOIN stack f{i} ON f{i}.row = c.row AND f{i}.col = c.col AND f{i}.w = c.w - {i}" for i in range(3))} GROUP BY c.w, patch_row, patch_col""")
def l18_patch_cells(spark, d):
    """Patches put together from frames, spectra, terrain, cover, burn age, the weather of day and week, labels and tiers; one row a patch for comparison."""
    s = persist_table(stack(spark, d).select("w", "row", "col", "k", "nir_after", "ndvi_after", "nbr_before", "nbr_after", "cloud_after"), "stack")
    labels, patches = _chosen(spark, d, s)
    orders = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 350).alias("t"))
    last = orders.agg(F.max("date").alias("last"))
    day = F.expr("date_add(last, cast(w * 75 - 400 as int))")
    scene = spark.range(4).withColumnRenamed("id", "w").join(F.broadcast(last)).withColumn("day", day)
    days = orders.groupBy("date").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    near = scene.withColumn("date", F.explode(F.expr("sequence(date_sub(day, 6), day)"))).join(days, "date", "left")
    here = F.col("date") == F.col("day")
    weather = near.groupBy("w").agg((F.sum(F.when(here, F.col("t"))) / F.sum(F.when(here, F.col("n")))).alias("today"), (F.sum("t") / F.sum("n")).alias("week"))
    back = [F.when(F.col("w") >= i, F.col("w") - i).alias(f"frame_{i}") for i in range(3)]
    scenes = weather.select("*", *back, F.when(F.col("w") % 2 == 0, "GOLD").otherwise("BRONZE").alias("event_tier"), F.element_at(F.array(*map(F.lit, ("train", "train", "val", "test"))), F.col("w").cast("int") + 1).alias("split"))
    rows = s.count()
    ground = spread(s, ["row", "col"], rows).groupBy("row", "col").agg((F.min("k") % 60).alias("slope"), (F.min("k") % 9).alias("cover"), F.array(*(F.max(F.when((F.col("w") == i) & (F.col("nbr_before") - F.col("nbr_after") > 0.3), F.col("w"))) for i in range(4))).alias("scars"))
    x = assemble_patches(patches, scenes, s, ground, labels, "w", [f"frame_{i}" for i in range(3)], ["nir_after", "ndvi_after"], TILE, STRIDE, rows)
    age = (F.col("w") - F.array_max(F.filter("scars", lambda v: v < F.col("w")))) * 75
    frame = lambda i, c: F.col("frames")[i][c]
    # a patch has one tier and one split: as keys they leave sums and counts, which need no sorted cells
    tier = F.when(F.col("is_fire"), F.col("event_tier")).otherwise("NEGATIVE").alias("tier")
    return x.groupBy("w", F.col("patch_row").cast("long").alias("patch_row"), F.col("patch_col").cast("long").alias("patch_col"), tier, "split").agg(
        F.count("*").alias("cells"), F.count("dnbr").alias("labelled"), r6(F.sum("dnbr"), "dnbr"),
        *(F.count(frame(i, "nir_after")).alias(f"frame_{i}") for i in range(3)), *(F.round(F.sum(frame(i, f"{c}_after")), 5).alias(f"{c}_{i}") for i in range(3) for c in ("nir", "ndvi")),
        F.sum("slope").alias("slope"), F.count_if(F.col("cover") == 4).alias("crops"), F.round(F.avg(F.exp(-age / 180.0)), 5).alias("burn_recency"), *(F.round(F.first(c), 5).alias(c) for c in ("today", "week")),
    )


_DN = dict(zip(OPTICAL, (37, 53, 59, 61, 67, 71)))
_SEEN = "SELECT l_suppkey AS place, l_shipdate::DATE AS day, min(l_orderkey * 7 + l_linenumber) AS k FROM lineitem GROUP BY ALL"
_AT = {OPTICAL[b]: f"{b} / 10000e0" for b in OPTICAL} | {
    NDVI: "(nir / 10000e0 - red / 10000e0) / (nir / 10000e0 + red / 10000e0 + 1e-8)", TEMPERATURE: "(temp + 273.15e0) / 35e0", RAIN: "rain / 1000e0 / 0.03e0", ELEVATION: "elevation / 2000e0", SLOPE: "slope / 50e0"}


@query(f"""WITH s AS ({_SEEN}), o AS (SELECT place, day, {", ".join(f"k * {m} % 5003 + 1 AS {b}" for b, m in _DN.items())}, CASE WHEN k % 7 <> 0 THEN k % 350 / 10e0 END AS temp, CASE WHEN k % 7 <> 0 THEN k % 90 / 10e0 END AS rain FROM s),
t AS (SELECT s_suppkey AS place, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 900 + 100 ELSE 500 END AS elevation, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 40 ELSE 5 END AS slope FROM supplier),
a AS (SELECT place, day, i AS frame, day - [0, 16, 32][i + 1] AS want FROM o, (SELECT unnest([0, 1, 2]) AS i)),
b AS (SELECT a.place, a.day, frame, o.day AS seen FROM a JOIN o ON o.place = a.place AND o.day BETWEEN want - 12 AND want + 12 QUALIFY row_number() OVER (PARTITION BY a.place, a.day, frame ORDER BY abs(o.day - want), o.day) = 1),
f AS (SELECT a.place, a.day, a.frame, elevation, slope, o.* EXCLUDE (place, day) FROM a JOIN t USING (place) LEFT JOIN b ON b.place = a.place AND b.day = a.day AND b.frame = a.frame LEFT JOIN o ON o.place = b.place AND o.day = b.seen)
SELECT place, day, (month(day) - 1)::INT AS month, frame, {", ".join(f"round(coalesce(({v})::DOUBLE, 0), 6) AS x{i}" for i, v in sorted(_AT.items()))}, {" + ".join(f"(({v}) IS NULL)::BIGINT" for v in _AT.values())} + {CHANNELS - len(_AT)} AS masked FROM f""")
def j15_spectral_windows(spark, d):
    """Three frames of 17 channels for each place and day; a row a frame, with the channels that any source fills."""
    k = F.col("k")
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("place"), F.to_date("l_shipdate").alias("day")).agg(F.min(F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("k"))
    seen = s.select("place", "day", *((k * m % 5003 + 1).alias(b) for b, m in _DN.items()))
    weather = s.filter(k % 7 != 0).select("place", "day", (k % 350 / 10).alias("temp_c"), (k % 90 / 10).alias("precip_mm"))
    p = F.col("s_suppkey")
    terrain = read(spark, d, "supplier").filter(p % 5 != 0).select(p.alias("place"), (p % 900 + 100).cast("double").alias("elevation_m"), (p % 40).cast("double").alias("slope_deg"))
    x = spectral_windows(seen, weather, terrain, "place", "day").select("place", "day", "month", F.posexplode(F.arrays_zip("x", "mask")).alias("frame", "v"))
    masked = F.aggregate(F.col("v")["mask"], F.lit(0).cast("long"), lambda a, m: a + m)
    return x.select("place", "day", "month", "frame", *(r6(F.col("v")["x"][i], f"x{i}") for i in sorted(_AT)), masked.alias("masked"))
