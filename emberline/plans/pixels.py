"""Queries over pixel changes: masks, classes, evidence, patch scores, tiers, seasonal anomalies, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import masks as M
from ..functions import scalars as S
from ..functions import scorers as K
from ..operators.grid import persist_table
from .registry import half_up, query, read

BANDS = {"trees": 37, "crops": 53, "bare": 59, "built": 61, "shrub_scrub": 67, "grass": 71}


def _h(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _l(x: str, m: str, k: str) -> str:
    return f"(1 / (1 + exp(-greatest(-60.0, least(60.0, ({k}) * (({x}) - ({m})))))))"


def pixels(spark, d) -> DataFrame:
    """Changes of six bands in hundredths, clouds before and after, from ``lineitem``."""
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pixel"), F.col("l_linenumber").alias("n"), k.alias("k"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("zone"), F.col("l_suppkey").alias("tile"),
        *(((k * m % 101 - 50) / 100).alias(f"d_{b}") for b, m in BANDS.items()), (k * 3 % 11 / 10).alias("cloud_before"), (k * 5 % 11 / 10).alias("cloud_after"), (k * 41 % 100 / 100).alias("before"),
    )


PIXELS = f"""px AS (SELECT l_orderkey AS pixel, l_linenumber AS n, l_orderkey * 7 + l_linenumber AS k, l_shipdate::DATE AS date, l_returnflag AS zone, l_suppkey AS tile,
 {", ".join(f"((l_orderkey * 7 + l_linenumber) * {m} % 101 - 50) / 100 AS d_{b}" for b, m in BANDS.items())},
 (l_orderkey * 7 + l_linenumber) * 3 % 11 / 10 AS cloud_before, (l_orderkey * 7 + l_linenumber) * 5 % 11 / 10 AS cloud_after, (l_orderkey * 7 + l_linenumber) * 41 % 100 / 100 AS before FROM lineitem)"""


def _c(name: str) -> Column:
    return F.col(name)


def _n(cond: Column, name: str) -> Column:
    return F.count(F.when(cond, 1)).alias(name)


@query(f"""WITH {PIXELS} SELECT zone, count(*) AS n, count(*) FILTER (d_trees <= -0.1) AS loss, count(*) FILTER (abs(d_trees) >= 0.1) AS change, count(*) FILTER (greatest(cloud_before, cloud_after) > 0.4) AS unreliable,
count(*) FILTER (k % 4 <> 0 AND d_trees * 8 < -1.5 OR d_trees < -0.072 OR k % 3 <> 0 AND d_crops * 10 < -1.5 OR d_bare > 0.09 OR d_built * 8 > 1.2) AS candidates,
count(*) FILTER (d_trees - least(0, d_shrub_scrub) < -0.06 OR d_crops > 0.08 OR d_built > 0.06) AS deseasonalised FROM px GROUP BY zone""")
def b8_b9_b11_b14_b15_masks(spark, d):
    p = pixels(spark, d)
    cand = M.candidate(F.when(_c("k") % 4 != 0, _c("d_trees") * 8), _c("d_trees"), F.when(_c("k") % 3 != 0, _c("d_crops") * 10), _c("d_bare"), _c("d_built") * 8)
    return p.groupBy("zone").agg(
        F.count("*").alias("n"), _n(M.loss_fires(_c("d_trees")), "loss"), _n(M.change_fires(_c("d_trees")), "change"), _n(M.unreliable(_c("cloud_before"), _c("cloud_after")), "unreliable"),
        _n(cand, "candidates"), _n(M.deseasonalised_candidate(_c("d_trees"), _c("d_crops"), _c("d_built"), _c("d_shrub_scrub")), "deseasonalised"),
    )


@query(f"""WITH {PIXELS}, g AS (SELECT date FROM px GROUP BY date HAVING min(d_trees) < -0.45 OR max(greatest(abs(d_crops), abs(d_bare), abs(d_built))) > 0.49) SELECT date, count(*) AS exported FROM px WHERE date IN (SELECT date FROM g) GROUP BY date""")
def b10_export_gate(spark, d):
    """Windows in which some pixel lost or changed enough go out whole."""
    p = pixels(spark, d)
    strongest = F.max(F.greatest(*(F.abs(f"d_{b}") for b in ("crops", "bare", "built"))))
    passed = p.groupBy("date").agg(F.min("d_trees").alias("low"), strongest.alias("top")).filter((F.col("low") < -0.45) | (F.col("top") > 0.49)).select("date")
    return p.join(passed, "date", "left_semi").groupBy("date").agg(F.count("*").alias("exported"))


@query(f"""WITH {PIXELS}, a AS (SELECT pixel, sum((round(d_trees * 100))::BIGINT) AS s, sum(k * 3 % 11) AS c, count(*) AS n FROM px GROUP BY pixel) SELECT pixel, s / 100 AS cumulative FROM a WHERE s < -50 AND c < 3 * n""")
def b13_hotspots(spark, d):
    """Pixels that lost over half in sum, seen mostly without clouds; sums in hundredths and tenths."""
    a = pixels(spark, d).groupBy("pixel").agg(F.sum(F.round(_c("d_trees") * 100).cast("long")).alias("s"), F.sum(_c("k") * 3 % 11).alias("c"), F.count("*").alias("n"))
    return a.filter((F.col("s") < -50) & (F.col("c") < 3 * F.col("n"))).select("pixel", (F.col("s") / 100).alias("cumulative"))


@query(f"""WITH {PIXELS} SELECT zone, count(*) FILTER ((k % 256) & 30 = 0) AS fmask, count(*) FILTER (k % 4 <= 1) AS summary, count(*) FILTER ((k % 1024) & 3 = 0) AS state, count(*) FILTER (k % 12 IN (2, 3, 4, 5, 6)) AS scl,
count(*) FILTER ((before > 0.25 OR d_shrub_scrub > 0.35) AND d_bare + 0.5 > 0.5) AS to_bare, count(*) FILTER ((before > 0.25 OR d_shrub_scrub > 0.35) AND d_crops + 0.5 > 0.5) AS to_crops,
count(*) FILTER (k % 30 = year(date) - 1980 AND k % 100 >= 5 AND k % 30 BETWEEN 15 AND 24) AS forest_loss, count(*) FILTER (k % 100 >= 5) AS forest,
count(*) FILTER (k % 9 NOT IN (7, 8) AND (k * 7) % 9 = 4 AND k % 45 < 3) AS expansion, count(*) FILTER (k % 9 = 4 AND (k * 7) % 9 = 4 AND k % 45 < 3) AS hard_negative,
count(*) FILTER (k % 4 >= 2 AND DATE '2018-12-31' + (k % 400)::INT BETWEEN DATE '2019-03-01' AND DATE '2019-06-30') AS disturbed FROM px GROUP BY zone""")
def b12_b16_b17_b18_b19_b20_masks(spark, d):
    """Quality bits, class changes, forest loss and baseline, class codes of two years with slope, recent disturbance."""
    k, half = _c("k"), lambda b: _c(f"d_{b}") + 0.5
    before, after, flat = k % 9, k * 7 % 9, k % 45 < 3
    day = lambda s: F.lit(s).cast("date")
    return pixels(spark, d).groupBy("zone").agg(
        _n(M.bits_clear(k % 256, (1, 2, 3, 4)), "fmask"), _n(k % 4 <= 1, "summary"), _n(M.bits_clear(k % 1024, (0, 1)), "state"), _n(M.clear_scene_class(k % 12), "scl"),
        _n(M.vegetation_to(_c("before"), _c("d_shrub_scrub"), half("bare")), "to_bare"), _n(M.vegetation_to(_c("before"), _c("d_shrub_scrub"), half("crops")), "to_crops"),
        _n(M.forest_loss(k % 30, F.year("date") - 1980, k % 100), "forest_loss"), _n(k % 100 >= 5, "forest"),
        _n(~before.isin(7, 8) & (after == 4) & flat, "expansion"), _n((before == 4) & (after == 4) & flat, "hard_negative"),
        _n(M.disturbed_recently(k % 4, k % 400, day("2019-03-01"), day("2019-06-30")), "disturbed"),
    )


@query("""WITH e AS (SELECT event_id, event_id % 21 - 10 AS u, event_id * 3 % 19 - 9 AS v, value * 1.5 AS rh, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE ELSE value END AS x, props FROM events)
SELECT event_id, floor(sqrt(u * u + v * v) * 3.6 * 1e6 + 0.5) / 1e6 AS wind_kmh, round(CASE WHEN 270 - degrees(atan2(v, u)) >= 360 THEN 270 - degrees(atan2(v, u)) - 360 ELSE 270 - degrees(atan2(v, u)) END, 4) AS wind_from, greatest(0, least(100, rh)) AS rh,
CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS x FROM e""")
def b2_h21_weather_units(spark, d):
    e, i = read(spark, d, "events"), F.col("event_id")
    x = F.when(i % 7 == 0, F.lit(float("nan"))).when(i % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    e = e.select("event_id", (i % 21 - 10).alias("u"), (i * 3 % 19 - 9).alias("v"), (F.col("value") * 1.5).alias("rh"), x.alias("x"))
    speed, source = S.wind(F.col("u"), F.col("v"))
    return e.select("event_id", half_up(speed * 3.6, "wind_kmh"), F.round(source, 4).alias("wind_from"), S.clip(F.col("rh"), 0.0, 100.0).alias("rh"), S.safe_float(F.col("x")).alias("x"))


@query("""WITH o AS (SELECT o_orderdate::DATE AS date, o_orderkey AS k FROM orders), s AS (SELECT date, k, CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4, 5) THEN 'Pre-monsoon' WHEN month(date) IN (6, 7, 8, 9) THEN 'Monsoon' ELSE 'Post-monsoon' END AS season,
 CASE WHEN month(date) IN (11, 12, 1, 2) THEN 'dry_cool' WHEN month(date) IN (3, 4, 5) THEN 'dry_hot' WHEN month(date) = 10 THEN 'post_monsoon' ELSE 'monsoon' END AS leaf_season FROM o)
SELECT season, leaf_season, count(*) AS n, count(*) FILTER (month(date) IN (3, 4, 5) OR month(date) = 6 AND day(date) <= 15) AS fire_season, count(*) FILTER (month(date) NOT BETWEEN 6 AND 10) AS dry, count(*) FILTER (year(date) IN (1995, 1997) AND month(date) IN (3, 6, 11) AND k % 3 IN (1, 2)) AS chosen FROM s GROUP BY ALL""")
def b5_b6_b7_seasons(spark, d):
    o = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("k"))
    m = F.month("date")
    chosen = F.year("date").isin(1995, 1997) & m.isin(3, 6, 11) & (F.col("k") % 3).isin(1, 2)
    return o.groupBy(S.season(m).alias("season"), M.seasonal_name(m).alias("leaf_season")).agg(F.count("*").alias("n"), _n(S.in_fire_season(F.col("date")), "fire_season"), _n(S.is_dry_season(m), "dry"), _n(chosen, "chosen"))


_GAINS = [b for b in BANDS if b != "trees"]
_TOP = f"greatest({', '.join('d_' + b for b in _GAINS)})"
_DOMINANT = "CASE " + " ".join(f"WHEN d_{b} = top THEN '{b}'" for b in _GAINS) + " END"
_SECOND = "list_sort([" + ", ".join("d_" + b for b in _GAINS) + "], 'DESC')[2]"


@query(f"""WITH {PIXELS}, t AS (SELECT *, {_TOP} AS top, {_SECOND} AS second FROM px) SELECT pixel, n, k, {_DOMINANT} AS gain, top, {_h("top - second")} AS gap, {_h("d_trees / (before + 1e-6)")} AS relative_loss,
{_h("abs(d_trees) / (abs(d_trees) + abs(d_crops) + abs(d_bare) + 1e-6)")} AS loss_ratio, {" + ".join(f"(abs(d_{b}) > 0.1)::INT" for b in BANDS)} AS diversity, d_trees < 0 AND d_crops > 0 AS crops_anti, d_trees < 0 AND d_bare > 0 AS bare_anti,
CASE WHEN d_trees > 0.05 THEN 'Greening' WHEN d_trees < -0.05 THEN CASE WHEN top > 0.03 THEN CASE {_DOMINANT} WHEN 'crops' THEN 'Encroachment' WHEN 'built' THEN 'Built expansion' WHEN 'bare' THEN 'Clearing' ELSE 'Degradation' END ELSE 'Tree loss (unclassified)' END ELSE 'Other change' END AS change,
CASE WHEN d_trees <= -0.3 AND top < 0.05 THEN 'loss' ELSE {_DOMINANT} END AS pixel_class, CASE WHEN d_trees < -0.15 AND (d_crops > 0.10 OR d_built > 0.10) THEN 1 WHEN d_trees < -0.15 AND (d_bare > 0.10 OR d_shrub_scrub > 0.10 OR d_grass > 0.10) THEN 2 WHEN d_trees < -0.15 THEN 3 WHEN d_trees > 0.15 THEN 4 ELSE 0 END AS truth FROM t""")
def h4_h5_h24_h25_h26_change_classes(spark, d):
    gains = {b: _c(f"d_{b}") for b in _GAINS}
    name, top, gap = S.dominant(gains)
    t, c, b = _c("d_trees"), _c("d_crops"), _c("d_bare")
    diversity = sum(((F.abs(f"d_{x}") > 0.1).cast("int") for x in BANDS), F.lit(0))
    return pixels(spark, d).select(
        "pixel", "n", "k", name.alias("gain"), top.alias("top"), half_up(gap, "gap"), half_up(t / (_c("before") + 1e-6), "relative_loss"), half_up(F.abs(t) / (F.abs(t) + F.abs(c) + F.abs(b) + 1e-6), "loss_ratio"),
        diversity.alias("diversity"), ((t < 0) & (c > 0)).alias("crops_anti"), ((t < 0) & (b > 0)).alias("bare_anti"), E.patch_change(t, gains).alias("change"),
        F.when((t <= -0.3) & (top < 0.05), "loss").otherwise(name).alias("pixel_class"), E.truth_class(t, c, b, _c("d_built"), _c("d_shrub_scrub"), _c("d_grass")).alias("truth"),
    )


_Z = "CASE CASE WHEN month(date) IN (11, 12, 1, 2) THEN 'dry_cool' WHEN month(date) IN (3, 4, 5) THEN 'dry_hot' WHEN month(date) = 10 THEN 'post_monsoon' ELSE 'monsoon' END " + "{} END"


def _zsql(band: str) -> str:
    return _Z.format(" ".join(f"WHEN '{s}' THEN (d_{band} - {n[band][0]}::DOUBLE) / {n[band][1]}::DOUBLE" for s, n in E.SEASONAL_NORMS.items()))


@query(f"""WITH {PIXELS}, z AS (SELECT zone, {", ".join(f"{_zsql(b)} AS z_{b}" for b in BANDS)} FROM px) SELECT zone, {", ".join(f"count(*) FILTER (abs(z_{b}) > 2) AS n_{b}" for b in BANDS)}, {_h("max(greatest(" + ", ".join(f"abs(z_{b})" for b in BANDS) + "))")} AS strongest FROM z GROUP BY zone""")
def h38_seasonal_anomalies(spark, d):
    season = M.seasonal_name(F.month("date"))
    z = pixels(spark, d).select("zone", *(E.seasonal_z(_c(f"d_{b}"), season, b).alias(f"z_{b}") for b in BANDS))
    return z.groupBy("zone").agg(*(_n(F.abs(f"z_{b}") > 2, f"n_{b}") for b in BANDS), half_up(F.max(F.greatest(*(F.abs(f"z_{b}") for b in BANDS))), "strongest"))


@query(f"""WITH {PIXELS}, z AS (SELECT pixel, max(greatest({", ".join(f"abs({_zsql(b)})" for b in ("trees", "crops", "built"))})) AS anomaly, sum((d_trees < -0.01)::INT) AS falls, count(*) AS n, max(k % 11) AS c FROM px GROUP BY pixel), m AS (SELECT max(anomaly) AS most FROM z)
SELECT pixel, {_h("greatest(least(1, anomaly / most * CASE WHEN falls * 2 > n THEN 1.2 ELSE 0.6 END), falls / n * 0.5, c / 20.0::DOUBLE)")} AS score FROM z, m""")
def j9_fused_anomaly(spark, d):
    """Strongest seasonal anomaly over the largest of all, raised or lowered by recovery, or a gradual or cumulative loss."""
    season = M.seasonal_name(F.month("date"))
    top = F.greatest(*(F.abs(E.seasonal_z(_c(f"d_{b}"), season, b)) for b in ("trees", "crops", "built")))
    z = persist_table(pixels(spark, d).groupBy("pixel").agg(F.max(top).alias("anomaly"), _n(_c("d_trees") < -0.01, "falls"), F.count("*").alias("n"), F.max(_c("k") % 11).alias("c")), "anomalies")
    most = z.agg(F.max("anomaly").alias("most"))  # one row
    instant = F.least(F.lit(1.0), F.col("anomaly") / F.col("most") * F.when(F.col("falls") * 2 > F.col("n"), 1.2).otherwise(0.6))
    return z.crossJoin(F.broadcast(most)).select("pixel", half_up(F.greatest(instant, F.col("falls") / F.col("n") * 0.5, F.col("c") / 20), "score"))


@query(f"""WITH {PIXELS} SELECT pixel, n, k, CASE WHEN abs(d_trees) > 0.01 THEN {_h("abs(d_crops) / abs(d_trees)")} WHEN abs(d_crops) > 0.1 THEN 999.0 ELSE 0.0 END AS ratio, CASE WHEN d_trees > 0.15 THEN 'STRONG' WHEN d_trees > 0.08 THEN 'MODERATE' WHEN d_trees > 0.03 THEN 'WEAK' ELSE 'SUPPRESS' END AS verdict,
CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN greatest(0.0, least(2.0, d_trees * 6)) ELSE 0.0 END AS dnbr, CASE WHEN k % 40 = 0 THEN NULL ELSE {_h("0.4 / (k % 40) + 0.4 / (k % 25 + 1) + 0.2 / (k % 45 + 1)")} END AS friction,
{_h("CASE WHEN k % 6 = 0 THEN -15.0 ELSE 10 * log10(k % 97 / 1000 + 0.001::DOUBLE) END")} AS vh_db, {_h("greatest(0.0, least(0.99, greatest(0.30, coalesce(nullif(k % 97 / 97, 0), 0.65) * 0.30 + (abs(d_trees * 8) - 1.5) * 0.09 + k % 11 / 10 * 0.25 + least(k % 50 / 10, 3.0) * 0.04)))")} AS composite,
CASE WHEN k % 90 < 1 THEN 255 ELSE (k % 60 >= 30)::INT * 2 + (k % 360 BETWEEN 135 AND 225)::INT END AS terrain, {_h("sin(radians(k % 360))")} AS aspect_sin, {_h("cos(radians(k % 360))")} AS aspect_cos,
CASE WHEN k % 13 = 0 THEN NULL ELSE greatest(0.0, least(1.0, k % 12000 / 10000)) END AS reflectance FROM px""")
def h2_h29_h32_h34_h37_h39_h40_h43_i14_scalars(spark, d):
    k, t = _c("k"), _c("d_trees")
    dnbr = F.when(k % 5 == 0, None).when(k % 3 == 0, S.clip(t * 6, 0.0, 2.0)).otherwise(0.0)
    ratio = E.exaggeration(_c("d_crops"), t)
    return pixels(spark, d).select(
        "pixel", "n", "k", F.when(ratio == 999, 999.0).otherwise(F.floor(ratio * 1e6 + 0.5) / 1e6).alias("ratio"), E.residual_verdict(t).alias("verdict"), dnbr.alias("dnbr"),
        half_up(E.friction(k % 40, k % 25 + 1, k % 45), "friction"), half_up(F.coalesce(F.when(k % 6 != 0, S.decibels(k % 97 / 1000 + 0.001)), F.lit(-15.0)), "vh_db"),
        half_up(E.composite_score(k % 97 / 97, t * 8, k % 11 / 10, k % 50 / 10), "composite"),
        M.terrain_risk(F.when(k % 90 < 1, -9999).otherwise(k % 60), k % 360).alias("terrain"), half_up(F.sin(F.radians(k % 360)), "aspect_sin"), half_up(F.cos(F.radians(k % 360)), "aspect_cos"),
        F.when(k % 13 != 0, S.clip(k % 12000 / 10000, 0.0, 1.0)).alias("reflectance"),
    )


@query(f"""WITH {PIXELS}, q AS (SELECT CASE k % 6 WHEN 0 THEN 'Trees' WHEN 1 THEN 'Bare' WHEN 2 THEN 'Crops' WHEN 3 THEN 'Shrub and Scrub' WHEN 4 THEN 'Built' ELSE 'Grass' END AS source, CASE WHEN k % 2 = 0 THEN 'deforestation' ELSE 'encroachment' END AS truth FROM px)
SELECT source, truth, count(*) AS n, source IN ('Trees', 'Shrub and Scrub') OR source = 'Bare' AND truth = 'deforestation' OR source = 'Crops' AND truth = 'encroachment' AS agrees FROM q GROUP BY ALL""")
def h27_source_agreement(spark, d):
    order = ("Trees", "Bare", "Crops", "Shrub and Scrub", "Built", "Grass")
    q = pixels(spark, d).select(F.get(F.array(*map(F.lit, order)), (_c("k") % 6).cast("int")).alias("source"), F.when(_c("k") % 2 == 0, "deforestation").otherwise("encroachment").alias("truth"))
    return q.groupBy("source", "truth").agg(F.count("*").alias("n")).withColumn("agrees", E.source_agrees(F.col("source"), F.col("truth")))


_P = {"nz": "CASE WHEN k % 4 <> 0 THEN d_trees * 8 END", "nd": "-d_trees", "dz": "CASE WHEN k % 3 <> 0 THEN d_crops * 8 END", "td": "CASE WHEN k % 9 <> 0 THEN d_trees END", "ba": "CASE WHEN k % 5 <> 0 THEN d_bare END",
      "cr": "CASE WHEN k % 7 <> 0 THEN d_crops END", "bl": "CASE WHEN k % 7 <> 1 THEN d_built END", "vh": "CASE WHEN k % 2 = 0 THEN d_grass * 8 END", "cu": "CASE WHEN k % 11 > 2 THEN k % 11 / 10 END"}
_DRY = "month(date) NOT BETWEEN 6 AND 10"


def _mean_sql(signals: str, otherwise: str = "NULL") -> str:
    parts = [x.split(":") for x in signals.split()]
    weight = " + ".join(f"CASE WHEN {e} IS NOT NULL THEN {w} ELSE 0 END" for e, w in parts)
    total = " + ".join(f"coalesce({e} * {w}, 0)" for e, w in parts)
    return f"CASE WHEN {weight} > 0 THEN ({total}) / ({weight}) ELSE {otherwise} END"


#: The patch score spelled out; ``drop`` is null where clouds hide the pass (k % 4 = 1).
_SCORE = f"""{PIXELS}, p AS (SELECT pixel, n, k, tile, date, {_DRY} AS dry, before, cloud_after, {", ".join(f"{x} AS {a}" for a, x in _P.items())} FROM px),
e0 AS (SELECT *, greatest(0.0, before - greatest(0, before + td)) AS drop_by, (greatest(0, before + td) - greatest(before, 0.45)) / 0.14 AS dzz FROM p),
e1 AS (SELECT *, CASE WHEN nz IS NOT NULL THEN CASE WHEN NOT (dry AND nz > -0.5) THEN {_l("-nz", "2.0", "1.5")} END ELSE CASE WHEN NOT (dry AND nd > -0.05) THEN {_l("nd", "0.15", "8")} END END AS a,
 CASE WHEN NOT (dry AND dz > -0.5) THEN {_l("-dz", "2.0", "1.5")} END AS b, CASE WHEN k % 4 <> 1 THEN least({_l("drop_by", "0.05 + before * 0.10", "25")} * (1 + greatest(0.0, -dzz) / 4 * {_l("drop_by", "0.08", "40")}), 1.0) * (1 - {_l("cloud_after", "0.60", "15")}) END AS dr,
 {_l("ba", "0.08", "15")} * CASE WHEN td <= -0.04 THEN 1.0 ELSE 0.4 END AS ev_bare_raw, CASE WHEN (cr IS NOT NULL OR bl IS NOT NULL) AND td < -0.12 * 0.4 THEN {_l("greatest(coalesce(cr / 0.10, 0), coalesce(bl / 0.05, 0))", "1.0", "2")} END AS cv,
 CASE WHEN vh IS NOT NULL THEN {_l("-vh", "CASE WHEN dry THEN 2.0 ELSE 1.5 END", "0.8")} * CASE WHEN dry THEN 0.6 ELSE 0.5 END END AS v, CASE WHEN cu IS NOT NULL THEN {_l("cu", "CASE WHEN dry THEN 0.50 ELSE 0.40 END", "4")} * CASE WHEN dry THEN 0.5 ELSE 0.7 END END AS u FROM e0),
e2 AS (SELECT *, CASE WHEN td IS NULL THEN NULL ELSE coalesce(dr, {_l("-td", "0.12", "15")}) END AS c, CASE WHEN ba IS NOT NULL THEN ev_bare_raw END AS g FROM (SELECT * REPLACE (CASE WHEN dz IS NOT NULL THEN b END AS b) FROM e1)),
e3 AS (SELECT *, {_mean_sql("a:3.5 b:3.0")} AS ms, {_mean_sql("c:3.0 g:2.5 cv:1.5")} AS mi, {_mean_sql("v:1.5 u:0.8")} AS mr, {_mean_sql("a:3.5 b:3.0 c:3.0 g:2.5 cv:1.5", "0.5")} AS mo, {_mean_sql("a:3.5 b:3.0 c:3.0 g:2.5 cv:1.5 v:1.5 u:0.8")} AS mt FROM e2),
e4 AS (SELECT *, CASE WHEN ms IS NULL OR mi IS NULL THEN 1.0 WHEN ms >= 0.60 AND mi >= 0.60 THEN 1.25 WHEN ms >= 0.55 OR mi >= 0.55 THEN 1.0 ELSE 0.85 END AS ag FROM e3),
scored AS (SELECT pixel, n, k, tile, date, CASE WHEN mt IS NULL THEN 0.0 ELSE greatest(0.0, least(0.95, mt * CASE WHEN mr >= 0.58 THEN least(ag * 1.15, 1.50) ELSE ag END * least(CASE WHEN NOT dry AND td < -0.08 AND nz > 0.3 THEN 0.55 ELSE 1.0 END, CASE WHEN vh > 2.0 AND mo > 0.55 THEN 0.75 ELSE 1.0 END))) END AS confidence FROM e4)"""


def scored_patches(spark, d) -> DataFrame:
    p = pixels(spark, d)
    k, t = _c("k"), _c("d_trees")
    td = F.when(k % 9 != 0, t)
    drop = F.when((k % 4 != 1) & td.isNotNull(), E.drop_evidence(_c("before"), F.greatest(F.lit(0.0), _c("before") + td), F.lit(0.45), F.lit(0.14), _c("cloud_after")))
    evidence = {
        "ndvi_z": F.when(k % 4 != 0, t * 8), "dndvi": -t, "dw_z": F.when(k % 3 != 0, _c("d_crops") * 8), "trees_delta": td, "drop": drop, "bare": F.when(k % 5 != 0, _c("d_bare")),
        "crops": F.when(k % 7 != 0, _c("d_crops")), "built": F.when(k % 7 != 1, _c("d_built")), "vh": F.when(k % 2 == 0, _c("d_grass") * 8), "cusum": F.when(k % 11 > 2, k % 11 / 10),
    }
    return E.with_patch_confidence(p, evidence, S.is_dry_season(F.month("date")))


@query(f"WITH {_SCORE} SELECT pixel, n, k, {_h('confidence')} AS confidence FROM scored")
def k4_k5_patch_scores(spark, d):
    return scored_patches(spark, d).select("pixel", "n", "k", half_up(F.col("confidence"), "confidence"))


@query(f"WITH {_SCORE} SELECT tile, count(*) AS n, count(*) FILTER (confidence >= 0.35) AS kept, count(*) FILTER (confidence >= 0.7) AS high, {_h('max(confidence)')} AS best FROM scored GROUP BY tile HAVING count(*) FILTER (confidence >= 0.35) > 0")
def k7_k8_region_results(spark, d):
    """Per region: patches kept at a confidence of 0.35, strong ones, the best; regions that keep none go."""
    c = F.col("confidence")
    return scored_patches(spark, d).groupBy("tile").agg(F.count("*").alias("n"), _n(c >= 0.35, "kept"), _n(c >= 0.7, "high"), half_up(F.max(c), "best")).filter("kept > 0")


@query(f"""WITH {PIXELS}, f AS (SELECT zone, d_trees * 8 < -2 AS nd, d_shrub_scrub > 0.15 AS yo, d_bare > 0.1 AS nb, d_grass * 8 > 2 AS vh, k % 11 > 5 AS cu, d_trees < -0.12 AS td, d_crops > 0.10 OR d_built > 0.05 AS cv, d_crops * 8 < -2 AS dz FROM px),
t AS (SELECT zone, CASE WHEN (nd OR yo) AND nb AND vh AND cu OR nd AND dz OR td AND cv AND vh THEN 1 WHEN (nd OR yo) AND nb AND vh OR td AND vh OR dz THEN 2 WHEN vh AND cu THEN 3 ELSE 0 END AS tier FROM f) SELECT zone, tier, count(*) AS n FROM t GROUP BY ALL""")
def k6_signal_tiers(spark, d):
    t, c = _c("d_trees"), _c("d_crops")
    tier = E.tiers(t * 8 < -2, _c("d_shrub_scrub") > 0.15, _c("d_bare") > 0.1, _c("d_grass") * 8 > 2, _c("k") % 11 > 5, t < -0.12, (c > 0.10) | (_c("d_built") > 0.05), c * 8 < -2)
    return pixels(spark, d).groupBy("zone", tier.alias("tier")).agg(F.count("*").alias("n"))


@query(f"""WITH {PIXELS}, b AS (SELECT pixel, {", ".join(f"sum(round(d_{b} * 100)::BIGINT) AS {b}" for b in BANDS)}, max(greatest({", ".join(f"abs(d_{b})" for b in BANDS)})) AS top, sum(CASE WHEN k % 8 = 0 THEN 10 ELSE k * 5 % 11 END) AS cloud, max(CASE WHEN k % 8 = 0 THEN 10 ELSE k * 5 % 11 END) AS worst, count(*) FILTER (k % 8 <> 0 AND k * 5 % 11 < 3) AS clear, count(*) AS n FROM px GROUP BY pixel)
SELECT pixel, trees / 100 AS trees, {_h("trees::DOUBLE / n / 100")} AS mean_trees, top AS strongest, {_h("cloud::DOUBLE / n / 10")} AS cloud, worst / 10 AS worst, clear FROM b""")
def d20_d22_accumulation(spark, d):
    """Sums, means and strongest change per pixel; a missing cloud counts as full."""
    cloud = F.when(_c("k") % 8 == 0, 10).otherwise(_c("k") * 5 % 11)
    x = pixels(spark, d).groupBy("pixel").agg(
        F.sum(F.round(_c("d_trees") * 100).cast("long")).alias("t"), F.max(F.greatest(*(F.abs(f"d_{b}") for b in BANDS))).alias("strongest"), F.sum(cloud).alias("c"), F.max(cloud).alias("w"),
        _n((_c("k") % 8 != 0) & (_c("k") * 5 % 11 < 3), "clear"), F.count("*").alias("n"),
    )
    return x.select("pixel", (F.col("t") / 100).alias("trees"), half_up(F.col("t") / F.col("n") / 100, "mean_trees"), "strongest", half_up(F.col("c") / F.col("n") / 10, "cloud"), (F.col("w") / 10).alias("worst"), "clear")


_CUM = f"c AS (SELECT pixel, {', '.join(f'sum(round(d_{b} * 100)::BIGINT) AS {b}' for b in BANDS)} FROM px GROUP BY pixel)"


@query(f"""WITH {PIXELS}, {_CUM} SELECT count(*) AS n, count(*) FILTER (trees < -30) AS loss, {", ".join(f"count(*) FILTER (trees < -30 AND {b} > 20) AS loss_{b}" for b in _GAINS)}, count(*) FILTER (trees < -30 AND (crops > 20 OR built > 20)) AS encroachment, count(*) FILTER (trees < -30 AND (bare > 20 OR shrub_scrub > 20 OR grass > 20)) AS degradation FROM c""")
def d24_co_occurrence(spark, d):
    c = pixels(spark, d).groupBy("pixel").agg(*(F.sum(F.round(_c(f"d_{b}") * 100).cast("long")).alias(b) for b in BANDS))
    loss, gain = F.col("trees") < -30, lambda b: F.col(b) > 20
    return c.agg(F.count("*").alias("n"), _n(loss, "loss"), *(_n(loss & gain(b), f"loss_{b}") for b in _GAINS), _n(loss & (gain("crops") | gain("built")), "encroachment"), _n(loss & (gain("bare") | gain("shrub_scrub") | gain("grass")), "degradation"))


@query(f"""WITH {PIXELS}, l AS (SELECT *, CASE WHEN d_trees <= -0.1 THEN CASE WHEN k % 3 = 0 THEN 'TP' WHEN k % 3 = 1 THEN 'FP' ELSE 'FP_contra' END ELSE CASE WHEN k % 5 = 0 THEN 'FN' ELSE 'TN' END END AS label FROM px)
SELECT date, {", ".join(f"count(*) FILTER (label = '{x}') AS {x.lower()}" for x in ("TP", "FP", "FP_contra", "FN", "TN"))}, count(*) FILTER (label = 'TP') / nullif(count(*) FILTER (label IN ('TP', 'FP', 'FP_contra')), 0) AS precision FROM l GROUP BY date""")
def d13_window_labels(spark, d):
    x = labelled(spark, d).groupBy("date").pivot("label", LABELS).count().na.fill(0)
    return x.toDF("date", *(n.lower() for n in LABELS)).withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp") + F.col("fp_contra")))


LABELS = ["TP", "FP", "FP_contra", "FN", "TN"]


def labelled(spark, d) -> DataFrame:
    k = _c("k")
    fired = F.when(k % 3 == 0, "TP").when(k % 3 == 1, "FP").otherwise("FP_contra")
    return pixels(spark, d).withColumn("label", F.when(M.loss_fires(_c("d_trees")), fired).otherwise(F.when(k % 5 == 0, "FN").otherwise("TN")))


_LAB = f"{PIXELS}, l AS (SELECT *, CASE WHEN d_trees <= -0.1 THEN CASE WHEN k % 3 = 0 THEN 'TP' WHEN k % 3 = 1 THEN 'FP' ELSE 'FP_contra' END ELSE CASE WHEN k % 5 = 0 THEN 'FN' ELSE 'TN' END END AS label FROM px)"


@query(f"WITH {_LAB} SELECT pixel, count(*) AS n, count(*) FILTER (label = 'TP') AS tp, count(*) FILTER (label IN ('FP', 'FP_contra')) AS fp, count(*) FILTER (label = 'TP') / nullif(count(*) FILTER (label IN ('TP', 'FP', 'FP_contra')), 0) AS accuracy FROM l GROUP BY pixel")
def d14_pixel_accuracy(spark, d):
    x = labelled(spark, d)
    is_ = lambda *v: _c("label").isin(*v)
    return x.groupBy("pixel").agg(F.count("*").alias("n"), _n(is_("TP"), "tp"), _n(is_("FP", "FP_contra"), "fp")).withColumn("accuracy", F.try_divide("tp", F.col("tp") + F.col("fp")))


@query(f"""WITH {_LAB} SELECT label, count(*) AS n, {", ".join(_h(f"sum(round(d_{b} * 100)::BIGINT)::DOUBLE / count(*) / 100") + f" AS {b}" for b in BANDS)}, quantile_disc(d_trees, 0.1) AS p10, quantile_disc(d_trees, 0.9) AS p90, count(*) FILTER (d_trees <= -0.4) AS severe FROM l GROUP BY label""")
def d30_label_profiles(spark, d):
    means = [half_up(F.sum(F.round(_c(f"d_{b}") * 100).cast("long")) / F.count("*") / 100, b) for b in BANDS]
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY d_trees)")
    return labelled(spark, d).groupBy("label").agg(F.count("*").alias("n"), *means, at(0.1).alias("p10"), at(0.9).alias("p90"), _n(_c("d_trees") <= -0.4, "severe"))


@query(f"""WITH {_LAB}, a AS (SELECT pixel, arg_min(dayofyear(date), (date, n, k)) FILTER (d_trees <= -0.1) AS first_doy, count(*) FILTER (d_trees <= -0.1) AS n_fires, sum(round(d_trees * 100)::BIGINT) AS loss, min(d_trees) AS worst, min(date) FILTER (d_trees <= -0.1) AS first_day FROM l GROUP BY pixel)
SELECT pixel, first_day, first_doy::INT AS first_doy, n_fires, loss / 100 AS cumulative, worst, CASE WHEN loss < -100 THEN 'severe' WHEN loss < -50 THEN 'moderate' WHEN loss < -15 THEN 'minor' ELSE 'none' END AS severity FROM a""")
def d33_truth_by_date(spark, d):
    t, fired = _c("d_trees"), M.loss_fires(_c("d_trees"))
    a = pixels(spark, d).groupBy("pixel").agg(F.min(F.when(fired, _c("date"))).alias("first_day"), _n(fired, "n_fires"), F.sum(F.round(t * 100).cast("long")).alias("loss"), F.min(t).alias("worst"))
    loss = F.col("loss")
    severity = F.when(loss < -100, "severe").when(loss < -50, "moderate").when(loss < -15, "minor").otherwise("none")
    return a.select("pixel", "first_day", F.dayofyear("first_day").alias("first_doy"), "n_fires", (loss / 100).alias("cumulative"), "worst", severity.alias("severity"))


@query(f"""WITH {PIXELS}, f AS (SELECT pixel, min(date_trunc('month', date))::DATE AS first, count(*) AS n FROM px WHERE d_trees <= -0.1 GROUP BY pixel), h AS (SELECT first, count(*) AS n FROM f GROUP BY first)
SELECT first, n, (sum(n) OVER (ORDER BY first))::BIGINT AS so_far, {_h("100.0::DOUBLE * sum(n) OVER (ORDER BY first) / sum(n) OVER ()")} AS pct FROM h""")
def d31_detection_timing(spark, d):
    """Months in which pixels fired first, cumulated; a row a month."""
    f = pixels(spark, d).filter(M.loss_fires(_c("d_trees"))).groupBy("pixel").agg(F.min(F.trunc("date", "month")).alias("first"))
    h = f.groupBy("first").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.orderBy("first"))
    return h.select("first", "n", so_far.alias("so_far"), half_up(100.0 * so_far / F.sum("n").over(Window.partitionBy()), "pct"))


@query(f"""WITH {PIXELS} SELECT date, {_h("sum(round(d_trees * 100)::BIGINT)::DOUBLE / count(*) FILTER (d_trees <> 0) / 100")} AS mean, min(d_trees) AS low, quantile_disc(CASE WHEN d_trees <> 0 THEN d_trees END, 0.05) AS p5 FROM px GROUP BY date""")
def d55_window_timeline(spark, d):
    """Changes that are not zero, per window."""
    x = pixels(spark, d).withColumn("v", F.when(_c("d_trees") != 0, _c("d_trees")))
    return x.groupBy("date").agg(half_up(F.try_divide(F.sum(F.round(_c("d_trees") * 100).cast("long")), F.count("v")) / 100, "mean"), F.min("d_trees").alias("low"), F.expr("percentile_disc(0.05) WITHIN GROUP (ORDER BY v)").alias("p5"))


@query(f"""WITH {_LAB}, x AS (SELECT pixel, n, k, label, greatest({", ".join(f"abs(d_{b})" for b in BANDS)}) > 0.45 OR label IN ('TP', 'FN') AS active FROM l) SELECT label, count(*) AS n, count(*) FILTER (active) AS active FROM x GROUP BY label""")
def l3_active_pixels(spark, d):
    """Labels of all pixel windows, and how many are active: strong change in some band, or true."""
    active = (F.greatest(*(F.abs(f"d_{b}") for b in BANDS)) > 0.45) | _c("label").isin("TP", "FN")
    return labelled(spark, d).groupBy("label").agg(F.count("*").alias("n"), _n(active, "active"))


@query(f"""WITH {PIXELS}, s AS (SELECT tile, count(*) AS n, count(*) FILTER (d_trees <= -0.1 AND k % 3 = 0) AS tp, count(DISTINCT date) AS windows, count(*) FILTER (d_trees <= -0.1) AS alerts FROM px GROUP BY tile)
SELECT tile, tp, windows, alerts, tp >= 60 AND windows >= 3 AND alerts >= 150 AS ready, CASE WHEN tp >= 60 AND windows >= 3 AND alerts >= 150 THEN tile::VARCHAR ELSE 'all' END AS model FROM s""")
def l15_readiness(spark, d):
    """Whether a sub-range has enough true alerts for a model of its own, else that of all."""
    fired = M.loss_fires(_c("d_trees"))
    s = pixels(spark, d).groupBy("tile").agg(_n(fired & (_c("k") % 3 == 0), "tp"), F.countDistinct("date").alias("windows"), _n(fired, "alerts"))
    ready = (F.col("tp") >= 60) & (F.col("windows") >= 3) & (F.col("alerts") >= 150)
    return s.select("tile", "tp", "windows", "alerts", ready.alias("ready"), F.when(ready, F.col("tile").cast("string")).otherwise("all").alias("model"))


_FEATURES = ", ".join(f"d_{b}" for b in BANDS)


@query(f"""WITH {PIXELS} SELECT pixel, n, k, {_FEATURES}, {_h("sqrt(" + " + ".join(f"d_{b} * d_{b}" for b in BANDS) + ")")} AS magnitude, greatest(cloud_before, cloud_after) AS worst_cloud, {_h("d_trees * (1 - cloud_after)")} AS clear_loss, month(date)::INT AS month, (month(date) IN (6, 7, 8, 9))::INT AS monsoon, (month(date) IN (12, 1, 2))::INT AS winter,
row_number() OVER w - 1 AS windows_before, coalesce(sum((d_trees <= -0.1)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS alerts_before, coalesce(sum(round(d_trees * 100)::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT / 100 AS loss_before FROM px WINDOW w AS (PARTITION BY pixel ORDER BY date, n, k, tile)""")
def l1_feature_table(spark, d):
    """Features of a pixel window: changes, clouds, season and what came before."""
    w = Window.partitionBy("pixel").orderBy("date", "n", "k", "tile")
    past, m = w.rowsBetween(Window.unboundedPreceding, -1), F.month("date")
    magnitude = F.sqrt(sum((_c(f"d_{b}") * _c(f"d_{b}") for b in list(BANDS)[1:]), _c("d_trees") * _c("d_trees")))
    return pixels(spark, d).select(
        "pixel", "n", "k", *(f"d_{b}" for b in BANDS), half_up(magnitude, "magnitude"), F.greatest("cloud_before", "cloud_after").alias("worst_cloud"), half_up(_c("d_trees") * (1 - _c("cloud_after")), "clear_loss"),
        m.alias("month"), (S.season(m) == "Monsoon").cast("int").alias("monsoon"), (S.season(m) == "Winter").cast("int").alias("winter"), (F.row_number().over(w) - 1).cast("long").alias("windows_before"),
        F.coalesce(F.sum(M.loss_fires(_c("d_trees")).cast("int")).over(past), F.lit(0)).alias("alerts_before"), (F.coalesce(F.sum(F.round(_c("d_trees") * 100).cast("long")).over(past), F.lit(0)) / 100).alias("loss_before"),
    )


@query(f"""WITH {PIXELS}, s AS (SELECT pixel, n, k, before, greatest(0, before + d_trees) AS after, 0.45 - 0.1 * (month(date) % 3) AS m1 FROM px), r AS (SELECT pixel, n, k, greatest(0.0, before - after) AS loss, before, after, m1 FROM s)
SELECT pixel, n, k, {_h(f"(0.7 * {_l('loss', '0.05 + 0.10 * before', '25 + 20 * greatest(0.0, (0.30 - before) / 0.30)')} + 0.3 * {_l('loss / greatest(before, 0.05)', '0.30', '8')})")} AS raw FROM r""")
def k2_k19_scores_from_deltas(spark, d):
    """Before and after rebuilt from a change on a baseline, then the evidence of the drop before it is lifted."""
    before, after = _c("before"), F.greatest(F.lit(0.0), _c("before") + _c("d_trees"))
    absolute, relative = K.drop_parts(F.greatest(F.lit(0.0), before - after), before)
    return pixels(spark, d).select("pixel", "n", "k", half_up(0.7 * absolute + 0.3 * relative, "raw"))
