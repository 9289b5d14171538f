"""Queries over regions, shapes and tiles: overlaps, lookups, clips, burn-ins, mosaics, dissolves, samples, bulletins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grid as G
from ..operators import spatial
from .rasters import _FOUR, _INSIDE, _REGION_SQL, _labels, _regions
from .registry import ALERTS, GRID, RASTER, alerts, grid, half_up, query, r6, raster, read


def boxes(spark, d) -> DataFrame:
    """A box of 4 by 4 for each order: its lower left corner, a risk."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    return o.select(k.alias("id"), (k * 7919 % 2400 / 10).alias("x"), (k * 104729 % 100003 / 10).alias("y"), (k % 100 / 100).alias("risk"), F.col("o_orderstatus").alias("kind"))


def ranges(spark, d) -> DataFrame:
    """Ranges as boxes of 12 by 9, one a customer in a lattice 20 wide, with a weight for some."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    return c.select(k.alias("range"), (k % 20 * 12).cast("double").alias("rx"), (F.floor(k / 20) * 9).cast("double").alias("ry"), F.when(k % 3 == 0, 1.5).alias("weight"))


BOXES = """bx AS (SELECT o_orderkey AS id, o_orderkey * 7919 % 2400 / 10 AS x, o_orderkey * 104729 % 100003 / 10 AS y, o_orderkey % 100 / 100 AS risk, o_orderstatus AS kind FROM orders),
rg AS (SELECT c_custkey AS range, c_custkey % 20 * 12.0::DOUBLE AS rx, c_custkey // 20 * 9.0::DOUBLE AS ry, CASE WHEN c_custkey % 3 = 0 THEN 1.5::DOUBLE END AS weight FROM customer)"""


def touching(a: DataFrame, b: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """Boxes (x, y, w, h) of ``a`` with the boxes (rx, ry, rw, rh) of ``b`` that they overlap: met in cells, once each."""
    cell = lambda c: F.floor(c / size)
    spread = lambda df, x, y, w, h: df.withColumn("cx", F.explode(F.sequence(cell(F.col(x)), cell(F.col(x) + F.col(w))))).withColumn("cy", F.explode(F.sequence(cell(F.col(y)), cell(F.col(y) + F.col(h)))))
    p, q = spread(a, "x", "y", "w", "h"), spread(b, "rx", "ry", "rw", "rh")
    over = (F.col("x") < F.col("rx") + F.col("rw")) & (F.col("rx") < F.col("x") + F.col("w")) & (F.col("y") < F.col("ry") + F.col("rh")) & (F.col("ry") < F.col("y") + F.col("h"))
    first = (F.col("cx") == cell(F.greatest("x", "rx"))) & (F.col("cy") == cell(F.greatest("y", "ry")))  # the cell that holds the overlap's corner
    hit = p.join(q, ["cx", "cy"]).filter(over & first).drop("cx", "cy")
    if how == "inner":
        return hit
    return a.join(hit.select("id", *[c for c in b.columns]), "id", how)


_OVER = "x < rx + 12 AND rx < x + 4 AND y < ry + 9 AND ry < y + 4"


@query(f"WITH {BOXES} SELECT id, range, least(risk * coalesce(weight, 1.0), 1.0) AS weighted FROM bx LEFT JOIN rg ON {_OVER}")
def c2_weighted_by_range(spark, d):
    """Risk boxes with each range they touch, weighted by it; boxes outside all keep their risk."""
    a = boxes(spark, d).withColumn("w", F.lit(4.0)).withColumn("h", F.lit(4.0))
    b = ranges(spark, d).withColumn("rw", F.lit(12.0)).withColumn("rh", F.lit(9.0))
    x = touching(a, b, 12.0, "left")
    return x.select("id", "range", F.least(F.col("risk") * F.coalesce("weight", F.lit(1.0)), F.lit(1.0)).alias("weighted"))


@query(f"WITH {BOXES} SELECT range FROM rg WHERE EXISTS (SELECT 1 FROM bx WHERE kind = 'P' AND {_OVER})")
def c4_context_features(spark, d):
    """Ranges that touch a forecast box."""
    a = boxes(spark, d).filter("kind = 'P'").withColumn("w", F.lit(4.0)).withColumn("h", F.lit(4.0))
    b = ranges(spark, d).withColumn("rw", F.lit(12.0)).withColumn("rh", F.lit(9.0))
    return touching(a, b, 12.0).select("range").distinct()


@query(f"""WITH {BOXES}, f AS (SELECT range, count(*) AS n_forecast, max(risk) AS top FROM bx JOIN rg ON {_OVER} WHERE kind = 'P' GROUP BY range), a AS (SELECT range, count(*) AS n_active FROM bx JOIN rg ON {_OVER} WHERE kind = 'O' GROUP BY range)
SELECT range, coalesce(n_forecast, 0) AS n_forecast, coalesce(n_active, 0) AS n_active, top, n_forecast IS NOT NULL AS context FROM rg LEFT JOIN f USING (range) LEFT JOIN a USING (range)""")
def k12_daily_layers(spark, d):
    """Per range: forecast boxes, active ones, the highest risk, and whether it is context of the forecast."""
    a = boxes(spark, d).withColumn("w", F.lit(4.0)).withColumn("h", F.lit(4.0))
    b = ranges(spark, d).withColumn("rw", F.lit(12.0)).withColumn("rh", F.lit(9.0))
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    x = touching(a, b, 12.0).groupBy("range").agg(n("P").alias("n_forecast"), n("O").alias("n_active"), F.max(F.when(F.col("kind") == "P", F.col("risk"))).alias("top"))
    out = b.select("range").join(x, "range", "left").na.fill(0, ["n_forecast", "n_active"])
    return out.withColumn("context", F.col("n_forecast") > 0)


@query(f"""WITH {BOXES}, c AS (SELECT id, range, greatest(0, least(x + 4, rx + 12) - greatest(x, rx)) * greatest(0, least(y + 4, ry + 9) - greatest(y, ry)) AS inter FROM bx JOIN rg ON {_OVER}) SELECT id, range, round(inter, 6) AS clipped, round(inter / (16 + 108 - inter), 6) AS iou FROM c""")
def h14_clipped_boxes(spark, d):
    """Area of a ring clipped to a range's box, and their overlap over their union."""
    a = boxes(spark, d).withColumn("w", F.lit(4.0)).withColumn("h", F.lit(4.0))
    b = ranges(spark, d).withColumn("rw", F.lit(12.0)).withColumn("rh", F.lit(9.0))
    x, y = F.col("x"), F.col("y")
    ring = F.array(*(F.struct((x + i).alias("x"), (y + j).alias("y")) for i, j in ((0, 0), (4, 0), (4, 4), (0, 4))))
    hit = touching(a, b, 12.0).withColumn("ring", ring)
    inter = S.ring_area(S.clipped(F.col("ring"), F.col("rx"), F.col("ry"), F.col("rx") + 12, F.col("ry") + 9))
    hit = hit.withColumn("inter", inter)
    return hit.select("id", "range", r6(F.col("inter"), "clipped"), r6(F.col("inter") / (16 + 108 - F.col("inter")), "iou"))


@query(f"""WITH {GRID}, m AS (SELECT max(row) AS r, max(col) AS c FROM grid) SELECT o_orderkey AS id, any_value(g.v) AS v, any_value(g.q) AS q FROM orders JOIN grid g ON g.row = o_orderkey // 240 AND g.col = o_custkey % 64 WHERE g.v > 0 AND g.q > 0 GROUP BY o_orderkey""")
def c25_pixels_at_points(spark, d):
    """Bands of the pixel under each point; a point with an empty band goes."""
    pts = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 240).cast("int").alias("row"), (F.col("o_custkey") % 64).cast("int").alias("col"))
    return pts.join(grid(spark, d), ["row", "col"]).filter("v > 0 and q > 0").select("id", "v", "q")


_LATTICE = "la AS (SELECT c_custkey AS site, c_custkey % 50 / 100 AS lon, c_custkey // 50 / 100 AS lat FROM customer), pt AS (SELECT o_orderkey AS id, o_custkey % 50 / 100 + CASE WHEN o_orderkey % 3 = 0 THEN 0.004 ELSE 0.00002 END::DOUBLE AS lon, o_custkey // 50 / 100 AS lat FROM orders)"


@query(f"""WITH {_LATTICE}, e AS (SELECT id, site FROM pt JOIN la ON round(pt.lon, 4) = round(la.lon, 4) AND round(pt.lat, 4) = round(la.lat, 4)), n AS (SELECT id, site FROM pt JOIN la ON abs(pt.lon - la.lon) < 0.01 AND abs(pt.lat - la.lat) < 0.01 WHERE id NOT IN (SELECT id FROM e) AND (pt.lon - la.lon) ** 2 + (pt.lat - la.lat) ** 2 < 0.0001
QUALIFY row_number() OVER (PARTITION BY id ORDER BY round((pt.lon - la.lon) ** 2 + (pt.lat - la.lat) ** 2, 12), site) = 1) SELECT id, site, true AS exact FROM e UNION ALL SELECT id, site, false FROM n""")
def c26_rounded_coordinates(spark, d):
    """Sites at the same rounded coordinates, else the nearest within a hundredth of a degree."""
    c, o = F.col("c_custkey"), read(spark, d, "orders")
    sites = read(spark, d, "customer").select(c.alias("site"), (c % 50 / 100).alias("slon"), (F.floor(c / 50) / 100).alias("slat"))
    k = F.col("o_custkey")
    pts = o.select(F.col("o_orderkey").alias("id"), (k % 50 / 100 + F.when(F.col("o_orderkey") % 3 == 0, 0.004).otherwise(0.00002)).alias("lon"), (F.floor(k / 50) / 100).alias("lat"))
    at = lambda x, y: F.struct(F.round(x, 4).alias("a"), F.round(y, 4).alias("b"))
    exact = pts.withColumn("at", at("lon", "lat")).join(sites.withColumn("at", at("slon", "slat")), "at").select("id", "site")
    left = pts.join(exact, "id", "left_anti").withColumn("cx", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor(F.col("lon") * 100) + i)))
    left = left.withColumn("cy", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor(F.col("lat") * 100) + i)))
    near = left.join(sites.withColumn("cx", F.floor(F.col("slon") * 100)).withColumn("cy", F.floor(F.col("slat") * 100)), ["cx", "cy"])
    d2 = F.pow(F.col("lon") - F.col("slon"), 2) + F.pow(F.col("lat") - F.col("slat"), 2)
    best = near.filter(d2 < 0.0001).groupBy("id").agg(F.min(F.struct(F.round(d2, 12).alias("d"), "site"))["site"].alias("site"))
    return exact.withColumn("exact", F.lit(True)).unionByName(best.withColumn("exact", F.lit(False)))


@query(f"""WITH {ALERTS}, f AS (SELECT 'f' || n_nationkey AS field, n_nationkey % 5 * 60 - 120.0::DOUBLE AS lon, n_nationkey // 5 * 30 - 60.0::DOUBLE AS lat FROM nation), h AS (SELECT field, id, 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(centroid_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(centroid_lat)) * pow(sin(radians(centroid_lon - lon) / 2), 2)))) AS m FROM f JOIN alerts ON abs(centroid_lon - lon) <= 3 AND abs(centroid_lat - lat) <= 3)
SELECT field, count(*) AS hits, round(min(m), 2) AS nearest FROM h WHERE m <= 250000 GROUP BY field""")
def c30_hits_near_fields(spark, d):
    """Alerts within 250 km of a field: met in cells of 3 degrees, then by great circle."""
    k = F.col("n_nationkey")
    f = read(spark, d, "nation").select(F.concat(F.lit("f"), k.cast("string")).alias("field"), (k % 5 * 60 - 120.0).alias("lon"), (F.floor(k / 5) * 30 - 60.0).alias("lat"))
    step, cell = F.array(*map(F.lit, (-1, 0, 1))), lambda c: F.floor(F.col(c) / 3)
    f = f.withColumn("cx", F.explode(F.transform(step, lambda i: cell("lon") + i))).withColumn("cy", F.explode(F.transform(step, lambda i: cell("lat") + i)))
    a = alerts(spark, d).withColumn("cx", cell("centroid_lon")).withColumn("cy", cell("centroid_lat"))
    h = f.join(a, ["cx", "cy"]).filter((F.abs(F.col("centroid_lon") - F.col("lon")) <= 3) & (F.abs(F.col("centroid_lat") - F.col("lat")) <= 3))
    h = h.withColumn("m", S.haversine_m(F.col("lat"), F.col("lon"), F.col("centroid_lat"), F.col("centroid_lon"))).filter("m <= 250000")
    return h.groupBy("field").agg(F.count("*").alias("hits"), F.round(F.min("m"), 2).alias("nearest"))


@query(f"""WITH {GRID}, {_REGION_SQL}, b AS (SELECT row, col, n_nationkey, n_nationkey % 9 / 10 AS confidence FROM grid JOIN nat ON {_INSIDE}) SELECT row, col, max(confidence) AS burned FROM b GROUP BY row, col""")
def i11_polygon_burn_in(spark, d):
    """Cells inside a polygon take its confidence, the highest where polygons overlap."""
    pts = grid(spark, d).select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    hit = spatial.points_in_polygons(pts, _regions(spark, d), 5.0)
    return hit.groupBy("row", "col").agg(F.max(F.col("n_nationkey") % 9 / 10).alias("burned"))


@query(f"""WITH RECURSIVE {RASTER}, c AS (SELECT row, col, (row * 1048576 + col)::BIGINT AS id FROM rast WHERE v >= 0.055), {_labels("c", _FOUR)}, cl AS (SELECT row, col, component FROM c JOIN lab USING (id)),
n AS (SELECT a.component, a.row, a.col, max(b.row = a.row - 1 AND b.col = a.col) AS n, max(b.row = a.row + 1 AND b.col = a.col) AS s, max(b.row = a.row AND b.col = a.col - 1) AS w, max(b.row = a.row AND b.col = a.col + 1) AS e,
 max(b.row = a.row - 1 AND b.col = a.col - 1) AS nw, max(b.row = a.row - 1 AND b.col = a.col + 1) AS ne, max(b.row = a.row + 1 AND b.col = a.col - 1) AS sw, max(b.row = a.row + 1 AND b.col = a.col + 1) AS se
 FROM cl a JOIN c b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL),
k AS (SELECT component, count(*) AS n_pixels, sum(4 - n::INT - s::INT - w::INT - e::INT)::BIGINT AS edges, sum(s::INT + e::INT)::BIGINT AS pairs, sum((s AND e AND se)::INT)::BIGINT AS quads,
 sum((NOT n AND NOT w)::INT + (NOT n AND NOT e)::INT + (NOT s AND NOT w)::INT + (NOT s AND NOT e)::INT + (n AND w AND NOT nw)::INT + (n AND e AND NOT ne)::INT + (s AND w AND NOT sw)::INT + (s AND e AND NOT se)::INT)::BIGINT AS n_corners,
 min(row)::INT AS top, min(col)::INT AS "left", max(row)::INT AS bottom, max(col)::INT AS "right" FROM n GROUP BY component HAVING count(*) >= 2)
SELECT component, n_pixels, edges, n_corners, 1 AS n_outer, 1 - (n_pixels - pairs + quads) AS n_holes, n_pixels::DOUBLE AS area, top, "left", bottom, "right", CASE WHEN n_pixels < 5 THEN 'small' WHEN n_pixels < 20 THEN 'medium' ELSE 'large' END AS size FROM k""")
def i10_d28_b21_polygons(spark, d):
    """Patches of two pixels or more as polygons with holes; box, holes and corners are read from their rings."""
    p, n = G.polygons(raster(spark, d).filter("v >= 0.055").select("row", "col"), 4, 2), F.col("n_pixels")
    ring = lambda c: F.transform(F.flatten("outer"), lambda q: q[c])
    return p.select(
        "component", "n_pixels", "edges", "n_corners", F.size("outer").alias("n_outer"), F.size("holes").cast("long").alias("n_holes"), F.col("area").cast("double").alias("area"), F.array_min(ring("y")).alias("top"), F.array_min(ring("x")).alias("left"),
        (F.array_max(ring("y")) - 1).alias("bottom"), (F.array_max(ring("x")) - 1).alias("right"), F.when(n < 5, "small").when(n < 20, "medium").otherwise("large").alias("size"),
    )


@query(f"""WITH {GRID}, {_REGION_SQL}, t AS (SELECT row, col, v, 1 AS tile FROM grid WHERE row < 40 UNION ALL SELECT row, col, v + 1, 2 FROM grid WHERE row >= 24), m AS (SELECT row, col, arg_min(v, tile) AS v FROM t GROUP BY ALL) SELECT row, col, v FROM m WHERE EXISTS (SELECT 1 FROM nat WHERE {_INSIDE})""")
def i15_mosaic_and_clip(spark, d):
    """The first tile wins where tiles overlap; cells outside all regions go."""
    g = grid(spark, d)
    t = g.filter("row < 40").select("row", "col", "v", F.lit(1).alias("tile")).unionByName(g.filter("row >= 24").select("row", "col", (F.col("v") + 1).alias("v"), F.lit(2).alias("tile")))
    m = t.groupBy("row", "col").agg(F.min_by("v", "tile").alias("v")).withColumn("x", F.col("col").cast("double")).withColumn("y", F.col("row").cast("double"))
    return m.join(spatial.points_in_polygons(m, _regions(spark, d), 5.0).select("row", "col").distinct(), ["row", "col"], "left_semi").select("row", "col", "v")


@query("WITH c AS (SELECT DISTINCT l_suppkey AS beat, l_suppkey % 7 AS range, l_orderkey % 64 AS row, l_partkey % 64 AS col FROM lineitem) SELECT range::BIGINT AS range, count(DISTINCT beat) AS beats, count(DISTINCT row * 64 + col) AS cells, count(*) - count(DISTINCT row * 64 + col) AS shared FROM c GROUP BY range")
def i23_dissolve(spark, d):
    """Beats united to ranges as sets of cells; cells of several beats count once."""
    li, cell = read(spark, d, "lineitem"), (F.col("l_orderkey") % 64) * 64 + F.col("l_partkey") % 64
    c = li.select(F.col("l_suppkey").alias("beat"), (F.col("l_suppkey") % 7).alias("range"), cell.alias("cell")).distinct()
    united = c.groupBy("range", "cell").agg(F.count("*").alias("n"))
    beats = c.groupBy("range").agg(F.countDistinct("beat").alias("beats"))
    return united.groupBy("range").agg(F.count("*").alias("cells"), (F.sum("n") - F.count("*")).alias("shared")).join(beats, "range")


@query(f"""WITH {GRID}, {_REGION_SQL}, h AS (SELECT n_nationkey, row, col, row_number() OVER (PARTITION BY n_nationkey ORDER BY (row * 48271 + col * 16807) % 9973, row, col) AS r FROM grid JOIN nat ON {_INSIDE}) SELECT n_nationkey, row, col FROM h WHERE r <= 5""")
def i24_sampled_points(spark, d):
    """Five points of each region in a fixed pseudorandom order."""
    pts = grid(spark, d).select("row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    hit = spatial.points_in_polygons(pts, _regions(spark, d), 5.0)
    w = Window.partitionBy("n_nationkey").orderBy((F.col("row") * 48271 + F.col("col") * 16807) % 9973, "row", "col")
    return hit.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("n_nationkey", "row", "col")


@query(f"""WITH {GRID}, c AS (SELECT row, col, (n % 6)::BIGINT AS class FROM grid), m AS (SELECT row // 3 AS r, col // 3 AS c, class, count(*) AS n FROM c GROUP BY ALL), w AS (SELECT r, c, class FROM m QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY n DESC, class) = 1),
a AS (SELECT class, count(*) AS n FROM c GROUP BY 1), b AS (SELECT class, count(*) AS blocks FROM w GROUP BY 1) SELECT class, n, n * 0.01::DOUBLE AS area_ha, floor(100.0::DOUBLE * n / sum(n) OVER () * 1e6 + 0.5) / 1e6 AS pct, coalesce(blocks, 0) AS blocks FROM a LEFT JOIN b USING (class)""")
def d34_cover_by_class(spark, d):
    """Area and share of each class, and the 3 by 3 blocks in which it is the most frequent (the smaller of equal ones)."""
    c = grid(spark, d).select("row", "col", (F.col("n") % 6).alias("class"))
    m = c.groupBy(F.floor(F.col("row") / 3).alias("r"), F.floor(F.col("col") / 3).alias("c"), "class").agg(F.count("*").alias("n"))
    mode = m.groupBy("r", "c").agg(F.min(F.struct((-F.col("n")).alias("n"), "class"))["class"].alias("class")).groupBy("class").agg(F.count("*").alias("blocks"))
    a = c.groupBy("class").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # of a row a class
    return a.withColumn("pct", half_up(100.0 * F.col("n") / total, "pct")).join(mode, "class", "left").select("class", "n", (F.col("n") * 0.01).alias("area_ha"), "pct", F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query(f"""WITH {BOXES} SELECT id, round(111320 * cos(radians(y % 180 - 90)), 4) AS metres_lon, floor(x * 1000 / 30)::BIGINT AS col, floor((180000 - y * 1000) / 30)::BIGINT AS row, round(16 * 111320 * (111320 * cos(radians(y % 180 - 90))) / 10000, 2) AS area_ha,
4 AS n_points, x AS first_x, 16.0::DOUBLE AS area FROM bx""")
def h10_h11_h16_local_metres(spark, d):
    """Metres in a degree, rows and columns by an affine inverse, areas, and rings read from well-known text."""
    x, y = F.col("x"), F.col("y")
    text = F.concat(F.lit("POLYGON (("), F.array_join(F.array(*(F.concat_ws(" ", (x + i).cast("string"), (y + j).cast("string")) for i, j in ((0, 0), (4, 0), (4, 4), (0, 4)))), ", "), F.lit("))"))
    b = boxes(spark, d).withColumn("ring", S.wkt_ring(text))
    metres = 111320 * F.cos(F.radians(y % 180 - 90))
    return b.select(
        "id", F.round(metres, 4).alias("metres_lon"), F.floor(x * 1000 / 30).alias("col"), F.floor((180000 - y * 1000) / 30).alias("row"), F.round(16 * 111320 * metres / 10000, 2).alias("area_ha"),
        F.size("ring").alias("n_points"), F.col("ring")[0]["x"].alias("first_x"), F.round(S.ring_area(F.col("ring")), 6).alias("area"),
    )


@query("WITH n AS (SELECT DISTINCT n_name AS name, n_nationkey AS k FROM nation), q AS (SELECT unnest(['an', 'zzz', 'UNITED']) AS part), h AS (SELECT part, name FROM q JOIN n ON contains(upper(name), upper(part))), f AS (SELECT part, name FROM q, n WHERE k < 5 AND part NOT IN (SELECT part FROM h)) SELECT part, name, true AS matched FROM h UNION ALL SELECT part, name, false FROM f")
def b25_name_lookup(spark, d):
    """Regions whose name contains a text; a text that none contains takes those of the box instead."""
    n = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    q = n.limit(1).select(F.explode(F.array(*map(F.lit, ("an", "zzz", "UNITED")))).alias("part"))
    h = q.join(n, F.contains(F.upper("name"), F.upper("part"))).select("part", "name")
    rest = q.join(h, "part", "left_anti").join(n.filter("k < 5"), F.lit(True)).select("part", "name")
    return h.withColumn("matched", F.lit(True)).unionByName(rest.withColumn("matched", F.lit(False)))


@query(f"""WITH {GRID}, t AS (SELECT row // 16 AS tr, col // 16 AS tc, sum(CASE WHEN n % 40 = 0 THEN 1 ELSE 0 END) AS s, count(*) AS n FROM grid GROUP BY ALL) SELECT tr::BIGINT AS tr, tc::BIGINT AS tc, s::BIGINT AS burned, s * 200 >= n AS chip_valid, s * 100 >= n AS window_valid FROM t""")
def b24_sparse_windows(spark, d):
    """Chips with a mean below 0.005 and windows below 0.01 are too sparse."""
    t = grid(spark, d).groupBy(F.floor(F.col("row") / 16).alias("tr"), F.floor(F.col("col") / 16).alias("tc")).agg(F.count(F.when(F.col("n") % 40 == 0, 1)).alias("burned"), F.count("*").alias("n"))
    return t.select("tr", "tc", "burned", (F.col("burned") * 200 >= F.col("n")).alias("chip_valid"), (F.col("burned") * 100 >= F.col("n")).alias("window_valid"))
