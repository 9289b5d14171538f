"""Queries over gridded cells, polygons and points: focal sums, morphology, patches, terrain, spatial joins, clusters."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grid as G
from ..operators import hulls, spatial
from ..operators.grid import persist_table
from ..operators.quantiles import with_quantiles
from .registry import GRID, RASTER, grid, half_up, query, r6, raster, read, side, windows

MASK = "v >= 0.052"


def _near(r: int, source: str = "rast", value: str = "v") -> str:
    """Sums over squares, by cells that tell their neighbours."""
    return f"(SELECT row, col, sum(v) AS s, sum(v * v) AS ss, count(*) FILTER (m) AS n FROM (SELECT row + unnest(range(-{r}, {r + 1})) AS row, col, {value} AS v, m FROM (SELECT row, col + unnest(range(-{r}, {r + 1})) AS col, {value}, m FROM {source})) GROUP BY ALL)"


_MASKED = f"{RASTER}, r AS (SELECT *, v >= 0.052 AS m FROM rast)"


@query(f"""WITH {_MASKED}, a AS {_near(1, "r")}, b AS {_near(2, "r")}, c AS {_near(3, "r")} SELECT row, col, round(a.s / 9, 6) AS mean3, round(b.s / 25, 6) AS mean5, round(c.s / 49, 6) AS mean7,
 round(sqrt(greatest(a.ss / 9 - pow(a.s / 9, 2), 0)), 6) AS std3, round(sqrt(greatest(c.ss / 49 - pow(c.s / 49, 2), 0)), 6) AS std7,
 v >= 0.06 OR (a.s / 9 >= 0.052 AND b.s / 25 >= 0.05) AS detected, least(8, a.n - m::INT)::BIGINT AS neighbours FROM r JOIN a USING (row, col) JOIN b USING (row, col) JOIN c USING (row, col)""")
def i1_i2_focal(spark, d):
    g = G.focal_table(raster(spark, d).withColumn("m", F.expr(MASK)), "v", "m")
    mean = lambda k: F.round(f"mean{k}", 12)  # noqa: E731  a mean that is the threshold reaches it, whatever its sum of doubles lost; others are further away
    return g.select("row", "col", *(r6(F.col(c), c) for c in ("mean3", "mean5", "mean7", "std3", "std7")), ((F.col("v") >= 0.06) | ((mean(3) >= 0.052) & (mean(5) >= 0.05))).alias("detected"), F.least(F.lit(8), "neighbours").cast("long").alias("neighbours"))


def _around(source: str, test: str) -> str:
    return f"(SELECT g.row, g.col, {test} AS m FROM rast g LEFT JOIN (SELECT row + unnest([-1, 0, 1]) AS row, col, m FROM (SELECT row, col + unnest([-1, 0, 1]) AS col, m FROM {source})) x USING (row, col) GROUP BY g.row, g.col)"


_MORPH = f"m AS (SELECT row, col, v >= {{t}} AS m FROM rast), er AS {_around('m', 'count(*) FILTER (m) = 9')}, op AS {_around('er', 'count(*) FILTER (m) > 0')}, di AS {_around('m', 'count(*) FILTER (m) > 0')}, cl AS {_around('di', 'count(*) FILTER (m) = 9')}"


@query(f"WITH {RASTER}, {_MORPH.format(t=0.03)} SELECT op.row, op.col, op.m AS opened, cl.m AS closed FROM op JOIN cl USING (row, col)")
def i3_i4_morphology(spark, d):
    def kernel(there, x):
        m = x["m"] > 0
        return {"opened": G.grown(G.shrunk(m) & there), "closed": G.shrunk(G.grown(m) & there)}

    g = raster(spark, d).select("row", "col", (F.col("v") >= 0.03).alias("m"))
    return G.tiled(g, 2, kernel, ["m"], "opened boolean, closed boolean").select("row", "col", "opened", "closed")


def _component_sql(mask: str, adjacent: str) -> str:
    return f"""WITH RECURSIVE {GRID}, c AS (SELECT row, col, v, q, (row * 1048576 + col)::BIGINT AS id FROM grid WHERE {mask}), e AS (SELECT a.id AS x, b.id AS y FROM c a JOIN c b ON {adjacent}),
reach AS (SELECT id AS x, id AS root FROM c UNION SELECT e.y, r.root FROM reach r JOIN e ON e.x = r.x WHERE r.root < e.y), lab AS (SELECT x, min(root) AS component FROM reach GROUP BY x)"""


_FOUR = "abs(a.row - b.row) + abs(a.col - b.col) = 1"
_EIGHT = "greatest(abs(a.row - b.row), abs(a.col - b.col)) = 1"


@query(_component_sql("v >= 0.052", _FOUR) + " SELECT row, col, component FROM c JOIN lab ON c.id = lab.x")
def i5_components(spark, d):
    return G.components(grid(spark, d).filter(MASK))


@query(_component_sql("v >= 0.054", _EIGHT) + " SELECT component, count(*) AS n_pixels, round(avg(v), 6) AS mean_v, round(avg(row), 6) AS centre_row, round(avg(col), 6) AS centre_col, round(max(q), 6) AS top_q, round(count(*) * 0.01::DOUBLE, 4) AS area_ha FROM c JOIN lab ON c.id = lab.x GROUP BY component HAVING count(*) >= 5")
def i6_i8_c24_patches(spark, d):
    aggs = [r6(F.avg("v"), "mean_v"), r6(F.avg("row"), "centre_row"), r6(F.avg("col"), "centre_col"), r6(F.max("q"), "top_q"), F.round(F.count("*") * 0.01, 4).alias("area_ha")]
    return G.patches(grid(spark, d), F.col("v") >= 0.054, 5, aggs, 8)


def _labels(cells: str, adjacent: str) -> str:
    """Smallest id reachable for each cell of ``cells`` (row, col, id)."""
    return f"""e AS (SELECT a.id AS x, b.id AS y FROM {cells} a JOIN {cells} b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND {adjacent}),
reach AS (SELECT id AS x, id AS root FROM {cells} UNION SELECT e.y, r.root FROM reach r JOIN e ON e.x = r.x WHERE r.root < e.y), lab AS (SELECT x AS id, min(root) AS component FROM reach GROUP BY x)"""


@query(f"""WITH RECURSIVE {RASTER}, m AS (SELECT row, col, v * v * v * v * 10000 >= 0.32 AS m FROM rast), di AS {_around("m", "count(*) FILTER (m) > 0")}, cl AS {_around("di", "count(*) FILTER (m) = 9")},
c AS (SELECT row, col, v * v * v * v * 10000 AS v, (row * 1048576 + col)::BIGINT AS id FROM cl JOIN rast USING (row, col) WHERE m), {_labels("c", _FOUR)} SELECT row, col, component, round(v, 6) AS v FROM c JOIN lab USING (id) QUALIFY count(*) OVER (PARTITION BY component) >= 5 AND max(v) OVER (PARTITION BY component) >= 0.64""")
def i7_hysteresis(spark, d):
    """Seed at half the threshold, close, drop small, keep what reaches the threshold."""
    v = F.col("v")
    return G.hysteresis(raster(spark, d).withColumn("v", v * v * v * v * 10000), "v", 0.64).select("row", "col", "component", r6(v, "v"))


@query(f"""WITH {RASTER}, g AS (SELECT row, col, round(v * 1000) AS z FROM rast), l AS (SELECT g.row, g.col, coalesce(w.z, g.z) AS w, g.z AS c, coalesce(e.z, g.z) AS e FROM g LEFT JOIN g w ON w.row = g.row AND w.col = g.col - 1 LEFT JOIN g e ON e.row = g.row AND e.col = g.col + 1),
p AS (SELECT l.row, l.col, l.w, l.e, coalesce(n.w, l.w) AS nw, coalesce(n.c, l.c) AS nc, coalesce(n.e, l.e) AS ne, coalesce(s.w, l.w) AS sw, coalesce(s.c, l.c) AS sc, coalesce(s.e, l.e) AS se FROM l LEFT JOIN l n ON n.row = l.row - 1 AND n.col = l.col LEFT JOIN l s ON s.row = l.row + 1 AND s.col = l.col),
q AS (SELECT row, col, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 240.0::DOUBLE AS dx, ((sw + 2 * sc + se) - (nw + 2 * nc + ne)) / 240.0::DOUBLE AS dy FROM p) SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 5) AS slope, round((degrees(atan2(dy, -dx)) + 360) % 360, 5) AS aspect FROM q""")
def i13_slope(spark, d):
    return G.horn(raster(spark, d).select("row", "col", F.round(F.col("v") * 1000).alias("z")), "z", 30.0).select("row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 5).alias("aspect"))


@query(f"WITH {GRID}, t AS (SELECT row, col, v, n, unnest(range(greatest(0, ceil((row - 15) / 12.0)::BIGINT), row // 12 + 1)) AS tile_row FROM grid), u AS (SELECT *, unnest(range(greatest(0, ceil((col - 15) / 12.0)::BIGINT), col // 12 + 1)) AS tile_col FROM t) SELECT tile_row::INT AS tile_row, tile_col::INT AS tile_col, count(*) AS cells, round(avg(v), 6) AS mean_v FROM u GROUP BY ALL")
def i17_i19_tiles(spark, d):
    return G.tile_ids(grid(spark, d), 16, 4).groupBy("tile_row", "tile_col").agg(F.count("*").alias("cells"), r6(F.avg("v"), "mean_v"))


@query(f"WITH {GRID}, t AS (SELECT row, col, v, unnest(range(greatest(0, ceil((row - 15) / 12.0)::BIGINT), row // 12 + 1)) AS tr FROM grid), u AS (SELECT *, unnest(range(greatest(0, ceil((col - 15) / 12.0)::BIGINT), col // 12 + 1)) AS tc FROM t) SELECT row, col, floor(any_value(v) * sum(10 + (tr + tc) % 3)::DOUBLE / (10 * count(*)) * 1e6 + 0.5) / 1e6 AS blended, count(*) AS hits FROM u GROUP BY row, col")
def i18_overlap_blend(spark, d):
    """A tile's prediction is the cell's value times 1, 1.1 or 1.2, by tile; weights are summed as whole tenths."""
    t = G.tile_ids(grid(spark, d), 16, 4).withColumn("p", 10 + (F.col("tile_row") + F.col("tile_col")) % 3)
    return t.groupBy("row", "col").agg(half_up(F.any_value("v") * F.sum("p") / (10 * F.count("*")), "blended"), F.count("*").alias("hits"))


@query(f"WITH {RASTER}, m AS (SELECT row AS r, col AS c FROM rast WHERE q >= 49) SELECT row, col, round(sqrt(min((row - r) * (row - r) + (col - c) * (col - c))), 6) AS distance FROM rast, m GROUP BY row, col")
def i9_distance(spark, d):
    """Cells to the nearest cell of the highest quantities, which are few and far."""
    g = raster(spark, d)
    return G.distance_to_set(g.select("row", "col"), g.filter("q >= 49")).select("row", "col", r6(F.col("distance"), "distance"))


@query(f"WITH {RASTER}, p AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM rast WHERE v > 0) SELECT row, col, round(greatest(0, least(1, (v - lo) / (hi - lo))), 6) AS stretched FROM rast, p")
def i20_percentile_stretch(spark, d):
    g = with_quantiles(raster(spark, d), "v", {"lo": 0.02, "hi": 0.98}, F.col("v") > 0)
    return g.select("row", "col", r6(S.clip((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0), "stretched"))


@query(f"WITH {GRID} SELECT row // 3 AS block_row, col // 3 AS block_col, round(avg(v), 6) AS mean_v, round(max(q), 6) AS top_q, count(*) AS n, CASE WHEN row // 3 < 11 THEN 'n' ELSE 's' END AS half FROM grid GROUP BY ALL")
def i16_i25_blocks(spark, d):
    r, c = F.floor(F.col("row") / 3).cast("int"), F.floor(F.col("col") / 3).cast("int")
    return grid(spark, d).groupBy(r.alias("block_row"), c.alias("block_col")).agg(r6(F.avg("v"), "mean_v"), r6(F.max("q"), "top_q"), F.count("*").alias("n")).withColumn("half", F.when(F.col("block_row") < 11, "n").otherwise("s"))


_TARGET = "(SELECT s * 3 // 5 AS h, s * 2 // 7 AS w FROM side)"


def _target(spark, d) -> tuple[tuple[int, int], tuple[int, int]]:
    s = side(spark, d)
    return (s, s), (s * 3 // 5, s * 2 // 7)


@query(f"WITH {RASTER}, t AS (SELECT unnest(range(h)) AS row, h, w FROM {_TARGET}), u AS (SELECT row, unnest(range(w)) AS col, h, w FROM t) SELECT u.row::INT AS row, u.col::INT AS col, v FROM u, side LEFT JOIN rast ON rast.row = ((2 * u.row + 1) * s) // (2 * h) AND rast.col = ((2 * u.col + 1) * s) // (2 * w)")
def i16_nearest(spark, d):
    return G.resample_nearest(raster(spark, d), "v", *_target(spark, d))


@query(f"""WITH {RASTER}, t AS (SELECT unnest(range(h)) AS row, h, w FROM {_TARGET}), u AS (SELECT row, unnest(range(w)) AS col, h, w, s FROM t, side), o AS (SELECT *, (2 * row + 1) * s - h AS orow, (2 * col + 1) * s - w AS ocol FROM u),
k AS (SELECT *, floor(orow / (2.0::DOUBLE * h))::BIGINT AS lr, floor(ocol / (2.0::DOUBLE * w))::BIGINT AS lc FROM o),
a AS (SELECT row, col, s, greatest(0, least(s - 1, lr + i)) AS r, greatest(0, least(s - 1, lc + j)) AS c, (CASE i WHEN 0 THEN 2 * h * (lr + 1) - orow ELSE orow - 2 * h * lr END) * (CASE j WHEN 0 THEN 2 * w * (lc + 1) - ocol ELSE ocol - 2 * w * lc END) AS wt FROM k, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT a.row::INT AS row, a.col::INT AS col, round(sum(wt * v) / sum(wt) FILTER (v IS NOT NULL), 6) AS v FROM a LEFT JOIN rast ON rast.row = r AND rast.col = c WHERE wt > 0 GROUP BY a.row, a.col""")
def i16_bilinear(spark, d):
    return G.resample_bilinear(raster(spark, d), "v", *_target(spark, d)).select("row", "col", r6(F.col("v"), "v"))


@query(f"WITH {RASTER}, k AS (SELECT ((2 * row + 1) * h) // (2 * s) AS row, ((2 * col + 1) * w) // (2 * s) AS col, n % 5 AS kind FROM rast, side, {_TARGET}), c AS (SELECT row, col, kind, count(*) AS n FROM k GROUP BY ALL) SELECT row::INT AS row, col::INT AS col, arg_min(kind, (-n, kind)) AS kind FROM c GROUP BY row, col")
def i16_mode(spark, d):
    return G.resample_mode(raster(spark, d).withColumn("kind", F.col("n") % 5), "kind", *_target(spark, d))


@query(f"WITH {GRID}, f AS (SELECT row, col FROM grid WHERE v >= 0.08), s AS (SELECT row + dr AS row, col + dc AS col FROM f, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc) WHERE dr * dr + dc * dc <= 4) SELECT DISTINCT row::INT AS row, col::INT AS col FROM s WHERE (row, col) IN (SELECT (row, col) FROM grid)")
def i12_disc_burn_in(spark, d):
    g = grid(spark, d)
    return G.nearest_set(g.select("row", "col"), g.filter("v >= 0.08"), 2).filter("distance is not null").select("row", "col")


@query(f"WITH {GRID}, f AS (SELECT row * 64 + col AS id, row, col FROM grid WHERE v >= 0.07), near AS (SELECT f.id, max(g.q >= 26)::BOOLEAN AS near, max(CASE WHEN g.row = f.row AND g.col = f.col THEN g.q END) AS here FROM f JOIN grid g ON abs(g.row - f.row) <= 1 AND abs(g.col - f.col) <= 1 GROUP BY f.id) SELECT id, near AS near_forest, here >= 26 AS in_forest FROM near")
def c22_c23_pixel_lookup(spark, d):
    g = grid(spark, d)
    f = g.filter("v >= 0.07").select((F.col("row") * 64 + F.col("col")).alias("id"), "row", "col")
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = f.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step)).select("id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), ((F.col("dr") == 0) & (F.col("dc") == 0)).alias("here"))
    x = around.join(g.select("row", "col", "q"), ["row", "col"])
    return x.groupBy("id").agg(F.max(F.col("q") >= 26).alias("near_forest"), (F.max(F.when(F.col("here"), F.col("q"))) >= 26).alias("in_forest"))


def _regions(spark, d) -> DataFrame:
    """Triangles and boxes, one a nation."""
    n, x, y = read(spark, d, "nation"), F.col("n_nationkey") % 5 * 14.0, F.floor(F.col("n_nationkey") / 5) * 14.0
    p = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.when(F.col("n_nationkey") % 2 == 0, F.array(p(0.5, 0.5), p(9.5, 0.5), p(9.5, 9.5), p(0.5, 9.5))).otherwise(F.array(p(0.5, 0.5), p(12.5, 0.5), p(0.5, 12.5)))
    return n.select("n_nationkey", "n_name", ring.alias("ring"))


_REGION_SQL = "nat AS (SELECT n_nationkey, n_name, (n_nationkey % 5) * 14.0 AS x, (n_nationkey // 5) * 14.0 AS y FROM nation)"
_INSIDE = "(n_nationkey % 2 = 0 AND col > x + 0.5 AND col < x + 9.5 AND row > y + 0.5 AND row < y + 9.5) OR (n_nationkey % 2 = 1 AND col > x + 0.5 AND row > y + 0.5 AND (col - x - 0.5) + (row - y - 0.5) < 12)"


@query(f"WITH {GRID}, {_REGION_SQL} SELECT n_nationkey, count(*) AS n_points, round(avg(v), 6) AS mean_v FROM grid JOIN nat ON {_INSIDE} GROUP BY n_nationkey")
def c1_h13_points_in_polygons(spark, d):
    pts = grid(spark, d).select(F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "v")
    return spatial.points_in_polygons(pts, _regions(spark, d), 5.0).groupBy("n_nationkey").agg(F.count("*").alias("n_points"), r6(F.avg("v"), "mean_v"))


@query(f"WITH {GRID}, {_REGION_SQL}, h AS (SELECT row * 64 + col AS id, min(n_nationkey) AS k FROM grid JOIN nat ON {_INSIDE} GROUP BY ALL) SELECT g.row * 64 + g.col AS id, coalesce(n.n_name, '—') AS n_name FROM grid g LEFT JOIN h ON h.id = g.row * 64 + g.col LEFT JOIN nation n ON n.n_nationkey = h.k")
def c3_region_lookup(spark, d):
    pts = grid(spark, d).select((F.col("row") * 64 + F.col("col")).alias("id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    return spatial.first_region(pts, _regions(spark, d), 5.0, "id", "n_name", "n_nationkey").select("id", "n_name")


@query("WITH t AS (SELECT n_nationkey, 81.0 AS a, 72.0 AS b FROM nation) SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN a ELSE b END::DOUBLE AS area FROM t")
def h12_ring_area(spark, d):
    return _regions(spark, d).select("n_nationkey", F.round(S.ring_area(F.col("ring")), 6).alias("area"))


#: Alert patches are cells around each supplier's place under a mask of the quantity, true patches those under a stricter
#: mask, one row off. Places spread over a square that grows with the suppliers, so patches meet their neighbours only.
_SETS_SQL = """z AS (SELECT 6 * floor(sqrt(count(*)))::BIGINT AS s FROM supplier),
a AS (SELECT DISTINCT l_suppkey AS a_id, l_suppkey * 7919 % s + l_orderkey % 12 AS row, l_suppkey * 104729 % 99991 % s + l_partkey % 12 AS col FROM lineitem, z WHERE l_quantity < 12),
b AS (SELECT DISTINCT l_suppkey AS b_id, l_suppkey * 7919 % s + l_orderkey % 11 + 1 AS row, l_suppkey * 104729 % 99991 % s + l_partkey % 12 AS col FROM lineitem, z WHERE l_quantity < 5),
sh AS (SELECT a_id, b_id, count(*) AS shared FROM a JOIN b ON a.row = b.row AND a.col = b.col GROUP BY ALL), sa AS (SELECT a_id, count(*) AS n FROM a GROUP BY 1), sb AS (SELECT b_id, count(*) AS m FROM b GROUP BY 1),
pairs AS (SELECT a_id, b_id, shared, shared / (n + m - shared) AS iou, shared / least(n, m) AS overlap FROM sh JOIN sa USING (a_id) JOIN sb USING (b_id))"""


def _sets(spark, d):
    li, s = read(spark, d, "lineitem"), 6 * isqrt(read(spark, d, "supplier").count())
    k = F.col("l_suppkey")
    row, col = k * 7919 % s, k * 104729 % 99991 % s + F.col("l_partkey") % 12
    a = li.filter("l_quantity < 12").select(k.alias("a_id"), (row + F.col("l_orderkey") % 12).alias("row"), col.alias("col")).distinct()
    b = li.filter("l_quantity < 5").select(k.alias("b_id"), (row + F.col("l_orderkey") % 11 + 1).alias("row"), col.alias("col")).distinct()
    return a, b


@query(f"WITH {_SETS_SQL} SELECT a_id, b_id, shared, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.1 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY iou DESC, b_id) = 1")
def c6_h15_best_iou(spark, d):
    a, b = _sets(spark, d)
    return spatial.best_matches(spatial.cell_overlaps(a, b, "a_id", "b_id"), "a_id", "b_id", 0.1).select("a_id", "b_id", "shared", r6(F.col("iou"), "iou"))


@query(f"WITH {_SETS_SQL} SELECT DISTINCT a_id FROM a WHERE a_id NOT IN (SELECT a_id FROM pairs WHERE iou >= 0.24)")
def g5_unmatched(spark, d):
    a, b = _sets(spark, d)
    return a.select("a_id").distinct().join(spatial.cell_overlaps(a, b, "a_id", "b_id").filter("iou >= 0.24").select("a_id"), "a_id", "left_anti")


#: Patches on one small raster, where nearly every pair overlaps.
_DENSE_SQL = "a AS (SELECT DISTINCT l_suppkey AS a_id, (l_orderkey % 12)::INT AS row, (l_partkey % 12)::INT AS col FROM lineitem WHERE l_quantity < 12), sa AS (SELECT a_id, count(*) AS n FROM a GROUP BY 1)"


@query(f"WITH {_DENSE_SQL}, x AS (SELECT a1.a_id AS newer, a2.a_id AS older, count(*) AS shared FROM a a1 JOIN a a2 ON a1.row = a2.row AND a1.col = a2.col AND a1.a_id > a2.a_id AND a1.a_id % 2 <> a2.a_id % 2 GROUP BY ALL) SELECT newer, min(older) AS older FROM x JOIN sa s ON newer = s.a_id JOIN sa t ON older = t.a_id WHERE shared / least(s.n, t.n) >= 0.3 GROUP BY newer")
def c5_link_overlaps(spark, d):
    """Patches of different versions that share 0.3 of the smaller one: each links to the oldest that it overlaps."""
    at = [(F.col("l_orderkey") % 12).cast("int").alias("row"), (F.col("l_partkey") % 12).cast("int").alias("col")]
    a = read(spark, d, "lineitem").filter("l_quantity < 12").select(F.col("l_suppkey").alias("a_id"), *at).distinct()
    return spatial.oldest_overlaps(a, "a_id", 0.3, F.expr("newer % 2 <> older % 2"))


@query(f"""WITH RECURSIVE {_SETS_SQL}, good AS (SELECT a_id, b_id, iou, (a_id * 37 % 101) / 101 AS score FROM pairs WHERE iou >= 0.02), turn AS (SELECT a_id, row_number() OVER (ORDER BY any_value(score) DESC, a_id) AS i FROM good GROUP BY a_id),
r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS a_id, []::BIGINT[] AS taken, NULL::BIGINT AS b_id UNION ALL
 SELECT i, a_id, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick FROM (SELECT turn.i, turn.a_id, r.taken, (SELECT arg_max(g.b_id, (g.iou, -g.b_id)) FROM good g WHERE g.a_id = turn.a_id AND NOT list_contains(r.taken, g.b_id)) AS pick FROM r JOIN turn ON turn.i = r.i + 1))
SELECT r.a_id, r.b_id, round(iou, 6) AS iou FROM r JOIN good ON good.a_id = r.a_id AND good.b_id = r.b_id""")
def c7_greedy_matches(spark, d):
    """One-to-one by falling score; the SQL goes key by key."""
    a, b = _sets(spark, d)
    pairs = spatial.cell_overlaps(a, b, "a_id", "b_id").withColumn("score", (F.col("a_id") * 37 % 101) / 101)
    return spatial.greedy_matches(pairs, "a_id", "b_id", "score", 0.02).select("a_id", "b_id", r6(F.col("iou"), "iou"))


def _points(spark, d):
    e = windows(spark, d)
    return e.select("event_id", (F.col("pixel") + F.col("event_id") % 7 / 10).alias("x"), (F.col("event_id") * 7919 % 99991 / 10).alias("y"), "value", "date", "event_type")


_POINTS = "pts AS (SELECT event_id, user_id + (event_id % 7) / 10.0::DOUBLE AS x, (event_id * 7919 % 99991) / 10.0::DOUBLE AS y, value, event_type FROM events)"


@query(f"""WITH RECURSIVE {_POINTS}, near AS (SELECT a.event_id AS a, b.event_id AS b FROM pts a JOIN pts b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 6.25), core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 4),
e AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), reach AS (SELECT id AS x, id AS root FROM core UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.x WHERE r.root < e.b),
lab AS (SELECT x, min(root) AS cluster FROM reach GROUP BY x), bord AS (SELECT a, min(cluster) AS cluster FROM near JOIN lab ON near.b = lab.x GROUP BY a)
SELECT event_id, coalesce(lab.cluster, bord.cluster, -1) AS cluster FROM pts LEFT JOIN lab ON lab.x = event_id LEFT JOIN bord ON bord.a = event_id""")
def i21_density_clusters(spark, d):
    return spatial.density_clusters(_points(spark, d).select("event_id", "x", "y"), "event_id", 2.5, 4)


@query(f"WITH {_POINTS}, o AS (SELECT x, y FROM pts WHERE event_type = 'error') SELECT p.event_id, round(min(sqrt((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y))), 6) AS distance FROM pts p JOIN o ON (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) <= 25 GROUP BY p.event_id")
def c9_nearest_distance(spark, d):
    p = _points(spark, d)
    return spatial.nearest_within(p.select("event_id", "x", "y"), p.filter("event_type = 'error'").select("x", "y"), "event_id", 5.0).select("event_id", r6(F.col("distance"), "distance"))


def _detections(spark, d):
    """Detections of a few fires over weeks: places in steps of 375 m around a drifting centre."""
    e = windows(spark, d)
    week, k = F.floor(F.datediff("date", F.lit("2024-01-01").cast("date")) / 7), F.col("event_id")
    step = lambda m, n: (k * m % 9973 % n) * 0.0034
    return e.select(
        (F.col("pixel") % 5).alias("fire"), F.date_add(F.lit("2024-01-01").cast("date"), (week * 7).cast("int")).alias("seen"), (80.1 + F.col("pixel") % 5 * 0.3 + week * 0.01 + step(7919, 19)).alias("lon"), (24.0 + step(104729, 17)).alias("lat"), "value",
    )


@query()
def i22_e15_perimeters_and_spread(spark, d):
    """Concave perimeters a fire and week, and how they spread; hulls are tested against all circumcircles, spread against a loop."""
    p = persist_table(hulls.measured(hulls.concave_hulls(_detections(spark, d), ["fire", "seen"], "lon", "lat", "value", 0.0005, 0.006)), "perimeters")
    s = hulls.spread(p, "fire", "seen")
    return p.select("fire", "seen", "n_pixels", F.size("rings").alias("n_rings"), *(F.round(c, 4).alias(c) for c in ("mean_frp", "area_km2", "perimeter_km")), *(F.round(c, 5).alias(c) for c in ("centre_lon", "centre_lat"))).join(s, ["fire", "seen"], "left")
