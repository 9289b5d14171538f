"""Spatial joins by grid cells: points in polygons, overlaps of cell sets, nearest points, density clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import in_ring
from .grid import min_labels, persist_table, remove_tables


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def polygon_cells(polygons: DataFrame, size: float) -> DataFrame:
    """One row per grid cell that the ring's bounding box touches: cx, cy."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.sequence(cell(F.array_min(v), size), cell(F.array_max(v), size))
    return polygons.withColumn("cx", F.explode(span(xs))).withColumn("cy", F.explode(span(ys)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """Points (x, y) with the polygons (ring) that hold them: an equi-join on cells, then exact ray casting."""
    p = points.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    hit = p.join(polygon_cells(polygons, size), ["cx", "cy"]).filter(in_ring(F.col("x"), F.col("y"), F.col("ring"))).drop("cx", "cy", "ring")
    if how == "inner":
        return hit
    keys = points.columns
    return points.join(hit, keys, how)


def first_region(points: DataFrame, regions: DataFrame, size: float, key: str, name: str, ordinal: str) -> DataFrame:
    """Each point with the first region (by ordinal) that holds it, else '—'."""
    hit = points_in_polygons(points, regions, size).groupBy(key).agg(F.min_by(name, ordinal).alias(name))
    return points.join(hit, key, "left").withColumn(name, F.coalesce(name, F.lit("—")))


def cell_overlaps(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Pairs of cell sets (id, row, col) that share cells: shared, sizes, IoU and share of the smaller one."""
    shared = a.select(a_id, "row", "col").join(b.select(b_id, "row", "col"), ["row", "col"]).groupBy(a_id, b_id).agg(F.count("*").alias("shared"))
    sizes = lambda x, k, out: x.groupBy(k).agg(F.count("*").alias(out))
    both = shared.join(sizes(a, a_id, "size_a"), a_id).join(sizes(b, b_id, "size_b"), b_id)
    return both.withColumn("iou", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).withColumn("overlap", F.col("shared") / F.least("size_a", "size_b"))


def best_matches(pairs: DataFrame, key: str, other: str, least: float) -> DataFrame:
    """For each key the partner of the largest IoU of at least ``least``; partners may repeat."""
    w = Window.partitionBy(key).orderBy(F.desc("iou"), other)
    return pairs.filter(F.col("iou") >= least).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def greedy_matches(pairs: DataFrame, key: str, other: str, score: str, least: float) -> DataFrame:
    """One-to-one matches: keys by falling score (then by key) take the unmatched partner of the largest IoU (then the smallest).

    In rounds: a pair is taken once the partner is the key's best left and the key is the first of all that are left in the
    partner's order. Nobody before the key can want the partner then, so the sequential choice would be the same; the first
    key of all is such a pair, so each round takes some. Rounds are grouped aggregates and joins; none holds a connected group.
    """
    left = persist_table(pairs.filter(F.col("iou") >= least).select(key, other, score, "iou"), "pairs")
    taken = []
    while left.limit(1).count():
        best = left.groupBy(key).agg(F.max(F.struct("iou", (-F.col(other)).alias("o"), other, score)).alias("b")).select(key, f"b.{other}", f"b.{score}", "b.iou")
        first = left.groupBy(other).agg(F.max(F.struct(score, (-F.col(key)).alias("k"), key)).alias("f")).select(F.col(other).alias("__o"), F.col(f"f.{key}").alias("__k"))
        new = persist_table(best.join(first, (F.col(other) == F.col("__o")) & (F.col(key) == F.col("__k"))).select(key, other, score, "iou"), "matches")
        rest = persist_table(left.join(new.select(key), key, "left_anti").join(new.select(other), other, "left_anti").select(key, other, score, "iou"), "pairs")
        remove_tables(left)
        left, taken = rest, [*taken, new]
    return reduce(DataFrame.unionByName, taken, left)


def overlap_candidates(sets: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs of cell sets (small, large) that may share ``least`` of the smaller one: no pair that does is missing.

    If sets of n and m >= n cells share at least ceil(least n), then any n - ceil(least n) + 1 cells of the smaller hold one of
    the larger. Each set is searched by its rarest cells only: those up to the frequency at which they are enough, found
    from counts a frequency, so that no set is ordered in one task. Common cells, where most pairs would meet, stay out.
    """
    often = sets.groupBy("row", "col").agg(F.count("*").alias("f"))
    tagged = sets.select(key, "row", "col").join(often, ["row", "col"])
    by_often = tagged.groupBy(key, "f").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(key).orderBy("f")
    size = F.sum("n").over(Window.partitionBy(key))
    by_often = by_often.withColumns({"size": size, "upto": F.sum("n").over(upto)})
    enough = by_often.filter(F.col("upto") >= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).groupBy(key, "size").agg(F.min("f").alias("cut"))
    known = persist_table(tagged.join(enough, key), "sets")
    probe = known.filter("f <= cut").select(F.col(key).alias("small"), F.col("size").alias("n"), "row", "col")
    index = known.select(F.col(key).alias("large"), F.col("size").alias("m"), "row", "col")
    return probe.join(index, ["row", "col"]).filter("n < m or (n = m and small < large)").select("small", "large", "n", "m").distinct()


def overlapping_sets(sets: DataFrame, key: str, least: float, among: Column | None = None) -> DataFrame:
    """Pairs (small, large) of cell sets that share at least ``least`` of the smaller one: shared, n, m, overlap.

    ``among`` may restrict the candidates by small and large.
    """
    pairs = overlap_candidates(sets, key, least)
    pairs = pairs.filter(among) if among is not None else pairs
    one, two = sets.select(F.col(key).alias("small"), "row", "col"), sets.select(F.col(key).alias("large"), "row", "col")
    shared = pairs.join(one, "small").join(two, ["large", "row", "col"]).groupBy("small", "large", "n", "m").agg(F.count("*").alias("shared"))
    return shared.withColumn("overlap", F.col("shared") / F.col("n")).filter(F.col("overlap") >= least)


def oldest_overlaps(sets: DataFrame, key: str, least: float, among: Column | None = None, block: int = 8) -> DataFrame:
    """newer, older: for each cell set the smallest smaller key whose set shares ``least`` of the smaller of both.

    Older sets are tried in blocks of rising keys, about ``block`` sets first, each block four times as long as the one before;
    a set that has found its oldest leaves, so where most sets overlap no round meets all pairs. The result does not
    depend on the blocks. ``among`` may restrict the pairs by newer and older.
    """
    sized = sets.select(key, "row", "col").join(sets.groupBy(key).agg(F.count("*").alias("n")), key)
    known = persist_table(sized, "sets")
    low, high, n = known.agg(F.min(key), F.max(key), F.countDistinct(key)).first()
    left = persist_table(known.select(F.col(key).alias("newer"), "row", "col", "n"), "newer")
    old = known.select(F.col(key).alias("older"), "row", "col", F.col("n").alias("m"))
    found, step = [], 0 if low is None else max(1, (high - low + 1) * block // n)
    while low is not None and low < high:
        part = old.filter((F.col("older") >= low) & (F.col("older") < low + step))
        pairs = left.join(part, ["row", "col"]).filter(F.col("newer") > F.col("older"))
        pairs = pairs.filter(among) if among is not None else pairs
        shared = pairs.groupBy("newer", "older", "n", "m").agg(F.count("*").alias("shared")).filter(F.col("shared") / F.least("n", "m") >= least)
        found.append(persist_table(shared.groupBy("newer").agg(F.min("older").alias("older")), "oldest"))
        low, step = low + step, step * 4
        rest = persist_table(left.filter(F.col("newer") > low).join(found[-1].select("newer"), "newer", "left_anti").select(*left.columns), "newer")
        remove_tables(left)
        left = rest
        if not left.limit(1).count():
            break
    remove_tables(left, known)
    return reduce(DataFrame.unionByName, found) if found else sets.select(F.col(key).alias("newer"), F.col(key).alias("older")).limit(0)


def nearest_within(points: DataFrame, others: DataFrame, key: str, radius: float, same_side: list[str] | None = None) -> DataFrame:
    """Distance of each point to the nearest other (x, y) within ``radius``: three by three cells of that size."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = points.withColumn("cx", F.explode(F.transform(around, lambda i: cell(F.col("x"), radius) + i)))
    p = p.withColumn("cy", F.explode(F.transform(around, lambda i: cell(F.col("y"), radius) + i)))
    o = others.select(*(same_side or []), F.col("x").alias("ox"), F.col("y").alias("oy"), cell(F.col("x"), radius).alias("cx"), cell(F.col("y"), radius).alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
    return p.join(o, [*(same_side or []), "cx", "cy"]).withColumn("distance", d).filter(F.col("distance") <= radius).groupBy(key).agg(F.min("distance").alias("distance"))


def density_clusters(points: DataFrame, key: str, eps: float, min_points: int) -> DataFrame:
    """Density clusters: key, cluster (smallest core key; -1 for noise). Border points join their smallest core's cluster.

    Points meet in cells of the size eps; a point's neighbours include itself. Cores are linked to cores within eps.
    """
    near = persist_table(_within(points, key, eps), "near")
    core = near.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= min_points).select(F.col("a").alias("id"))
    to_core = near.join(core.withColumnRenamed("id", "b"), "b")
    edges = to_core.join(core.withColumnRenamed("id", "a"), "a").filter("a < b").select("a", "b")
    label = core.join(min_labels(edges), "id", "left").select("id", F.coalesce("comp", "id").alias("cluster"))
    reached = to_core.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("cluster").alias("cluster"))
    own = label.select(F.col("id").alias(key), F.col("cluster").alias("own"))
    return (
        points.select(key).join(own, key, "left").join(reached.withColumnRenamed("a", key), key, "left")
        .select(key, F.coalesce("own", "cluster", F.lit(-1).cast("long")).alias("cluster"))
    )


def _within(points: DataFrame, key: str, eps: float) -> DataFrame:
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = points.select(F.col(key).cast("long").alias("a"), "x", "y", F.explode(F.transform(around, lambda i: cell(F.col("x"), eps) + i)).alias("cx"))
    p = p.withColumn("cy", F.explode(F.transform(around, lambda i: cell(F.col("y"), eps) + i)))
    o = points.select(F.col(key).cast("long").alias("b"), F.col("x").alias("ox"), F.col("y").alias("oy"), cell(F.col("x"), eps).alias("cx"), cell(F.col("y"), eps).alias("cy"))
    d2 = F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)
    return p.join(o, ["cx", "cy"]).filter(d2 <= eps * eps).select("a", "b")


def range_hits(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, before: int, after: int) -> DataFrame:
    """Pairs with right_at in [left_at - before, left_at + after] days: met on keys and day buckets, then exactly filtered."""
    width = before + after + 1
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    probes = left.withColumn("__b", F.explode(F.sequence(F.floor((day(left_at) - before) / width), F.floor((day(left_at) + after) / width))))
    found = right.withColumn("__b", F.floor(day(right_at) / width))
    gap = F.datediff(right_at, left_at)
    return probes.join(found, [*keys, "__b"]).filter((gap >= -before) & (gap <= after)).drop("__b")
