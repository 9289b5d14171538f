"""Operators over gridded cells (row, col): focal sums, morphology, connected components, terrain, tiles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TILE = 64


def shared_folder(spark) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def persist_table(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage by a table in the folder all executors share."""
    path = f"{shared_folder(df.sparkSession)}/emberline/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(*tables: DataFrame) -> None:
    """Delete tables of ``persist_table`` that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() == "emberline":
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast it: tables that shrink from round to round would pass the driver in every round."""
    return df.hint("merge")


Arrays = dict[str, np.ndarray]


def tiled(cells: DataFrame, halo: int, kernel: Callable[[np.ndarray, Arrays], Arrays], columns: list[str], made: str, tile: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` with the columns ``made`` (DDL) that ``kernel`` computes on square tiles with ``halo`` cells around them.

    Rasters told apart by the columns ``by`` are tiled each on its own.

    One exchange deals the cells; a cell near a border goes to two or four tiles. The kernel gets which cells are there and
    the named columns as arrays of (tile + 2 halo) squared cells (nulls and missing cells as 0), so no task holds more at a
    time, and gives arrays of that shape, right for the tile's own cells, which alone are returned.
    """
    tile = tile or TILE
    new, size = StructType.fromDDL(made), tile + 2 * halo
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    dealt = cells.withColumn("__tr", near("row")).withColumn("__tc", near("col"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = key[-2] * tile - halo, key[-1] * tile - halo
        r, c = pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left
        there, arrays = np.zeros((size, size), bool), {}
        there[r, c] = True
        for name in columns:
            arrays[name] = np.zeros((size, size))
            arrays[name][r, c] = pdf[name].fillna(0).to_numpy(float)
        got = kernel(there, arrays)
        own = (r >= halo) & (r < halo + tile) & (c >= halo) & (c < halo + tile)
        out = pdf[own].drop(columns=["__tr", "__tc"])
        return out.assign(**{f.name: got[f.name][r[own], c[own]] for f in new.fields})

    return dealt.groupBy(*by, "__tr", "__tc").applyInPandas(run, StructType([*cells.schema.fields, *new.fields]))


def moved(a: np.ndarray, down: int, right: int) -> np.ndarray:
    """The array whose cells hold what lies ``down`` rows below and ``right`` columns beside them, 0 beyond the border."""
    out = np.zeros_like(a)
    rows, cols = a.shape
    out[max(0, -down) : rows - max(0, down), max(0, -right) : cols - max(0, right)] = a[max(0, down) : rows + min(0, down), max(0, right) : cols + min(0, right)]
    return out


def box(a: np.ndarray, radius: int) -> np.ndarray:
    """Sum over the (2r+1) square around each cell: along rows, then down columns."""
    steps = range(-radius, radius + 1)
    across = reduce(np.add, (moved(a, 0, i) for i in steps))
    return reduce(np.add, (moved(across, i, 0) for i in steps))


def grown(m: np.ndarray) -> np.ndarray:
    return box(m.astype(int), 1) > 0


def shrunk(m: np.ndarray) -> np.ndarray:
    return box(m.astype(int), 1) == 9


def focal(cells: DataFrame, col: str, radius: int, out: str) -> DataFrame:
    """Sum over the (2r+1) square around each cell; missing cells count 0."""
    return tiled(cells, radius, lambda _, x: {out: box(x[col], radius)}, [col], f"{out} double")


def focal_mean(cells: DataFrame, col: str, k: int, out: str) -> DataFrame:
    """Mean with zero padding: always divided by k squared."""
    return tiled(cells, k // 2, lambda _, x: {out: box(x[col], k // 2) / k**2}, [col], f"{out} double")


def focal_table(cells: DataFrame, col: str, alert: str, sizes: tuple[int, ...] = (3, 5, 7), by: tuple[str, ...] = ()) -> DataFrame:
    """``mean<k>`` and ``std<k>`` for each k, and ``neighbours``, the alert cells beside each cell: one exchange for all."""

    def kernel(_, x: Arrays) -> Arrays:
        out = {"neighbours": box(x[alert], 1) - x[alert]}
        for k in sizes:
            mean = box(x[col], k // 2) / k**2
            out |= {f"mean{k}": mean, f"std{k}": np.sqrt(np.maximum(box(x[col] ** 2, k // 2) / k**2 - mean**2, 0))}
        return out

    made = ", ".join(f"mean{k} double, std{k} double" for k in sizes)
    return tiled(cells, max(sizes) // 2, kernel, [col, alert], f"{made}, neighbours long", by=by)


def dilate(cells: DataFrame, mask: str, out: str) -> DataFrame:
    return tiled(cells, 1, lambda _, x: {out: grown(x[mask])}, [mask], f"{out} boolean")


def erode(cells: DataFrame, mask: str, out: str) -> DataFrame:
    """3 x 3 erosion; what lies beyond the grid counts as unset."""
    return tiled(cells, 1, lambda _, x: {out: shrunk(x[mask])}, [mask], f"{out} boolean")


def opened(cells: DataFrame, mask: str, out: str) -> DataFrame:
    return tiled(cells, 2, lambda there, x: {out: grown(shrunk(x[mask]) & there)}, [mask], f"{out} boolean")


def closed(cells: DataFrame, mask: str, out: str) -> DataFrame:
    """Cells that are not there stay unset in between."""
    return tiled(cells, 2, lambda there, x: {out: shrunk(grown(x[mask]) & there)}, [mask], f"{out} boolean")


def components(cells: DataFrame, connectivity: int = 4, width: int = 1 << 20) -> DataFrame:
    """Label set cells (row, col): smallest row * width + col of the component.

    Runs along rows are joined in one window pass; runs of neighbouring rows that touch are linked, and labels spread
    to the smallest by linking and jumping over parents until nothing changes.
    """
    w = Window.partitionBy("row").orderBy("col")
    runs = cells.select("row", "col").distinct().withColumn("__r", F.col("col") - F.row_number().over(w))
    spans = runs.groupBy("row", "__r").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).withColumn("id", F.col("row").cast("long") * width + F.col("lo"))
    spans = persist_table(spans, "spans")
    reach = 1 if connectivity == 8 else 0
    # runs meet on the row and a tile of columns, so a wide row is not crossed with itself
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(lo / TILE), F.floor(hi / TILE)))
    above = spans.select((F.col("row") + 1).alias("row"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("id").alias("b"), tiles(F.col("lo"), F.col("hi")).alias("tile"))
    below = spans.withColumn("tile", tiles(F.col("lo") - reach, F.col("hi") + reach))
    edges = below.join(shuffled(above), ["row", "tile"]).filter((F.col("lo") <= F.col("hi2") + reach) & (F.col("lo2") <= F.col("hi") + reach)).select(F.col("id").alias("a"), "b")
    label = min_labels(edges)
    out = spans.join(shuffled(label), "id", "left").select("row", F.explode(F.sequence("lo", "hi")).alias("col"), F.coalesce("comp", "id").alias("component"))
    return out


def min_labels(edges: DataFrame) -> DataFrame:
    """Smallest id reachable over ``edges(a, b)``: id, comp."""
    both = persist_table(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parent = persist_table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "parents")
    while True:
        near = both.join(shuffled(parent.withColumnRenamed("id", "b")), "b").groupBy("a").agg(F.min("comp").alias("m"))
        linked = parent.join(shuffled(near.withColumnRenamed("a", "id")), "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("up"))
        up = parent.select(F.col("id").alias("up"), F.col("comp").alias("upper"))
        step = persist_table(linked.join(shuffled(up), "up").select("id", "old", F.least("up", "upper").alias("comp")), "parents")
        remove_tables(parent)
        parent = step.select("id", "comp")
        if not step.filter("old <> comp").limit(1).count():
            remove_tables(both)
            return parent


def patches(cells: DataFrame, mask: Column, min_pixels: int, aggs: list[Column], connectivity: int = 4) -> DataFrame:
    """Connected patches of the masked cells with at least ``min_pixels`` cells, and their attributes."""
    kept = cells.filter(mask)
    return kept.join(shuffled(components(kept, connectivity)), ["row", "col"]).groupBy("component").agg(F.count("*").alias("n_pixels"), *aggs).filter(F.col("n_pixels") >= min_pixels)


def hysteresis(cells: DataFrame, score: str, threshold: float, min_pixels: int = 5) -> DataFrame:
    """Cells at half the threshold, closed, in patches of enough cells that reach the threshold somewhere."""
    seed = closed(cells.withColumn("__s", F.col(score) >= threshold / 2), "__s", "__c").filter("__c")
    labelled = seed.select("row", "col", score).join(shuffled(components(seed)), ["row", "col"])
    good = labelled.groupBy("component").agg(F.count("*").alias("n"), F.max(score).alias("top")).filter((F.col("n") >= min_pixels) & (F.col("top") >= threshold))
    return labelled.join(good.select("component"), "component", "left_semi")


def horn(cells: DataFrame, z: str, size: float) -> DataFrame:
    """Slope and aspect (degrees) by the 3 x 3 Horn gradient; at edges and gaps a cell's own row or column is repeated."""

    def kernel(there: np.ndarray, x: Arrays) -> Arrays:
        def beside(a: np.ndarray, down: int, right: int) -> np.ndarray:
            return np.where(moved(there, down, right), moved(a, down, right), a)

        line = {"w": beside(x[z], 0, -1), "c": x[z], "e": beside(x[z], 0, 1)}
        n, s = ({k: beside(v, i, 0) for k, v in line.items()} for i in (-1, 1))
        dx = ((n["e"] + 2 * line["e"] + s["e"]) - (n["w"] + 2 * line["w"] + s["w"])) / (8 * size)
        dy = ((s["w"] + 2 * s["c"] + s["e"]) - (n["w"] + 2 * n["c"] + n["e"])) / (8 * size)
        return {"slope": np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy))), "aspect": (np.degrees(np.arctan2(dy, -dx)) + 360.0) % 360.0}

    return tiled(cells, 1, kernel, [z], "slope double, aspect double")


#: Sides of a cell in the order in which an outline runs (the cell on its right hand, rows counted downwards), by the cell
#: beyond, and that beyond and ahead: (row, column) steps.
SIDES = (((-1, 0), (-1, 1)), ((0, 1), (1, 1)), ((1, 0), (1, -1)), ((0, -1), (-1, -1)))
_START = ((0, 0), (0, 1), (1, 1), (1, 0))
#: (x, y) steps along the sides.
_ALONG = ((1, 0), (0, 1), (-1, 0), (0, -1))


def outline_paths(cells: DataFrame, connectivity: int = 4, width: int = 1 << 20, tile: int = 2 * TILE) -> DataFrame:
    """Outlines of set cells (row, col) as far as they run inside a tile: first, next, n_edges, cross, x, y.

    An edge's number is (row * width + col) * 4 + side; ``first`` is that of a path's first edge and ``next`` that of the edge
    that follows its last (null: the path is a whole ring). A whole ring starts with its smallest edge; a path that leaves its
    tile is cut in two before its smallest, so the smallest edge of every ring is the first of a path. ``cross`` is twice the
    area beside the path, ``x`` and ``y`` are where it turns. Where two cells touch at a corner only, outlines stay with their
    own cell (4) or cross over (8). An edge's successor, and whether it turns, follow from the eight cells around its own, so
    one exchange deals the cells with a halo of one; no task holds more than a tile at a time.
    """
    size, kinds = tile + 2, {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1) / tile), F.floor((F.col(c) + 1) / tile)))
    dealt = cells.select("row", "col").withColumn("__tr", near("row")).withColumn("__tc", near("col"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * tile - 1, int(key[1]) * tile - 1
        there = np.zeros((size, size), bool)
        there[pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left] = True
        own = np.zeros_like(there)
        own[1:-1, 1:-1] = there[1:-1, 1:-1]
        parts = []
        for k, (beyond, corner) in enumerate(SIDES):
            ahead, behind = SIDES[(k + 1) % 4][0], SIDES[(k + 3) % 4][0]
            r, c = np.nonzero(own & ~moved(there, *beyond))
            is_set = lambda at: there[r + at[0], c + at[1]]  # noqa: B023, E731
            on = is_set(ahead)
            over = is_set(corner) if connectivity == 8 else is_set(corner) & on
            step = lambda i: np.where(over, corner[i], np.where(on, ahead[i], 0))  # noqa: B023, E731
            side = np.where(over, (k + 3) % 4, np.where(on, k, (k + 1) % 4))
            straight = is_set(behind) & ~is_set((beyond[0] + behind[0], beyond[1] + behind[1]))
            x, y = c + left + _START[k][1], r + top + _START[k][0]
            parts.append((r, c, np.full(len(r), k), r + step(0), c + step(1), side, ~straight, x, y, x * _ALONG[k][1] - y * _ALONG[k][0]))
        r, c, k, r2, c2, k2, turns, x, y, cross = map(np.concatenate, zip(*parts))
        number = lambda r, c, k: ((r + top) * width + c + left) * 4 + k
        ids, after = number(r, c, k), number(r2, c2, k2)
        place = np.full(size * size * 4, -1)
        place[(r * size + c) * 4 + k] = np.arange(len(r))
        follows = place[(r2 * size + c2) * 4 + k2]  # -1: leaves the tile
        entered = np.ones(len(r), bool)
        entered[follows[follows >= 0]] = False
        paths, new, succ = [], np.ones(len(r), bool).tolist(), follows.tolist()

        def walk(e: int) -> list[int]:
            path = []
            while e >= 0 and new[e]:
                new[e] = False
                path.append(e)
                e = succ[e]
            return path

        for e in np.nonzero(entered)[0].tolist():
            path = walk(e)
            least = int(np.argmin(ids[path]))
            paths += [p for p in (path[:least], path[least:]) if p]
        for e in np.argsort(ids).tolist():  # the rest are rings, met at their smallest edges
            if new[e]:
                paths.append(walk(e))
        n = np.array([len(p) for p in paths], int)
        order = np.array([e for p in paths for e in p], int)
        starts = np.cumsum(n) - n
        last = order[starts + n - 1]
        whole = follows[last] == order[starts]
        turned = turns[order]
        cuts = np.cumsum(np.add.reduceat(turned, starts, dtype=int))[:-1] if len(n) else []
        at = lambda a: np.split(a[order][turned], cuts) if len(n) else []
        sums = np.add.reduceat(cross[order], starts) if len(n) else []
        return pd.DataFrame({"first": ids[order[starts]], "next": pd.Series(after[last], dtype="Int64").mask(whole), "n_edges": n, "cross": sums, "x": pd.Series(at(x), dtype=object), "y": pd.Series(at(y), dtype=object)})

    return dealt.groupBy("__tr", "__tc").applyInPandas(run, f"first long, next long, n_edges long, cross long, x array<{kinds['col']}>, y array<{kinds['row']}>")


def ring_places(edges: DataFrame) -> DataFrame:
    """For each edge its ring (the smallest id on it) and its place after that edge, by doubling the steps looked ahead.

    After k rounds an edge knows the smallest id among the 2^k edges from it on and how far away that is; nothing changes
    once every edge has met its ring's smallest. Each round is one join, written to the shared folder.
    """
    state = persist_table(edges.select("id", "next", F.col("id").alias("low"), F.lit(0).cast("long").alias("off")), "rings")
    step = 1
    while True:
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"), (F.col("off") + step).alias("off2"))
        better = F.col("low2") < F.col("low")
        joined = state.join(shuffled(ahead), "next").select(
            "id", F.col("next2").alias("next"), F.least("low", "low2").alias("low"), F.when(better, F.col("off2")).otherwise(F.col("off")).alias("off"), better.alias("changed"))
        new = persist_table(joined, "rings")
        remove_tables(state)
        state, step = new.drop("changed"), step * 2
        if not new.filter("changed").limit(1).count():
            # an edge is as many places after the smallest as the ring has edges less the steps to it
            size = state.groupBy("low").agg(F.count("*").alias("__n"))
            return state.join(shuffled(size), "low").select("id", F.col("low").alias("ring"), F.pmod(F.col("__n") - F.col("off"), F.col("__n")).alias("place"), F.col("__n").alias("n_edges"))


def rings(cells: DataFrame, connectivity: int = 4, tile: int = 2 * TILE) -> DataFrame:
    """Closed outlines of set cells: ring (its smallest edge), n_edges, area (below 0 for a hole), corners (array of x, y).

    Rings inside a tile are closed there; the paths of those that leave it, whose number follows the borders of tiles, are
    put in order by doubling. Areas are exact sums over edges. Only corners are gathered into a row; an outline is one value.
    """
    paths = persist_table(outline_paths(cells, connectivity, tile=tile), "paths")
    closed = paths.filter("next is null").select(F.col("first").alias("ring"), "n_edges", "cross", "x", "y")
    crossing = paths.filter("next is not null").withColumnRenamed("first", "id")
    places = ring_places(crossing.select("id", "next")).select("id", "ring", "place")
    joined = crossing.join(shuffled(places), "id").groupBy("ring").agg(F.sum("n_edges").alias("n_edges"), F.sum("cross").alias("cross"), F.sort_array(F.collect_list(F.struct("place", "x", "y"))).alias("p"))
    joined = joined.select("ring", "n_edges", "cross", *(F.flatten(F.transform("p", lambda p: p[c])).alias(c) for c in ("x", "y")))  # noqa: B023
    return closed.unionByName(joined).select("ring", "n_edges", (F.col("cross") / 2).alias("area"), F.arrays_zip("x", "y").alias("corners"))


def polygons(cells: DataFrame, connectivity: int = 4, min_pixels: int = 1) -> DataFrame:
    """Polygons of the components of set cells: component, n_pixels, edges, area, n_corners, outer and holes (arrays of rings)."""
    cells = persist_table(cells.select("row", "col").distinct(), "cells")
    labels = persist_table(components(cells, connectivity), "labels")
    size = labels.groupBy("component").agg(F.count("*").alias("n_pixels")).filter(F.col("n_pixels") >= min_pixels)
    # an outer ring around fewer cells is that of a component that goes; a ring takes the component of its smallest edge's cell
    around = rings(cells, connectivity).filter((F.col("area") < 0) | (F.col("area") >= min_pixels)).withColumn("cell", F.shiftright("ring", 2))
    around = around.join(shuffled(labels.select((F.col("row").cast("long") * (1 << 20) + F.col("col")).alias("cell"), "component")), "cell")
    by_ring = F.sort_array(F.collect_list(F.struct("ring", "area", "corners")))
    out = around.groupBy("component").agg(F.sum("n_edges").alias("edges"), F.sum("area").alias("area"), F.sum(F.size("corners")).alias("n_corners"), by_ring.alias("r"))
    part = lambda keep: F.transform(F.filter("r", keep), lambda x: x["corners"])
    return out.join(shuffled(size), "component").select("component", "n_pixels", "edges", "area", "n_corners", part(lambda x: x["area"] > 0).alias("outer"), part(lambda x: x["area"] < 0).alias("holes"))


def tile_ids(cells: DataFrame, tile: int, overlap: int) -> DataFrame:
    """One row per tile that covers a cell; tiles start every ``tile - overlap`` cells."""
    stride = tile - overlap

    def starts(c: str) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - tile + 1) / stride)).cast("int"), F.floor(F.col(c) / stride).cast("int"))

    return cells.withColumn("tile_row", F.explode(starts("row"))).withColumn("tile_col", F.explode(starts("col")))


def lowest_parabolas(at: np.ndarray, height: np.ndarray, where: np.ndarray) -> np.ndarray:
    """min over i of (where - at[i])^2 + height[i] for rising ``at`` and ``where``, by the lower envelope: linear time."""
    kept: list[int] = []
    starts: list[float] = []
    for i, (x, h) in enumerate(zip(at.tolist(), height.tolist())):
        start = -np.inf
        while kept:
            j = kept[-1]
            start = ((h + x * x) - (float(height[j]) + float(at[j]) ** 2)) / (2.0 * (x - float(at[j])))
            if start > starts[-1]:
                break
            kept.pop()
            starts.pop()
            start = -np.inf
        kept.append(i)
        starts.append(start)
    best = np.array(kept)[np.searchsorted(starts, where, side="right") - 1]
    return (where - at[best]) ** 2 + height[best]


def distance_to_set(cells: DataFrame, marked: DataFrame) -> DataFrame:
    """Exact distance from each cell to the nearest marked cell however far; null if nothing is marked.

    Separable: along each row the nearest mark to either side, by two scans; then down each column the lowest of the parabolas
    that its rows open. The cost is linear in the cells and does not depend on the distance; a task holds a row or a column.
    """
    m = marked.select("row", "col").distinct().withColumn("__m", F.col("col"))
    # where a marked row has no cell, its marks still reach along the row, so such rows are filled
    low, high = cells.agg(F.min("col"), F.max("col")).first()
    filled = m.select("row").distinct().select("row", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("col")) if low is not None else m.select("row", "col")
    both = cells.withColumn("__own", F.lit(True)).join(filled, ["row", "col"], "full").join(m, ["row", "col"], "full")
    across = Window.partitionBy("row").orderBy("col")
    left = F.last("__m", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("__m", ignorenulls=True).over(across.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("__g", F.least(F.abs(F.col("col") - left), F.abs(F.col("col") - right)).cast("long")).drop("__m")

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        opens = pdf[pdf["__g"].notna()]
        row = pdf["row"].to_numpy(np.int64)
        if len(opens):
            d2 = lowest_parabolas(opens["row"].to_numpy(np.int64), opens["__g"].to_numpy(np.int64) ** 2, row)
            pdf = pdf.assign(distance=np.sqrt(d2.astype(float)))
        else:
            pdf = pdf.assign(distance=None)
        return pdf[pdf["__own"].notna()].drop(columns=["__g", "__own"])

    return near.groupBy("col").applyInPandas(down, StructType([*cells.schema.fields, *StructType.fromDDL("distance double").fields]))


def nearest_set(cells: DataFrame, marked: DataFrame, radius: int) -> DataFrame:
    """Distance from each cell to the nearest marked cell within ``radius`` cells; null beyond. For small radii, as of discs."""
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    spread = marked.select("row", "col").distinct().select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(offsets).alias("dr")).select("r0", "c0", "dr", F.explode(offsets).alias("dc"))
    spread = spread.filter(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc") <= radius * radius)
    best = spread.select((F.col("r0") + F.col("dr")).alias("row"), (F.col("c0") + F.col("dc")).alias("col"), (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"))
    best = best.groupBy("row", "col").agg(F.sqrt(F.min("d2")).alias("distance"))
    return cells.join(best, ["row", "col"], "left")


def target_grid(spark, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


def resample_nearest(cells: DataFrame, value: str, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Each cell of the target grid with the value of the source cell that holds its centre; null where that is missing."""
    at = lambda c, n, m: F.expr(f"cast(((2 * {c} + 1) * {n}) div (2 * {m}) as int)")
    want = target_grid(cells.sparkSession, *target).withColumns({"__r": at("row", source[0], target[0]), "__c": at("col", source[1], target[1])})
    have = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), value)
    return want.join(have, ["__r", "__c"], "left").select("row", "col", value)


def resample_bilinear(cells: DataFrame, value: str, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Each cell of the target grid from the four source cells around its centre, weighted; at borders cells repeat.

    Weights are whole numbers (their sum 4 h w), so equal inputs give equal results on any engine; missing and null cells
    leave the weights of the others, null if none is there.
    """

    def corners(c: str, n: int, m: int) -> tuple[Column, Column]:
        offset = f"((2 * {c} + 1) * {n} - {m})"
        low, part = F.expr(f"cast(floor({offset} / {2 * m}.0D) as int)"), F.expr(f"pmod({offset}, {2 * m})")
        clamp = lambda i: F.greatest(F.lit(0), F.least(F.lit(n - 1), i))
        two = F.array(F.struct(clamp(low).alias("i"), (2 * m - part).alias("w")), F.struct(clamp(low + 1).alias("i"), part.alias("w")))
        return F.explode(two)

    want = target_grid(cells.sparkSession, *target).withColumn("__a", corners("row", source[0], target[0])).withColumn("__b", corners("col", source[1], target[1]))
    want = want.select("row", "col", F.col("__a.i").alias("__r"), F.col("__b.i").alias("__c"), (F.col("__a.w").cast("long") * F.col("__b.w")).alias("__w")).filter("__w > 0")
    have = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("__v"))
    both, there = want.join(have, ["__r", "__c"], "left"), F.col("__v").isNotNull()
    return both.groupBy("row", "col").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum(F.when(there, F.col("__w")))).alias(value))


def resample_mode(cells: DataFrame, value: str, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Each cell of a coarser grid with the commonest value of the source cells whose centres it holds, the smallest of equals."""
    at = lambda c, n, m: F.expr(f"cast(((2 * {c} + 1) * {m}) div (2 * {n}) as int)")
    counts = cells.filter(F.col(value).isNotNull()).groupBy(at("row", source[0], target[0]).alias("row"), at("col", source[1], target[1]).alias("col"), value).agg(F.count("*").alias("n"))
    return counts.groupBy("row", "col").agg(F.min(F.struct((-F.col("n")).alias("n"), value))[value].alias(value))
