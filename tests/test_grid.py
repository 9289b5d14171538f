"""Tiles with halo, outlines, distances, resampling and exact quantiles against plain loops, on rasters of several tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import grid
from emberline.operators.quantiles import exact_quantiles


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(grid, "TILE", 7)


def frame(spark, a, there=None):
    rows = [(int(r), int(c), float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1]) if there is None or there[r, c]]
    return spark.createDataFrame(rows, "row int, col int, v double")


def around(a, r, c, k):
    h = k // 2
    return a[max(0, r - h) : r + h + 1, max(0, c - h) : c + h + 1]


def test_focal_table_with_gaps(spark, small_tiles):
    rng = np.random.default_rng(1)
    a, there = rng.random((30, 24)), rng.random((30, 24)) < 0.8
    z = np.where(there, a, 0)
    out = grid.focal_table(frame(spark, a, there).withColumn("m", F.col("v") > 0.5), "v", "m")
    got = {(r["row"], r["col"]): r for r in out.collect()}
    assert len(got) == there.sum()
    for (r, c), x in got.items():
        for k in (3, 5, 7):
            mean = around(z, r, c, k).sum() / k**2
            assert x[f"mean{k}"] == pytest.approx(mean) and x[f"std{k}"] == pytest.approx(np.sqrt(max((around(z, r, c, k) ** 2).sum() / k**2 - mean**2, 0)), abs=1e-7)
        assert x["neighbours"] == (around(z, r, c, 3) > 0.5).sum() - (z[r, c] > 0.5)


def test_opening_and_closing_across_tiles(spark, small_tiles):
    rng = np.random.default_rng(2)
    a = rng.random((23, 31))
    m = a > 0.35
    full = lambda x: np.array([[around(x, r, c, 3).sum() == 9 for c in range(31)] for r in range(23)])
    some = lambda x: np.array([[around(x, r, c, 3).any() for c in range(31)] for r in range(23)])
    f = frame(spark, a).withColumn("m", F.col("v") > 0.35)
    for name, f_, want in (("o", grid.opened, some(full(m))), ("c", grid.closed, full(some(m))), ("d", grid.dilate, some(m)), ("e", grid.erode, full(m))):
        got = np.zeros(m.shape, bool)
        for r in f_(f, "m", name).collect():
            got[r["row"], r["col"]] = r[name]
        assert (got == want).all()


def test_slope_and_aspect_across_tiles(spark, small_tiles):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 90, (16, 15)).astype(float)
    p = np.pad(z, 1, mode="edge")
    for x in grid.horn(frame(spark, z), "v", 10.0).collect():
        (nw, n, ne), (w, _, e), (sw, s, se) = p[x["row"] : x["row"] + 3, x["col"] : x["col"] + 3]
        dx, dy = ((ne + 2 * e + se) - (nw + 2 * w + sw)) / 80, ((sw + 2 * s + se) - (nw + 2 * n + ne)) / 80
        assert x["slope"] == pytest.approx(np.degrees(np.arctan(np.hypot(dx, dy)))) and x["aspect"] == pytest.approx(np.degrees(np.arctan2(dy, -dx)) % 360)


def test_no_window_or_group_is_keyed_on_a_whole_row_or_column(spark):
    f = frame(spark, np.zeros((2, 2))).withColumn("m", F.col("v") > 0)
    for df in (grid.focal_table(f, "v", "m"), grid.opened(f, "m", "o"), grid.horn(f, "v", 1.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(__tr" in plan and plan.count("hashpartitioning") == 1 and "Window" not in plan


@pytest.mark.parametrize("chance", [0.004, 0.2])
def test_distances_however_far_and_with_gaps(spark, chance):
    rng = np.random.default_rng(4)
    a, there = rng.random((40, 33)), rng.random((40, 33)) < 0.7
    f = frame(spark, a, there)
    marks = [(r, c) for r in range(40) for c in range(33) if there[r, c] and a[r, c] < chance]
    assert marks
    out = grid.distance_to_set(f, f.filter(F.col("v") < chance)).collect()
    assert len(out) == there.sum()
    for x in out:
        assert x["distance"] == pytest.approx(min(np.hypot(x["row"] - r, x["col"] - c) for r, c in marks))
    assert grid.distance_to_set(f, f.limit(0)).filter("distance is not null").count() == 0
    assert grid.distance_to_set(f.limit(0), f).count() == 0


def inside(rings, r, c):
    """Even-odd rule for the centre of a pixel."""
    odd = False
    for ring in rings:
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if p["x"] == q["x"] and p["x"] > c and min(p["y"], q["y"]) <= r < max(p["y"], q["y"]):
                odd = not odd
    return odd


@pytest.mark.parametrize("connectivity", [4, 8])
def test_polygons_burned_in_again_give_the_mask(spark, connectivity):
    rng = np.random.default_rng(5)
    m = rng.random((26, 22)) < 0.55
    m[3:12, 4:14] = True
    m[5:9, 6:9] = m[6, 11] = False
    m[7, 7] = True  # an island in a hole
    f = frame(spark, m.astype(float)).filter("v > 0").select("row", "col")
    labels = {(r["row"], r["col"]): r["component"] for r in grid.components(f, connectivity).collect()}
    holes = 0
    out = grid.polygons(f, connectivity).collect()
    assert {r["component"] for r in out} == set(labels.values())
    for p in out:
        own = {k for k, v in labels.items() if v == p["component"]}
        got = {(r, c) for r in range(26) for c in range(22) if inside([*p["outer"], *p["holes"]], r, c)}
        assert got == own and p["area"] == p["n_pixels"] == len(own)
        assert p["edges"] == sum((r + i, c + j) not in own for r, c in own for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert len(p["outer"]) == 1 and p["n_corners"] == sum(map(len, [*p["outer"], *p["holes"]]))
        holes += len(p["holes"])
    assert holes >= 2


def test_small_polygons_go(spark):
    f = spark.createDataFrame([(0, 0), (5, 5), (5, 6)], "row int, col int")
    got = grid.polygons(f, 4, 2).collect()
    assert [(p["n_pixels"], [(q["x"], q["y"]) for q in p["outer"][0]], p["holes"]) for p in got] == [(2, [(5, 5), (7, 5), (7, 6), (5, 6)], [])]
    assert grid.polygons(f.limit(0)).count() == 0


def test_resampling(spark):
    rng = np.random.default_rng(6)
    a, there = rng.integers(0, 4, (13, 10)).astype(float), rng.random((13, 10)) < 0.85
    f, (h, w) = frame(spark, a, there), (7, 6)
    near = {(x["row"], x["col"]): x["v"] for x in grid.resample_nearest(f, "v", (13, 10), (h, w)).collect()}
    line = {(x["row"], x["col"]): x["v"] for x in grid.resample_bilinear(f, "v", (13, 10), (h, w)).collect()}
    mode = {(x["row"], x["col"]): x["v"] for x in grid.resample_mode(f, "v", (13, 10), (h, w)).collect()}
    assert len(near) == len(line) == h * w
    for r in range(h):
        for c in range(w):
            y, x = (r + 0.5) * 13 / h, (c + 0.5) * 10 / w
            assert near[r, c] == (a[int(y), int(x)] if there[int(y), int(x)] else None)
            sums = [0.0, 0.0]
            i0, j0 = int(np.floor(y - 0.5)), int(np.floor(x - 0.5))
            for i, u in ((i0, 1 - (y - 0.5 - i0)), (i0 + 1, y - 0.5 - i0)):
                for j, v in ((j0, 1 - (x - 0.5 - j0)), (j0 + 1, x - 0.5 - j0)):
                    i_, j_ = min(max(i, 0), 12), min(max(j, 0), 9)
                    if there[i_, j_]:
                        sums = [sums[0] + u * v * a[i_, j_], sums[1] + u * v]
            assert line[r, c] == (pytest.approx(sums[0] / sums[1]) if sums[1] > 1e-12 else None)
            held = [a[i, j] for i in range(13) for j in range(10) if there[i, j] and (i + 0.5) * h // 13 == r and (j + 0.5) * w // 10 == c]
            assert mode.get((r, c)) == (max(sorted(set(held)), key=held.count) if held else None)


@pytest.mark.parametrize("cuts", [500, 3])
def test_quantiles_are_exact_with_ties_and_hot_groups(spark, cuts):
    rng = np.random.default_rng(7)
    values = {"hot": np.concatenate([np.full(4000, 7.0), rng.normal(size=3000)]), "wide": rng.normal(size=999) ** 9 * 1e12, "one": np.array([3.5]), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("hot", None), ("one", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.803, "e": 0.98, "f": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, "x", wanted, ["g"], cuts).collect()}
    assert set(got) == set(values)
    for k, x in values.items():
        assert got[k]["n"] == len(x) and [got[k][c] for c in wanted] == pytest.approx(np.quantile(x, [*wanted.values()]).tolist(), rel=1e-12)
    whole = exact_quantiles(df, "x", {"m": 0.5}).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(np.quantile(np.concatenate([*values.values()]), 0.5))
    assert exact_quantiles(df.filter("g = 'none'"), "x", {"m": 0.5}, ["g"]).count() == 0
