"""Patch selection, assembly and spectral windows against loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators.patches import CHANNELS, OPTICAL, assemble_patches, select_patches, spectral_windows

ROWS, COLS, TILE, STRIDE = 27, 22, 8, 4


@pytest.fixture(scope="module")
def labels():
    rng = np.random.default_rng(8)
    out = []
    for s in ("a", "b"):
        a = np.where(rng.random((ROWS, COLS)) < 0.1, rng.random((ROWS, COLS)), 0.0)
        a[rng.random((ROWS, COLS)) < 0.2] = np.nan
        a[:, 12:] = np.where(np.isnan(a[:, 12:]) | (rng.random((ROWS, 10)) < 0.45), np.nan, 0.0)
        out += [(s, r, c, None if (r + c) % 5 == 0 and np.isnan(a[r, c]) else float(a[r, c])) for r in range(ROWS) for c in range(COLS) if (r * 7 + c) % 23]
    return out


def test_patches_equal_the_loop(spark, labels):
    df = spark.createDataFrame(labels, "scene string, row int, col int, v double")
    got = {(x["scene"], x["patch_row"], x["patch_col"]): x for x in select_patches(df, "scene", "v", ROWS, COLS, TILE, STRIDE, 5, 0.3).collect()}
    at = {x[:3]: x[3] for x in labels}
    fires, others = {}, {}
    for s in ("a", "b"):
        for r in range(0, ROWS - TILE + 1, STRIDE):
            for c in range(0, COLS - TILE + 1, STRIDE):
                v = [at.get((s, i, j)) for i in range(r, r + TILE) for j in range(c, c + TILE)]
                v = [x for x in v if x is not None and not np.isnan(x)]
                n = sum(x > 0 for x in v)
                if n >= 5:
                    fires[s, r // STRIDE, c // STRIDE] = n
                elif len(v) > TILE * TILE / 2:
                    others[s, r // STRIDE, c // STRIDE] = n
    assert fires and others and {k: x["fire_cells"] for k, x in got.items() if x["is_fire"]} == fires
    drawn = {k for k, x in got.items() if not x["is_fire"]}
    assert drawn < set(others)
    for s in ("a", "b"):
        assert sum(k[0] == s for k in drawn) == max(1, int(0.3 * sum(k[0] == s for k in others)))
    again = select_patches(df.repartition(5, "col"), "scene", "v", ROWS, COLS, TILE, STRIDE, 5, 0.3)
    assert {(x["scene"], x["patch_row"], x["patch_col"]) for x in again.collect()} == set(got)
    assert select_patches(df.limit(0), "scene", "v", ROWS, COLS, TILE, STRIDE).count() == 0
    with pytest.raises(ValueError):
        select_patches(df, "scene", "v", ROWS, COLS, 8, 3)


def test_assembled_cells_equal_the_loop(spark, labels):
    df = spark.createDataFrame(labels, "scene string, row int, col int, v double")
    patches = select_patches(df, "scene", "v", ROWS, COLS, TILE, STRIDE, 5, 0.3).persist()
    scenes = spark.createDataFrame([("a", "a", None, 1.5), ("b", "b", "a", None)], "scene string, now string, before string, wind double")
    cells = spark.createDataFrame([(s, r, c, float(r * 100 + c + (s == "b") / 2)) for s, r, c, _ in labels if r != 6], "scene string, row int, col int, nir double")
    ground = spark.createDataFrame([(r, c, r - c) for r in range(ROWS) for c in range(COLS) if c != 3], "row int, col int, slope int")
    got = {(x["scene"], x["patch_row"], x["patch_col"], x["row"], x["col"]): x for x in assemble_patches(patches, scenes, cells, ground, df, "scene", ["now", "before"], ["nir"], TILE, STRIDE).collect()}
    at = {x[:3]: x for x in labels}
    want = {(p["scene"], p["patch_row"], p["patch_col"], r, c) for p in patches.collect() for r in range(p["patch_row"] * STRIDE, p["patch_row"] * STRIDE + TILE) for c in range(p["patch_col"] * STRIDE, p["patch_col"] * STRIDE + TILE) if (p["scene"], r, c) in at}
    assert set(got) == want
    for (s, _, _, r, c), x in got.items():
        nir = lambda scene: None if r == 6 or (scene, r, c) not in at else r * 100 + c + (scene == "b") / 2
        frames = [f and f["nir"] for f in x["frames"] or (None, None)]
        assert frames == [nir(s), nir("a") if s == "b" else None]
        assert x["slope"] == (None if c == 3 else r - c) and x["wind"] == (1.5 if s == "a" else None) and "now" not in x.asDict()


def test_spectral_windows_equal_the_loop(spark):
    rng = np.random.default_rng(9)
    first = dt.date(2024, 1, 5)
    days = {p: sorted(rng.choice(120, 14, replace=False).tolist()) for p in (1, 2, 3)}
    seen = [(p, first + dt.timedelta(days=d), *map(int, rng.integers(1, 6000, 6))) for p, ds in days.items() for d in ds]
    weather = [(p, first + dt.timedelta(days=d), float(d), None if d % 5 == 0 else d / 10) for p, ds in days.items() for d in ds if d % 3]
    names = ", ".join(f"{b} int" for b in OPTICAL)
    s = spark.createDataFrame([*seen, (1, None, *[1] * 6), (None, first, *[1] * 6)], f"place int, day date, {names}").withColumn("temp_c", F.lit("clash"))
    w = spark.createDataFrame(weather, "place int, day date, temp_c double, precip_mm double")
    t = spark.createDataFrame([(1, 800.0, None), (2, 90.0, 12.0)], "place int, elevation_m double, slope_deg double")
    got = {(x["place"], x["day"]): x for x in spectral_windows(s, w, t, "place", "day").collect()}
    values, wx, ground = {x[:2]: x[2:] for x in seen}, {x[:2]: x[2:] for x in weather}, {1: (800, 5), 2: (90, 12), 3: (500, 5)}
    assert set(got) == set(values)
    for (p, day), x in got.items():
        assert x["month"] == day.month - 1 and len(x["x"]) == len(x["mask"]) == 3
        for i, back in enumerate((0, 16, 32)):
            want = day - dt.timedelta(days=back)
            near = sorted((abs((d - want).days), d) for q, d in values if q == p and abs((d - want).days) <= 12)
            v, m = [0.0] * CHANNELS, [1] * CHANNELS
            if near:
                bands = [b / 10000 for b in values[p, near[0][1]]]
                for c, b in zip(OPTICAL.values(), bands):
                    v[c], m[c] = b, 0
                v[16], m[16] = (bands[3] - bands[2]) / (bands[3] + bands[2] + 1e-8), 0
                temp, rain = wx.get((p, near[0][1]), (None, None))
                if temp is not None and rain is not None:
                    v[12], v[13], m[12], m[13] = (temp + 273.15) / 35, rain / 1000 / 0.03, 0, 0
            v[14], v[15], m[14], m[15] = ground[p][0] / 2000, ground[p][1] / 50, 0, 0
            assert x["mask"][i] == m and x["x"][i] == pytest.approx(v)
    assert spectral_windows(s.limit(0), w, t, "place", "day").count() == 0
