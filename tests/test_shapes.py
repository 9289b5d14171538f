"""Concave perimeters and their spread, one-to-one matching and overlap joins against searches and loops."""

import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import hulls, spatial


def circle(p, q, r):
    """Squared radius and centre of the circle through three points, None on a line."""
    d = 2 * (p[0] * (q[1] - r[1]) + q[0] * (r[1] - p[1]) + r[0] * (p[1] - q[1]))
    if not d:
        return None
    s = [x * x + y * y for x, y in (p, q, r)]
    x = (s[0] * (q[1] - r[1]) + s[1] * (r[1] - p[1]) + s[2] * (p[1] - q[1])) / d
    y = (s[0] * (r[0] - q[0]) + s[1] * (p[0] - r[0]) + s[2] * (q[0] - p[0])) / d
    return (p[0] - x) ** 2 + (p[1] - y) ** 2, x, y


def empty_circles(points, radius):
    """All triples with a small circumcircle that no other point lies in."""
    for t in combinations(points, 3):
        c = circle(*t)
        if c and c[0] < radius**2 and not any((x - c[1]) ** 2 + (y - c[2]) ** 2 < c[0] - 1e-6 for x, y in points if (x, y) not in t):
            yield t


@pytest.mark.parametrize("seed", range(4))
def test_triangles_are_those_with_an_empty_circle(seed):
    rng = np.random.default_rng(seed)
    p = sorted({(int(x), int(y)) for x, y in rng.integers(0, 10_000 if seed % 2 else 1000, (30, 2))})
    reach = 250 * (10 if seed % 2 else 1)
    got = {frozenset(p[i] for i in t) for t in hulls.triangles(np.array(p), reach).tolist()}
    got = {t for t in got if circle(*t) and circle(*t)[0] < reach**2}
    assert got == {frozenset(t) for t in empty_circles(p, reach)} and got


def test_an_outline_follows_a_bay_and_fills_a_hole():
    block = {(x, y) for x in range(0, 70, 10) for y in range(0, 70, 10)}
    bay = block - {(x, y) for x in (20, 30, 40) for y in (30, 40, 50, 60)}
    (ring,) = hulls.outline([*bay], 8.0)
    # of 36 lattice squares of ten the 16 of the bay go, but for the half squares in its two lower corners
    assert hulls.area2(ring) / 2 == 100 * (36 - 16) + 2 * 50 and len(ring) >= 12
    (full,) = hulls.outline([*(block - {(20, 20), (30, 20), (20, 30), (30, 30)})], 8.0)
    assert hulls.area2(full) / 2 == 3600
    (wide,) = hulls.outline([*bay], 1e6)
    assert hulls.area2(wide) / 2 == 3600


def test_parts_far_apart_have_a_ring_each_and_few_points_their_hull():
    two = [(x + d, y) for d in (0, 500) for x in (0, 10) for y in (0, 10)]
    assert sorted(hulls.area2(r) / 2 for r in hulls.outline(two, 8.0)) == [100, 100]
    assert [hulls.area2(r) / 2 for r in hulls.outline([(0, 0), (30, 0), (0, 40)], 1.0)] == [600]
    assert hulls.outline([(0, 0), (5, 5), (9, 9), (2, 2)], 1.0) == [[(0, 0), (9, 9)]] and hulls.outline([(3, 4)] * 9, 1.0) == [[(3, 4)]]


def test_random_outlines_enclose_their_triangles():
    for seed in range(5):
        rng = np.random.default_rng(100 + seed)
        p = sorted({(int(x), int(y)) for x, y in rng.integers(0, 1000, (40, 2))})
        tri = [*empty_circles(p, 110)]
        area = sum(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) for a, b, c in tri)
        rings = hulls.outline(p, 110.0)
        assert sum(map(hulls.area2, rings)) >= area and all(hulls.area2(r) > 0 for r in rings)
        for a, b, c in tri:  # each triangle lies in one ring
            assert sum(hulls.holds(r, (a[0] + b[0] + c[0]) / 3, (a[1] + b[1] + c[1]) / 3) for r in rings) == 1


def test_perimeters_in_metres_and_their_spread(spark):
    side = lambda n: [(80.9 + i * 0.003, 24.0 + j * 0.003) for i in range(n) for j in range(n)]
    rows = [("e", dt.datetime(2024, 1, 1, 1), x, y, 2.0) for x, y in side(4)] * 2 + [("e", dt.datetime(2024, 1, 1, 13), x + 0.006, y, None) for x, y in side(7)]
    rows += [("few", dt.datetime(2024, 1, 1), 80.0, 24.0, 1.0)] * 4
    p = spark.createDataFrame(rows, "event string, at timestamp, lon double, lat double, frp double")
    m = hulls.measured(hulls.concave_hulls(p, ["event", "at"], "lon", "lat", "frp", 0.0005, 0.004)).orderBy("at").collect()
    assert [(r["event"], r["n_pixels"], r["mean_frp"]) for r in m] == [("e", 32, 2.0), ("e", 49, 0.0)]
    # degrees in metres at 24 north, near the middle of the zone
    east, north = 111_320 * np.cos(np.radians(24.006)) * 0.9996, 110_775 * 0.9996
    for r, n in zip(m, (3, 6)):
        w, h = n * 0.003 * east / 1e3, n * 0.003 * north / 1e3
        assert r["area_km2"] == pytest.approx(w * h, rel=2e-3) and r["perimeter_km"] == pytest.approx(2 * (w + h), rel=2e-3)
        assert r["centre_lat"] == pytest.approx(24.0 + n * 0.0015 + 0.00025) and len(r["rings"]) == 1
    s = hulls.spread(hulls.measured(hulls.concave_hulls(p, ["event", "at"], "lon", "lat", "frp", 0.0005, 0.004)), "event", "at").collect()
    assert len(s) == 1 and s[0]["dt_hours"] == 12 and s[0]["new_pixels"] == 17
    growth = m[1]["area_km2"] - m[0]["area_km2"]
    assert s[0]["area_change_km2"] == pytest.approx(growth, abs=1e-4) and s[0]["cros_km_h"] == pytest.approx(growth / (m[0]["perimeter_km"] * 12), abs=1e-5)
    dx, dy = (m[1]["centre_lon"] - m[0]["centre_lon"]) * np.cos(np.radians(24.006)), m[1]["centre_lat"] - m[0]["centre_lat"]
    assert s[0]["bearing_deg"] == pytest.approx(np.degrees(np.arctan2(dx, dy)), abs=0.3)


def test_matching_in_rounds_equals_the_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(a, b, (a * 37 % 11) / 11, float(rng.integers(1, 8)) / 8) for a in range(60) for b in range(50) if rng.random() < 0.12]
    got = {(r["a"], r["b"]) for r in spatial.greedy_matches(spark.createDataFrame(rows, "a int, b int, score double, iou double"), "a", "b", "score", 0.2).collect()}
    taken, want = set(), set()
    for a in sorted({r[0] for r in rows}, key=lambda a: (-((a * 37 % 11) / 11), a)):
        free = [(-i, b) for x, b, _, i in rows if x == a and i >= 0.2 and b not in taken]
        if free:
            taken.add(min(free)[1])
            want.add((a, min(free)[1]))
    assert got == want and len(want) > 30
    assert spatial.greedy_matches(spark.createDataFrame(rows, "a int, b int, score double, iou double").limit(0), "a", "b", "score", 0.2).count() == 0


def test_the_overlap_join_finds_all_pairs_and_passes_common_cells_by(spark):
    rng = np.random.default_rng(5)
    sets = {i: {(i // 2 * 10 + int(x), int(y)) for x, y in rng.integers(0, 9, (int(rng.integers(3, 60)), 2))} for i in range(40)}
    for s in sets.values():  # cells that everybody has
        s |= {(-1, j) for j in range(min(3, len(s) // 4))}
    df = spark.createDataFrame([(i, r, c) for i, s in sets.items() for r, c in s], "id int, row int, col int")
    for least in (0.3, 0.6, 1.0):
        want = {}
        for i, j in combinations(sets, 2):
            small, large = sorted((i, j), key=lambda k: (len(sets[k]), k))
            shared = len(sets[i] & sets[j])
            if shared >= least * len(sets[small]):
                want[small, large] = shared
        got = {(r["small"], r["large"]): r["shared"] for r in spatial.overlapping_sets(df, "id", least).collect()}
        assert got == want
    assert spatial.overlap_candidates(df, "id", 0.6).count() < 0.2 * 40 * 39 / 2
    assert spatial.overlapping_sets(df, "id", 0.3, F.expr("small % 2 = 0 and large % 2 = 0")).filter("small % 2 = 1 or large % 2 = 1").count() == 0
    assert spatial.overlapping_sets(df.limit(0), "id", 0.3).count() == 0
