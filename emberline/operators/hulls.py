"""Concave perimeters of points: triangles with a small circumcircle, their outline, and its measures in metres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import bearing, utm

Ring = list[tuple[int, int]]


def triangles(p: np.ndarray, reach: int) -> np.ndarray:
    """Delaunay triangles (counter-clockwise rows of three indices) of distinct whole-numbered points.

    Points go in one by one: triangles whose circumcircle holds the new point give way to new ones around it. All tests are
    exact. The three far points that start it lie outside every circumcircle of a radius up to ``reach``, so of the
    triangles between real points at least those are right; the others are left out by the caller.
    """
    n, low = len(p), p.min(axis=0)
    span = int((p - low).max()) + 1
    far = 4 * (span + 2 * reach)
    kind = np.int64 if 8 * far < 1 << 15 else object
    q = np.concatenate([p - low, [(-far, -far), (3 * far, -far), (-far, 3 * far)]]).astype(kind)
    found = np.array([[n, n + 1, n + 2]])
    for i in np.random.default_rng(n).permutation(n):
        d = q[found] - q[i]
        lift = (d * d).sum(axis=2)
        (ax, ay), (bx, by), (cx, cy) = (d[:, k].T for k in range(3))
        within = lift[:, 0] * (bx * cy - by * cx) + lift[:, 1] * (cx * ay - cy * ax) + lift[:, 2] * (ax * by - ay * bx) > 0
        gone = found[within]
        edges = {(int(a), int(b)) for t in gone for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        new = [(a, b, i) for a, b in edges if (b, a) not in edges]
        found = np.concatenate([found[~within], np.array(new, found.dtype)])
    return found[(found < n).all(axis=1)]


def convex(p: list[tuple[int, int]]) -> Ring:
    def chain(points: list[tuple[int, int]]) -> Ring:
        out: Ring = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    p = sorted(p)
    return chain(p) + chain(p[::-1]) if len(p) > 1 else p


def area2(ring: Ring) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def holds(ring: Ring, x: float, y: float) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def joined(edges: dict[tuple[int, int], list[tuple[int, int]]]) -> list[Ring]:
    """Directed edges (start -> ends, the inside to the left) as closed rings; where several leave a point, the inside stays one."""
    out = []
    while edges:
        start = min(edges)
        ring, at, last = [start], edges[start][0], start
        step = (start, at)
        while True:
            edges[step[0]].remove(step[1])
            if not edges[step[0]]:
                del edges[step[0]]
            if at == start:
                break
            back = math.atan2(last[1] - at[1], last[0] - at[0])
            nxt = min(edges[at], key=lambda e: (back - math.atan2(e[1] - at[1], e[0] - at[0])) % (2 * math.pi) or 2 * math.pi)
            ring.append(at)
            last, at, step = at, nxt, (at, nxt)
        out.append(ring)
    return out


def outline(points: list[tuple[int, int]], radius: float) -> list[Ring]:
    """Outer rings of the union of all Delaunay triangles with a circumradius below ``radius``; what they enclose is filled.

    Fewer than four points, or no such triangle: the convex hull; points on a line: their ends.
    """
    p = sorted(set(points))
    if len(p) >= 4:
        a = np.array(p, np.int64)
        t = triangles(a, math.ceil(radius))
        if len(t):
            u = a[t].astype(float)
            side = ((u - np.roll(u, -1, axis=1)) ** 2).sum(axis=2)
            d, e = u[:, 1] - u[:, 0], u[:, 2] - u[:, 0]
            cross = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]
            t = t[(cross > 0) & (side.prod(axis=1) < 4 * radius**2 * cross**2)]
        around = {(int(x), int(y)) for i, j, k in t for x, y in ((i, j), (j, k), (k, i))}
        edges: dict = {}
        for i, j in sorted(around):
            if (j, i) not in around:
                edges.setdefault(p[i], []).append(p[j])
        outer = [r for r in joined(edges) if area2(r) > 0]
        if outer:
            middle = lambda r: ((r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2)
            return [r for r in outer if not any(o is not r and abs(area2(o)) > area2(r) and holds(o, *middle(r)) for o in outer)]
    return [convex(p)]


def concave_hulls(points: DataFrame, by: list[str], lon: str, lat: str, power: str, cell: float, radius: float, least: int = 5) -> DataFrame:
    """Perimeter rings (lon, lat) of each group: ``by``, n_pixels, mean_frp, rings. Groups below ``least`` points have none.

    Points are thinned to one a cell of ``cell`` degrees (its centre) before a group meets in a task, so what a task holds is
    bounded by the cells that a fire covers, however many detections there are. ``radius`` in degrees.
    """
    at = [F.floor(F.col(lon) / cell).cast("long").alias("__x"), F.floor(F.col(lat) / cell).cast("long").alias("__y")]
    thin = points.groupBy(*by, *at).agg(F.count("*").alias("__n"), F.sum(power).alias("__p"), F.count(power).alias("__k"))
    kept = StructType([points.schema[c] for c in by])
    made = StructType([*kept.fields, *StructType.fromDDL("n_pixels long, mean_frp double, rings array<array<struct<x:double,y:double>>>").fields])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, k = int(pdf["__n"].sum()), int(pdf["__k"].sum())
        if n < least:
            return pd.DataFrame(columns=made.names)
        rings = outline([*zip(pdf["__x"].tolist(), pdf["__y"].tolist())], radius / cell)
        rings = [[{"x": (x + 0.5) * cell, "y": (y + 0.5) * cell} for x, y in r] for r in rings]
        row = {c: pdf[c].iloc[0] for c in by} | {"n_pixels": n, "mean_frp": float(pdf["__p"].sum()) / k if k else 0.0, "rings": rings}
        return pd.DataFrame([row], columns=made.names)

    return thin.groupBy(*by).applyInPandas(run, made)


def turned(ring: Column) -> Column:
    """The ring from its second point on, so that it pairs with itself as edges."""
    return F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))


def ring_sum(ring: Column, of) -> Column:
    return F.aggregate(F.zip_with(ring, turned(ring), of), F.lit(0.0), lambda a, v: a + v)


def measured(hulls: DataFrame, zone: int = 44) -> DataFrame:
    """``hulls`` with area_km2 and perimeter_km in the metres of a projection zone, and the centroid in degrees."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    metres = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(*(c.alias(n) for c, n in zip(utm(p["x"], p["y"], zone), ("x", "y"))))))
    sums = lambda rings, of: F.aggregate(F.transform(rings, of), F.lit(0.0), lambda a, v: a + v)
    out = hulls.withColumn("metres", metres)
    out = out.withColumns({
        "area_km2": sums("metres", lambda r: F.abs(ring_sum(r, cross)) / 2e6), "perimeter_km": sums("metres", lambda r: ring_sum(r, lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))) / 1e3),
        "__a": sums("rings", lambda r: ring_sum(r, cross)), "__x": sums("rings", lambda r: ring_sum(r, lambda p, q: (p["x"] + q["x"]) * cross(p, q))), "__y": sums("rings", lambda r: ring_sum(r, lambda p, q: (p["y"] + q["y"]) * cross(p, q))),
        "__first": F.flatten("rings"),
    })
    mean = lambda c: sums(F.array("__first"), lambda r: F.aggregate(F.transform(r, lambda p: p[c]), F.lit(0.0), lambda a, v: a + v)) / F.size("__first")
    flat = F.abs(F.col("__a")) < 1e-12  # a line or a point: the mean of its ends
    out = out.withColumns({"centre_lon": F.when(flat, mean("x")).otherwise(F.col("__x") / (3 * F.col("__a"))), "centre_lat": F.when(flat, mean("y")).otherwise(F.col("__y") / (3 * F.col("__a")))})
    return out.drop("metres", "__a", "__x", "__y", "__first")


def spread(perimeters: DataFrame, event: str, at: str) -> DataFrame:
    """From each perimeter of an event to the next: hours, growth, mean rate of spread, bearing, new pixels, new line length."""
    w = Window.partitionBy(event).orderBy(at)
    now, was = F.col, lambda c: F.lag(c).over(w)
    hours = (F.unix_timestamp(F.col(at).cast("timestamp")) - F.unix_timestamp(was(at).cast("timestamp"))) / 3600.0
    out = perimeters.select(
        event, at, hours.alias("h"), (now("area_km2") - was("area_km2")).alias("da"), was("perimeter_km").alias("p"), (now("perimeter_km") - was("perimeter_km")).alias("dp"),
        bearing(was("centre_lon"), was("centre_lat"), now("centre_lon"), now("centre_lat")).alias("b"), (now("n_pixels") - was("n_pixels")).alias("new_pixels"),
    ).filter("h > 0")
    return out.select(
        event, at, F.round("h", 2).alias("dt_hours"), F.round("da", 4).alias("area_change_km2"), F.round(F.when(F.col("p") > 0, F.col("da") / (F.col("p") * F.col("h"))).otherwise(0.0), 5).alias("cros_km_h"),
        F.round("b", 1).alias("bearing_deg"), "new_pixels", F.round(F.abs("dp") / 2, 3).alias("line_km"),
    )
