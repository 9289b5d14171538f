"""Scalar functions as Column expressions; they stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day of year at each month's centre.
MONTH_CENTRES = (15, 46, 75, 106, 136, 167, 197, 228, 259, 289, 320, 350)
#: The other land-cover classes in the order that breaks ties of equal gains.
GAIN_ORDER = ("crops", "bare", "built", "shrub_scrub", "grass")


def clip(c: Column, low: float, high: float) -> Column:
    """Held within bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def logistic(x: Column, midpoint: Column | float, steepness: Column | float) -> Column:
    """1 / (1 + exp(-k (x - m))), with the exponent held within +-60; null for null."""
    m = midpoint if isinstance(midpoint, Column) else F.lit(float(midpoint))
    k = steepness if isinstance(steepness, Column) else F.lit(float(steepness))
    return 1 / (1 + F.exp(-clip(k * (x - m), -60.0, 60.0)))


def normalised_difference(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return clip((a - b) / (a + b + eps), -1.0, 1.0)


def entropy(*shares: Column, eps: float = 1e-8) -> Column:
    return -sum((p * F.log(p + eps) for p in shares[1:]), shares[0] * F.log(shares[0] + eps))


def dominant(values: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Name of the largest value (the first of equal ones), the value, and its lead over the runner-up."""
    pairs = F.array(*(F.struct((-v).alias("v"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, v) in enumerate(values.items())))
    ranked = F.sort_array(pairs)
    return ranked[0]["name"], -ranked[0]["v"], ranked[1]["v"] - ranked[0]["v"]


def safe_float(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(math.inf)), None).otherwise(c)


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Pre-monsoon").when(month.isin(6, 7, 8, 9), "Monsoon").otherwise("Post-monsoon")


def is_dry_season(month: Column) -> Column:
    return ~month.between(6, 10)


def in_fire_season(date: Column) -> Column:
    """1 March to 15 June."""
    return F.month(date).isin(3, 4, 5) | ((F.month(date) == 6) & (F.dayofmonth(date) <= 15))


def frp_bin(frp: Column) -> Column:
    """Right-closed bins; 0 and below is null."""
    return F.when(frp <= 0, None).when(frp <= 10, "low").when(frp <= 50, "moderate").when(frp <= 200, "high").when(frp > 200, "extreme")


def frp_severity(frp: Column) -> Column:
    return F.when(frp < 5, "minor").when(frp < 15, "moderate").when(frp < 40, "major").otherwise("extreme")


def frp_category(frp: Column) -> Column:
    """Class of a fire's power in megawatts; null counts as none."""
    return F.when(frp >= 50, "INFERNO").when(frp >= 20, "INTENSE").when(frp >= 5, "ACTIVE").when(frp >= 1, "MINOR").otherwise("TRACE")


def fwi_class(fwi: Column) -> Column:
    """Danger class; cuts at 5, 11.2, 21.3 and 38."""
    return F.when(fwi < 5, "Low").when(fwi < 11.2, "Moderate").when(fwi < 21.3, "High").when(fwi < 38, "Very High").otherwise("Extreme")


def combined_severity(fwi: Column, frp: Column) -> Column:
    return (
        F.when((fwi >= 38) & (frp >= 5), "CRITICAL").when((fwi >= 21.3) | (frp >= 20), "HIGH")
        .when((fwi >= 11.2) | (frp >= 5), "MODERATE").otherwise("LOW")
    )


def score_label(score: Column, high: float = 0.70, medium: float = 0.45, low: float = 0.25) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").when(score >= low, "LOW").otherwise("NO ALERT")


def hhmm_minutes(hhmm: Column) -> Column:
    return F.floor(hhmm / 100).cast("int") * 60 + hhmm % 100


def utc_to_ist(hhmm: Column) -> Column:
    """HHMM in UTC to HH:MM in IST (+330 minutes, modulo a day)."""
    m = (hhmm_minutes(hhmm) + 330) % 1440
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def tier(confidence: Column, spatial_hit: Column) -> Column:
    """Label tier of a fire-scar link."""
    return (
        F.when((confidence == "HIGH") & spatial_hit, "GOLD").when((confidence == "MEDIUM-HIGH") & spatial_hit, "SILVER")
        .when(confidence == "MEDIUM", "BRONZE").when(confidence.isin("LOW-MEDIUM", "LOW"), "VIIRS_ONLY").otherwise("EXCLUDE")
    )


def link_confidence(hit: Column, near: Column, gap: Column) -> Column:
    """Confidence that a detection caused a scar, from hit, nearness (< 500 m) and days between."""
    return (
        F.when(hit & (gap <= 10), "HIGH").when(hit & (gap <= 30), "MEDIUM-HIGH").when(hit & (gap <= 60), "MEDIUM")
        .when(near & (gap <= 10), "MEDIUM").when(near & (gap <= 30), "LOW-MEDIUM").when(gap <= 60, "LOW").otherwise("NONE")
    )


def change_type(gains: dict[str, Column], d_trees: Column, least: float = 0.05) -> Column:
    """Change type of a patch: the class that gained most, or plain loss."""
    name, value, _ = dominant({k: gains[k] for k in GAIN_ORDER if k in gains})
    return F.when(value > least, F.concat(F.lit("trees_to_"), name)).when(d_trees <= -least, "tree_loss").otherwise("mixed")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * 6371000.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle bearing, 0 to 360 degrees."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) by the transverse Mercator series on WGS 84."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, x = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * dl
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = 500000.0 + k0 * n * (x + (1 - t + c) * F.pow(x, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(x, 5) / 120)
    north = k0 * (m + n * F.tan(phi) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(x, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(x, 6) / 720))
    return east, north


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of structs (x, y), open or closed."""

    def area(r: Column) -> Column:
        after = F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1))
        cross = F.zip_with(r, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
        return F.when(F.size(r) > 0, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(0.0)

    # bound once, so that a ring that is itself an expression is not made for each of its uses
    return F.element_at(F.transform(F.array(ring), area), 1)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether a point is inside a ring of structs (x, y)."""
    before = F.concat(F.slice(ring, F.size(ring), F.lit(1)), F.slice(ring, F.lit(1), F.size(ring) - 1))
    crossed = F.zip_with(ring, before, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]))
    return F.aggregate(crossed, F.lit(False), lambda s, v: s != F.coalesce(v, F.lit(False)))


def doy_value(doy: Column, monthly: list[float]) -> Column:
    """Linear blend of the two months whose centres bracket a day of year; December runs on into January."""
    points = [*zip(MONTH_CENTRES, monthly), (380, monthly[0])]
    d = F.when(doy < MONTH_CENTRES[0], doy + 365).otherwise(doy)
    out = F.lit(float(monthly[0]))
    for (d0, v0), (d1, v1) in reversed(list(zip(points, points[1:]))):
        out = F.when((d >= d0) & (d <= d1), v0 + (v1 - v0) * (d - d0) / float(d1 - d0)).otherwise(out)
    return out


def harmonic(coefficients: Column, doy: Column, period: float = 365.25) -> Column:
    """a0 + a1 cos + b1 sin + a2 cos 2 + b2 sin 2 of the year's angle."""
    w = doy * (2 * math.pi / period)
    return coefficients[0] + coefficients[1] * F.cos(w) + coefficients[2] * F.sin(w) + coefficients[3] * F.cos(2 * w) + coefficients[4] * F.sin(2 * w)


def burn_age(days: Column) -> dict[str, Column]:
    """Encodings of the days since the last scar; null (never) is 0."""
    return {
        "recent": F.coalesce(F.exp(-days / 180.0), F.lit(0.0)),
        "regrowth": F.coalesce(F.exp(-F.pow((days - 730) / 365.0, 2)), F.lit(0.0)),
        "old": F.coalesce(logistic(days, 1825.0, 1 / 180.0), F.lit(0.0)),
    }


def fire_weather_proxy(temp_c: Column, rh: Column, precip: Column) -> Column:
    return clip(100 - rh / 2 + (temp_c - 20) / 5 - 2 * precip, 0.0, 100.0)


def wind(u: Column, v: Column) -> tuple[Column, Column]:
    """Speed, and the direction the wind comes from in degrees from north."""
    return F.sqrt(u * u + v * v), F.pmod(270 - F.degrees(F.atan2(v, u)), F.lit(360.0))


def decibels(power: Column) -> Column:
    return 10 * F.log10(power)


def tolerant_date(s: Column) -> Column:
    """A date in any of the spellings 2024-01-31, 20240131 and 31/01/2024; null for others."""
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in ("yyyy-MM-dd", "yyyyMMdd", "dd/MM/yyyy"))).cast("date")


def clipped(ring: Column, left: Column, low: Column, right: Column, high: Column) -> Column:
    """Ring (array of structs x, y) clipped to a box, one side after the other; empty where nothing is left."""

    def side(points: Column, axis: str, other: str, bound: Column, keep_above: bool) -> Column:
        inside = lambda p: p[axis] >= bound if keep_above else p[axis] <= bound
        before = F.concat(F.slice(points, F.size(points), F.lit(1)), F.slice(points, F.lit(1), F.size(points) - 1))

        def step(q: Column, p: Column) -> Column:
            cut = q[other] + (p[other] - q[other]) * (bound - q[axis]) / F.nullif(p[axis] - q[axis], F.lit(0.0))
            at = F.struct(bound.alias("x"), cut.alias("y")) if axis == "x" else F.struct(cut.alias("x"), bound.alias("y"))
            crossing = F.when(inside(p) != inside(q), F.array(at)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
            return F.concat(crossing, F.when(inside(p), F.array(p)).otherwise(F.array().cast("array<struct<x:double,y:double>>")))

        out = F.flatten(F.zip_with(before, points, step))
        return F.when(F.coalesce(F.forall(points, inside), F.lit(False)), points).otherwise(out)  # also where no point is left

    def of(*how):
        return lambda r: side(r, *how)

    for axis, other, bound, above in (("x", "y", left, True), ("x", "y", right, False), ("y", "x", low, True), ("y", "x", high, False)):
        # bound once, so that the sides do not multiply
        ring = F.element_at(F.transform(F.array(ring), of(axis, other, bound, above)), 1)
    return ring


def wkt_ring(text: Column) -> Column:
    """Outer ring of a POLYGON in well-known text as an array of structs (x, y)."""
    inner = F.regexp_extract(text, r"\(\(([^)]*)\)", 1)
    return F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))
