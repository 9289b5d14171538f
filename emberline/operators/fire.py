"""Fire operators: the daily fire-weather index, links of fires to scars, bulletins."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fwi_class

START = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0}
#: Effective day lengths for DMC (about 24 degrees north) and day-length factors for DC, January to December.
DMC_DAY_LENGTH = (6.4, 7.5, 9.0, 10.4, 11.4, 11.4, 11.4, 10.2, 9.0, 7.7, 6.8, 6.2)
DC_FACTOR = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)


def next_ffmc(temp: float, rh: float, wind: float, rain: float, last: float) -> float:
    """Fine fuel moisture code by the Canadian system's published equations."""
    m = 147.2 * (101 - last) / (59.5 + last)
    if rain > 0.5:
        r = rain - 0.5
        extra = 0.0015 * (m - 150) ** 2 * math.sqrt(r) if m > 150 else 0.0
        m = min(250.0, m + 42.5 * r * math.exp(-100 / (251 - m)) * (1 - math.exp(-6.93 / r)) + extra)
    dry = 0.942 * rh**0.679 + 11 * math.exp((rh - 100) / 10) + 0.18 * (21.1 - temp) * (1 - math.exp(-0.115 * rh))
    wet = 0.618 * rh**0.753 + 10 * math.exp((rh - 100) / 10) + 0.18 * (21.1 - temp) * (1 - math.exp(-0.115 * rh))
    speed = 0.581 * math.exp(0.0365 * temp)
    if m > dry:
        x = rh / 100
        m = dry + (m - dry) * 10 ** (-(0.424 * (1 - x**1.7) + 0.0694 * math.sqrt(wind) * (1 - x**8)) * speed)
    elif m < wet:
        x = (100 - rh) / 100
        m = wet - (wet - m) * 10 ** (-(0.424 * (1 - x**1.7) + 0.0694 * math.sqrt(wind) * (1 - x**8)) * speed)
    m = max(0.0, min(m, 250.0))
    return 59.5 * (250 - m) / (147.2 + m)


def next_dmc(temp: float, rh: float, rain: float, month: int, last: float) -> float:
    """Duff moisture code."""
    if rain > 1.5:
        moisture = 20 + math.exp(5.6348 - last / 43.43)
        b = 100 / (0.5 + 0.3 * last) if last <= 33 else 14 - 1.3 * math.log(last) if last <= 65 else 6.2 * math.log(last) - 17.2
        r = 0.92 * rain - 1.27
        last = max(0.0, 244.72 - 43.43 * math.log(moisture + 1000 * r / (48.77 + b * r) - 20))
    return last + (1.894 * (temp + 1.1) * (100 - rh) * DMC_DAY_LENGTH[month - 1] * 1e-4 if temp > -1.1 else 0.0)


def next_dc(temp: float, rain: float, month: int, last: float) -> float:
    """Drought code."""
    if rain > 2.8:
        q = 800 * math.exp(-last / 400) + 3.937 * (0.83 * rain - 1.27)
        last = max(0.0, 400 * math.log(800 / q))
    return max(0.0, last + (0.36 * (temp + 2.8) + DC_FACTOR[month - 1] if temp >= -2.8 else 0.0) / 2)


def step_codes(codes: tuple[float, float, float], temp: float, rh: float, wind: float, rain: float, month: int) -> tuple[float, float, float]:
    rh, wind, rain = min(100.0, max(0.0, rh)), max(0.0, wind), max(0.0, rain)
    return next_ffmc(temp, rh, wind, rain, codes[0]), next_dmc(temp, rh, rain, month, codes[1]), next_dc(temp, rain, month, codes[2])


def fire_weather(weather: DataFrame, key: str = "station") -> DataFrame:
    """Codes and indices per station and day. The recurrence runs in date order in one task a station; the rest is native."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        codes, rows, year = tuple(START.values()), [], None
        for r in pdf.itertuples():
            if year is not None and r.date.year != year:  # a year starts from the codes as they were stored
                codes = tuple(round(c, 1) for c in codes)
            year = r.date.year
            codes = step_codes(codes, r.temp_c, r.rh_pct, r.wind_kmh, r.precip_mm, r.date.month)
            rows.append(codes)
        return pdf.assign(ffmc=[c[0] for c in rows], dmc=[c[1] for c in rows], dc=[c[2] for c in rows])

    kind = dict(weather.dtypes)[key]
    out = weather.select(key, "date", "temp_c", "rh_pct", "wind_kmh", "precip_mm").groupBy(key).applyInPandas(
        run, f"{key} {kind}, date date, temp_c double, rh_pct double, wind_kmh double, precip_mm double, ffmc double, dmc double, dc double"
    )
    return with_indices(out)


def with_indices(codes: DataFrame) -> DataFrame:
    """ISI, BUI, FWI and danger class from the codes."""
    m = 147.2 * (101 - F.col("ffmc")) / (59.5 + F.col("ffmc"))
    isi = 0.208 * F.exp(0.05039 * F.greatest(F.col("wind_kmh"), F.lit(0.0))) * 91.9 * F.exp(-0.1386 * m) * (1 + F.pow(m, 5.31) / 4.93e7)
    p, d = F.col("dmc"), F.col("dc")
    base = p + 0.4 * d
    bui = F.when(base <= 0, 0.0).when(p <= 0.4 * d, 0.8 * p * d / base).otherwise(p - (1 - 0.8 * d / base) * (0.92 + F.pow(0.0114 * p, 1.7)))
    out = codes.withColumn("isi", isi).withColumn("bui", F.greatest(F.lit(0.0), bui))
    fd = F.when(F.col("bui") <= 80, 0.626 * F.pow("bui", 0.809) + 2).otherwise(1000 / (25 + 108.64 * F.exp(-0.023 * F.col("bui"))))
    b = 0.1 * F.col("isi") * fd
    fwi = F.when(b > 1, F.exp(2.72 * F.pow(0.434 * F.log(b), 0.647))).otherwise(b)
    return out.withColumn("fwi", fwi).withColumn("danger_class", fwi_class(F.col("fwi")))


def best_causal_fire(candidates: DataFrame, scene: str | list[str], hit: str, date: str, frp: str, distance: str) -> DataFrame:
    """One fire a scene (a column or several): direct hits by date and falling power, else the nearest."""
    order = [
        F.col(hit).desc(), F.when(F.col(hit), F.col(date)).asc_nulls_last(), F.when(F.col(hit), F.col(frp)).desc_nulls_last(),
        F.col(distance).asc_nulls_last(), F.col(date), F.col("fire_id"),
    ]
    return candidates.withColumn("__n", F.row_number().over(Window.partitionBy(scene).orderBy(*order))).filter("__n = 1").drop("__n")
