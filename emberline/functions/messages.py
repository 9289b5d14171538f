"""Texts of fire alerts, by severity and by what burns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, halves up; zero for null."""
    scale = 10**digits
    return F.format_string(f"%.{digits}f", F.floor(F.coalesce(c, F.lit(0.0)) * scale + 0.5) / scale)


def cover_tag(in_forest: Column, near_forest: Column, is_agri: Column, cover: Column) -> Column:
    """What burns, in brackets; nothing for an unknown cover. Null flags count as false."""
    known = F.when(F.coalesce(cover, F.lit("unknown")) != "unknown", F.concat(F.lit("["), F.upper(cover), F.lit("]")))
    return F.when(in_forest, "[FOREST FIRE]").when(near_forest, "[NEAR FOREST]").when(is_agri, "[AGRICULTURAL]").otherwise(F.coalesce(known, F.lit("")))


def alert_severity(severity: Column, in_forest: Column, near_forest: Column) -> Column:
    """CRITICAL becomes HIGH where it is certain that no forest is in or near; an unknown stays."""
    return F.when((severity == "CRITICAL") & (in_forest == F.lit(False)) & (near_forest == F.lit(False)), "HIGH").otherwise(severity)


def alert_message(severity: Column, category: Column, daynight: Column, lat: Column, lon: Column, frp: Column, fwi: Column, danger: Column, in_forest: Column, near_forest: Column, is_agri: Column, cover: Column) -> Column:
    """The text of an alert of ``severity`` (CRITICAL, HIGH, MODERATE, any other: LOW).

    The two higher ones name power and weather, the lower ones power and cover. ``daynight`` is day for D, night for others;
    null numbers are written as zero, a null cover as unknown, null categories and classes as empty texts.
    """
    time = F.when(daynight == "D", "daytime").otherwise("nighttime")
    at = F.concat(F.lit(" at "), _fixed(lat, 3), F.lit("N "), _fixed(lon, 3), F.lit("E — FRP="), _fixed(frp, 1), F.lit(" MW"))
    weather = F.concat(F.lit(", FWI="), _fixed(fwi, 1), F.lit(" ("), F.coalesce(danger, F.lit("")), F.lit("). "))
    kind, what = F.coalesce(category, F.lit("")), F.concat(F.lit(" ("), F.coalesce(cover, F.lit("unknown")), F.lit("). "))
    head = lambda name: F.concat(F.lit(f"{name} "), cover_tag(in_forest, near_forest, is_agri, cover), F.lit(": "))
    low = lambda name, action: F.concat(head(name), time, F.lit(" fire"), at, what, F.lit(action))
    wooded = F.coalesce(in_forest, F.lit(False)) | F.coalesce(near_forest, F.lit(False))
    return (
        F.when(severity == "CRITICAL", F.concat(head("CRITICAL"), kind, F.lit(" "), time, F.lit(" FOREST fire"), at, weather, F.lit("Immediate ground response required.")))
        .when((severity == "HIGH") & wooded, F.concat(head("HIGH"), kind, F.lit(" "), time, F.lit(" fire"), at, weather, F.lit("Deploy rapid response team.")))
        .when(severity == "HIGH", F.concat(head("HIGH"), time, F.lit(" fire"), at, weather, F.lit("Non-forest — monitor for spread to nearby vegetation.")))
        .when(severity == "MODERATE", low("MODERATE", "Monitor closely."))
        .otherwise(low("LOW", "Routine monitoring."))
    )
