"""Predicates over pixels, classes and dates as Column expressions. Thresholds are parameters; those given are the usual ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loss_fires(d_trees: Column, least: float = 0.10) -> Column:
    return d_trees <= -least


def change_fires(d_trees: Column, least: float = 0.10) -> Column:
    return F.abs(d_trees) >= least


def unreliable(cloud_before: Column, cloud_after: Column, most: float = 0.4) -> Column:
    return F.greatest(cloud_before, cloud_after) > most


def bits_clear(qa: Column, bits: tuple[int, ...]) -> Column:
    """Whether none of the quality bits is set."""
    return qa.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0


def clear_scene_class(scl: Column) -> Column:
    """Scene classes that show the ground: dark, vegetation, bare, water and shadow of relief."""
    return scl.isin(2, 3, 4, 5, 6)


def candidate(ndvi_z: Column, tree_delta: Column, dw_z: Column, yearly_drop: Column, vh_drop: Column, z: float = -2.0, drop: float = 0.12, yearly: float = 0.15, vh: float = 2.0) -> Column:
    """Union of all signals at about 60 % of their thresholds (z-scores at 75 %); a missing signal does not count."""
    some = lambda c: F.coalesce(c, F.lit(False))
    return some(ndvi_z < z * 0.75) | some(tree_delta < -drop * 0.6) | some(dw_z < z * 0.75) | some(yearly_drop > yearly * 0.6) | some(vh_drop > vh * 0.6)


def deseasonalised_candidate(d_trees: Column, d_crops: Column, d_built: Column, expected: Column) -> Column:
    """Drop beyond the season's, which explains losses only, or a rise of crops or buildings."""
    return (d_trees - F.least(F.lit(0.0), expected) < -0.06) | (d_crops > 0.08) | (d_built > 0.06)


def vegetation_to(trees: Column, shrub: Column, after: Column, least: float = 0.5) -> Column:
    """Vegetation before, another class after."""
    return ((trees > 0.25) | (shrub > 0.35)) & (after > least)


def forest_loss(loss_year: Column, year: Column, cover: Column) -> Column:
    return (loss_year == year) & (cover >= 5) & loss_year.between(15, 24)


def disturbed_recently(alert: Column, day_index: Column, since: Column, until: Column) -> Column:
    """Confirmed alert whose day, counted from the last of 2018, lies in the window."""
    day = F.date_add(F.lit("2018-12-31").cast("date"), day_index.cast("int"))
    return (alert >= 2) & (day >= since) & (day <= until)


def seasonal_name(month: Column) -> Column:
    """The four seasons of leaf fall and flush."""
    return F.when(month.isin(11, 12, 1, 2), "dry_cool").when(month.isin(3, 4, 5), "dry_hot").when(month == 10, "post_monsoon").otherwise("monsoon")


def terrain_risk(slope: Column, aspect: Column, steep: float = 30.0, south: tuple[float, float] = (135.0, 225.0)) -> Column:
    """0 flat or north, 1 south, 2 steep, 3 both, 255 without data."""
    risk = (slope >= steep).cast("int") * 2 + aspect.between(*south).cast("int")
    return F.when((slope <= -9000) | (aspect <= -9000), 255).otherwise(risk)
