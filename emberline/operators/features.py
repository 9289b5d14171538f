"""Feature sets of a pixel window: 23 of a single window, 30 with what came before, 84 with shares, spectra and trajectories."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .grid import focal_table

#: The order of the classes (a class's place is its code) and the change class of the class that gained most.
BANDS = ("water", "trees", "grass", "flooded_veg", "crops", "shrub_scrub", "built", "bare")
GAIN_CLASS = {"water": 6, "grass": 3, "flooded_veg": 6, "crops": 1, "shrub_scrub": 4, "built": 2, "bare": 6}
PURE_LOSS = 5
SPECTRA, REFLECTANCES = ("ndvi", "nbr", "ndmi"), ("red", "nir", "swir1", "swir2")
SIDES = ("before", "after")


def _past(df: DataFrame, order: list[str], alert: Column, enriched: bool) -> DataFrame:
    """State of a pixel before each of its windows, in one pass over them."""
    w = Window.partitionBy("row", "col").orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__nth", F.row_number().over(w))
    so_far = lambda c: F.coalesce(c.over(past), F.lit(0.0))
    made = {
        "cum_alert_count": so_far(F.sum(alert.cast("double"))), "cum_delta_trees": so_far(F.sum("delta_trees")), "max_loss_so_far": F.least(F.lit(0.0), so_far(F.min("delta_trees"))),
        "windows_since_first_alert": F.coalesce(F.col("__nth") - F.min(F.when(alert, F.col("__nth"))).over(past), F.lit(-1)).cast("double"),
    }
    if not enriched:
        return df.withColumns(made).drop("__nth")
    step = {s: F.col(f"{s}_after") - F.col(f"{s}_before") for s in ("ndvi", "nbr")}
    df = df.withColumn("__run", F.sum(step["ndvi"]).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns(
        made | {
            "cum_delta_ndvi": so_far(F.sum(step["ndvi"])), "max_ndvi_loss_so_far": F.least(F.lit(0.0), so_far(F.min("__run"))), "cum_delta_nbr": so_far(F.sum(step["nbr"])),
            "ndvi_at_first_alert": F.coalesce(F.first(F.when(alert, F.col("ndvi_before")), ignorenulls=True).over(past), F.lit(0.0)),
        }
    )
    recovered = F.col("cum_delta_ndvi") - F.col("max_ndvi_loss_so_far") > 0.05
    return df.withColumn("ndvi_recovery_flag", recovered.cast("double")).drop("__nth", "__run")


def _first_of(values: list[Column], value: Column) -> Column:
    return F.array_position(F.array(*values), value) - 1


def window_features(stack: DataFrame, window: str, date_before: str, kind: str = "enriched", threshold: float = 0.10, date_after: str | None = None) -> DataFrame:
    """``window``, ``row``, ``col`` and the features of each pixel window of ``stack``, all double.

    ``kind`` is "single" (23 features, alerts are changes of either sign), "history" (30) or "enriched" (84); in the last two
    only losses alert. All read ``delta_<band>``, ``cloud_before`` and ``cloud_after``; "enriched" also ``<band>_before`` and
    ``_after``, the same of ndvi, nbr, ndmi, red, nir, swir1 and swir2, and ``date_after`` (null or not given: a window of 30 days).
    Month and season are those of ``date_before`` (null: January). Neighbours come from tiles of one window, the past from one pass over a pixel's windows in order of ``window``. Missing
    cells and null changes count 0 for their neighbours; a pixel's own null gives null where it is used, never a lost row.
    A pixel repeated in a window is one cell for its neighbours, and each of its rows has the others, in no set order, in its
    past. Of equal gains or shares the first class counts. Other columns of ``stack`` are not read.
    """
    if kind not in ("single", "history", "enriched"):
        raise ValueError(f"no feature set is called {kind}")
    enriched = kind == "enriched"
    d = {b: F.col(f"delta_{b}") for b in BANDS}
    trees = d["trees"]
    alert = (F.abs(trees) if kind == "single" else -trees) >= threshold
    sides = [f"{c}_{s}" for c in (*BANDS, *SPECTRA, *REFLECTANCES) for s in SIDES] if enriched else []
    ended = F.col(date_after) if date_after else F.lit(None).cast("date")
    x = stack.select(window, "row", "col", *d.values(), "cloud_before", "cloud_after", *sides, F.col(date_before).alias("__from"), ended.alias("__to"), F.coalesce(alert, F.lit(False)).alias("__alert"))
    # only what neighbours need goes through the tiles; the wide rows meet it in the one exchange by pixel that the past needs too
    place = [window, "row", "col"]
    near = x.groupBy(*place).agg(F.min("delta_trees").alias("delta_trees"), F.max("__alert").alias("__alert"))
    near = focal_table(near, "delta_trees", "__alert", (3,) if kind == "single" else (3, 5, 7), by=(window,)).drop("delta_trees", "__alert")
    both = x.withColumn("__own", F.lit(True)).unionByName(near, allowMissingColumns=True).repartition("row", "col")
    here = Window.partitionBy("row", "col", window)
    x = both.withColumns({c: F.max(c).over(here) for c in near.columns if c not in place}).filter("__own").drop("__own")
    if kind != "single":
        x = _past(x, [window], F.col("__alert"), enriched)

    flag = lambda c: c.cast("double")
    gains = [F.lit(-999.0) if b == "trees" else d[b] for b in BANDS]
    top, month = F.greatest(*gains), F.coalesce(F.month("__from"), F.lit(1))
    season = S.season(month)
    x = x.withColumns({"__top": top, "__gain": _first_of(gains, top)})
    strength = [F.abs(c) for c in d.values()]
    out: dict[str, Column] = {f"delta_{b}": d[b] for b in BANDS}
    if enriched:
        out |= {f"{b}_{s}": F.col(f"{b}_{s}") for s in SIDES for b in BANDS}
        out |= {f"{c}_{s}": F.col(f"{c}_{s}") for group in (SPECTRA, REFLECTANCES) for s in SIDES for c in group}
        out |= {f"delta_{c}": F.col(f"{c}_after") - F.col(f"{c}_before") for c in SPECTRA}
    out |= {"cloud_before": F.col("cloud_before"), "cloud_after": F.col("cloud_after"), "cloud_worst": F.greatest("cloud_before", "cloud_after")}
    out |= {"n_neighbors_alert": flag(F.least(F.lit(8), "neighbours")), "mean_neighbor_trees": F.col("mean3"), "std_neighbor_trees": F.col("std3")}
    if kind != "single":
        out |= {"delta_trees_5x5_mean": F.col("mean5"), "delta_trees_7x7_mean": F.col("mean7")}
    out |= {"trees_crops_anti": flag((trees < 0) & (d["crops"] > 0)), "trees_bare_anti": flag((trees < 0) & (d["bare"] > 0)), "dominant_gain_band": flag(F.col("__gain"))}
    if enriched:
        gained = F.when((trees <= -0.30) & (F.col("__top") < 0.05), PURE_LOSS)
        for i, b in enumerate(BANDS):
            if b in GAIN_CLASS:
                gained = gained.when(F.col("__gain") == i, GAIN_CLASS[b])
        x = x.withColumn("__class", gained.cast("double"))
        out["dominant_gain_class"] = F.col("__class")
    out["band_diversity"] = flag(reduce(add, ((s > threshold).cast("int") for s in strength)))
    if kind != "single":
        out["tree_loss_ratio"] = F.abs(trees) / (F.abs(trees) + F.abs(d["crops"]) + F.abs(d["bare"]) + 1e-6)
    out |= {"abs_delta_trees": F.abs(trees), "abs_max_band": F.greatest(*strength)}
    if enriched:
        out |= _transitions(season, gains)
    if kind != "single":
        out |= {c: F.col(c) for c in ("cum_alert_count", "cum_delta_trees", "max_loss_so_far", "windows_since_first_alert")}
    if enriched:
        out |= {c: F.col(c) for c in ("cum_delta_ndvi", "max_ndvi_loss_so_far", "ndvi_at_first_alert", "cum_delta_nbr", "ndvi_recovery_flag")}
    out |= {"month": flag(month), "is_monsoon": flag(season == "Monsoon"), "is_winter": flag(season == "Winter")}
    return x.select(window, "row", "col", *(c.alias(name) for name, c in out.items()))


def _transitions(season: Column, gains: list[Column]) -> dict[str, Column]:
    """Confidence, class transitions, seasons of classes, built-up index and the window's length."""
    shares = {s: [F.col(f"{b}_{s}") for b in BANDS] for s in SIDES}
    before_class = _first_of(shares["before"], F.greatest(*shares["before"])).cast("double")
    lead = F.sort_array(F.array(*gains), asc=False)
    built_up = {s: (F.col(f"swir1_{s}") - F.col(f"nir_{s}")) / (F.col(f"swir1_{s}") + F.col(f"nir_{s}") + 2e-6) for s in SIDES}
    in_season = lambda name, c: ((season == name) & (F.col("__class") == c)).cast("double")
    return {
        "relative_tree_loss": F.col("delta_trees") / (F.col("trees_before") + 1e-6),
        **{f"dw_entropy_{s}": S.entropy(*(p + 1e-8 for p in shares[s]), eps=0.0) for s in SIDES},
        "dw_before_class": before_class, "dominant_gain_value": F.col("__top"), "gain_gap": lead[0] - lead[1], "transition_type": before_class * 10 + F.col("__class"),
        "monsoon_x_grass": in_season("Monsoon", GAIN_CLASS["grass"]), "monsoon_x_shrub": in_season("Monsoon", GAIN_CLASS["shrub_scrub"]), "winter_x_crops": in_season("Winter", GAIN_CLASS["crops"]),
        **{f"ndbi_{s}": built_up[s] for s in SIDES}, "delta_ndbi": built_up["after"] - built_up["before"],
        "window_duration_days": F.coalesce(F.datediff("__to", "__from"), F.lit(30)).cast("double"), "alert_rate": F.col("cum_alert_count") / (F.greatest(F.col("cum_alert_count") - 1, F.lit(0.0)) + 1),
    }
