"""Evidence of change and its fusion: patch scores with missing signals, tiers, composite scores, change classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import clip, logistic

#: Least evidence thresholds of the patch scorer.
THRESHOLDS = {"ndvi_z": -2.0, "ndvi": 0.15, "tree_drop": 0.12, "bare_rise": 0.08, "crop_rise": 0.10, "built_rise": 0.05, "vh": 2.0, "cusum": 0.50}
#: Weights of the patch scorer's evidence.
WEIGHTS = {"ndvi": 3.5, "trees_z": 3.0, "drop": 3.0, "bare": 2.5, "conversion": 1.5, "vh": 1.5, "cusum": 0.8}
#: Mean and spread of a band's natural change by season.
SEASONAL_NORMS = {
    "dry_cool": {"trees": (-0.18, 0.10), "grass": (-0.08, 0.07), "crops": (0.07, 0.09), "bare": (0.12, 0.09), "shrub_scrub": (-0.06, 0.07), "water": (0.00, 0.04), "built": (0.00, 0.03), "flooded_veg": (-0.03, 0.05)},
    "dry_hot": {"trees": (0.14, 0.10), "grass": (-0.06, 0.08), "crops": (-0.14, 0.11), "bare": (0.08, 0.09), "shrub_scrub": (0.05, 0.07), "water": (-0.02, 0.05), "built": (0.00, 0.03), "flooded_veg": (-0.02, 0.04)},
    "monsoon": {"trees": (0.08, 0.07), "grass": (0.18, 0.13), "crops": (0.22, 0.14), "bare": (-0.16, 0.10), "shrub_scrub": (0.08, 0.07), "water": (0.05, 0.08), "built": (0.00, 0.03), "flooded_veg": (0.08, 0.09)},
    "post_monsoon": {"trees": (-0.05, 0.07), "grass": (-0.07, 0.08), "crops": (-0.12, 0.10), "bare": (0.07, 0.07), "shrub_scrub": (-0.03, 0.06), "water": (-0.03, 0.06), "built": (0.00, 0.03), "flooded_veg": (-0.05, 0.06)},
}
#: True classes that fit an alert's source class.
SOURCE_CLASSES = {"Trees": ("deforestation", "encroachment"), "Bare": ("deforestation",), "Crops": ("encroachment",), "Shrub and Scrub": ("deforestation", "encroachment"), "Built": (), "Grass": ()}


def seasonal_z(delta: Column, season: Column, band: str) -> Column:
    """Change in spreads from the season's natural change of a band; unknown seasons leave it as it is."""
    out = delta
    for name, norms in SEASONAL_NORMS.items():
        mean, spread = norms[band]
        out = F.when(season == name, (delta - mean) / spread).otherwise(out)
    return out


def drop_evidence(before: Column, after: Column, mean: Column, std: Column, cloud: Column) -> Column:
    """Evidence of tree loss from one pass to the next, lifted below the baseline and weighted by clouds."""
    drop = F.greatest(F.lit(0.0), before - after)
    z = (after - F.greatest(before, mean)) / F.greatest(std, F.lit(0.05))
    lifted = logistic(drop, 0.05 + before * 0.10, 25) * (1 + F.greatest(F.lit(0.0), -z) / 4 * logistic(drop, 0.08, 40))
    return F.least(lifted, F.lit(1.0)) * (1 - logistic(cloud, 0.60, 15))


def with_patch_confidence(df: DataFrame, p: dict[str, Column], dry: Column, t: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Add ``confidence``: weighted evidence of a patch, 0 to 0.95, by the signals that are there; 0 without any.

    ``p`` holds ndvi_z, dndvi, dw_z, trees_delta, drop (evidence of ``drop_evidence`` or null), bare, crops, built, vh, cusum.
    Evidence and means are columns of their own for a while, so each is computed once.
    """
    ndvi = F.when(p["ndvi_z"].isNotNull(), F.when(~(dry & (p["ndvi_z"] > -0.5)), logistic(-p["ndvi_z"], -t["ndvi_z"], 1.5)))
    ndvi = F.when(p["ndvi_z"].isNull(), F.when(~(dry & (p["dndvi"] > -0.05)), logistic(p["dndvi"], t["ndvi"], 8))).otherwise(ndvi)
    rise = F.greatest(F.coalesce(p["crops"] / t["crop_rise"], F.lit(0.0)), F.coalesce(p["built"] / t["built_rise"], F.lit(0.0)))
    evidence = {
        "ndvi": ndvi,
        "trees_z": F.when(~(dry & (p["dw_z"] > -0.5)), logistic(-p["dw_z"], -t["ndvi_z"], 1.5)),
        "drop": F.coalesce(p["drop"], logistic(-p["trees_delta"], t["tree_drop"], 15)),
        "bare": logistic(p["bare"], t["bare_rise"], 15) * F.when(p["trees_delta"] <= -0.04, 1.0).otherwise(0.4),
        "conversion": F.when((p["crops"].isNotNull() | p["built"].isNotNull()) & (p["trees_delta"] < -t["tree_drop"] * 0.4), logistic(rise, 1.0, 2)),
        "vh": logistic(-p["vh"], F.when(dry, t["vh"]).otherwise(t["vh"] * 0.75), 0.8) * F.when(dry, 0.6).otherwise(0.5),
        "cusum": logistic(p["cusum"], F.when(dry, t["cusum"]).otherwise(t["cusum"] * 0.80), 4) * F.when(dry, 0.5).otherwise(0.7),
    }
    greener = F.when(~dry & (p["trees_delta"] < -0.08) & (p["ndvi_z"] > 0.3), 0.55).otherwise(1.0)
    x = df.withColumns({f"__{k}": e for k, e in evidence.items()} | {"__greener": greener, "__rougher": F.coalesce(p["vh"] > 2.0, F.lit(False))})

    def mean(otherwise: float | None, *signals: str) -> Column:
        add, e = lambda a, b: a + b, {k: F.col(f"__{k}") for k in signals}
        weight = reduce(add, (F.when(c.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, c in e.items()))
        return F.when(weight > 0, reduce(add, (F.coalesce(c * WEIGHTS[k], F.lit(0.0)) for k, c in e.items())) / weight).otherwise(F.lit(otherwise))

    seasonal, instant, radar = ("ndvi", "trees_z"), ("drop", "bare", "conversion"), ("vh", "cusum")
    x = x.withColumns({"__s": mean(None, *seasonal), "__i": mean(None, *instant), "__r": mean(None, *radar), "__o": mean(0.5, *seasonal, *instant), "__all": mean(None, *seasonal, *instant, *radar)})
    s, i, r = F.col("__s"), F.col("__i"), F.col("__r")
    agreement = F.when(s.isNull() | i.isNull(), 1.0).when((s >= 0.60) & (i >= 0.60), 1.25).when((s >= 0.55) | (i >= 0.55), 1.0).otherwise(0.85)
    x = x.withColumn("__agreement", agreement)
    agreement = F.when(r >= 0.58, F.least(F.col("__agreement") * 1.15, F.lit(1.50))).otherwise(F.col("__agreement"))
    penalty = F.least(F.col("__greener"), F.when(F.col("__rougher") & (F.col("__o") > 0.55), 0.75).otherwise(1.0))
    return x.select(*df.columns, F.coalesce(clip(F.col("__all") * agreement * penalty, 0.0, 0.95), F.lit(0.0)).alias("confidence"))


def tiers(ndvi: Column, yearly: Column, nbr: Column, vh: Column, cusum: Column, tree_drop: Column, conversion: Column, dw_z: Column) -> Column:
    """Tier of fused signals (flags): 1 agreement of optics and radar, 2 part of it, 3 radar alone, 0 none."""
    optical = ndvi | yearly
    first = (optical & nbr & vh & cusum) | (ndvi & dw_z) | (tree_drop & conversion & vh)
    second = (optical & nbr & vh) | (tree_drop & vh) | dw_z
    return F.when(first, 1).when(second, 2).when(vh & cusum, 3).otherwise(0)


def composite_score(confidence: Column, z: Column, cusum: Column, area: Column) -> Column:
    c = F.when(confidence.isNull() | (confidence == 0), 0.65).otherwise(confidence)
    z0, s0, a0 = (F.coalesce(x, F.lit(0.0)) for x in (z, cusum, area))
    return clip(c * 0.30 + (F.abs(z0) - 1.5) * 0.09 + s0 * 0.25 + F.least(a0, F.lit(3.0)) * 0.04, 0.30, 0.99)


def patch_change(trees: Column, gains: dict[str, Column]) -> Column:
    """Change type of a patch from its mean changes; of equal gains the first in the order given counts."""
    top = F.greatest(*gains.values())
    names = {"crops": "Encroachment", "built": "Built expansion", "bare": "Clearing", "shrub_scrub": "Degradation", "grass": "Degradation"}
    kind = reduce(lambda out, g: F.when(gains[g] == top, names[g]).otherwise(out), reversed(list(gains)), F.lit(None).cast("string"))
    loss = F.when(top > 0.03, kind).otherwise("Tree loss (unclassified)")
    return F.when(trees > 0.05, "Greening").when(trees < -0.05, loss).otherwise("Other change")


def truth_class(trees: Column, crops: Column, bare: Column, built: Column, shrub: Column, grass: Column) -> Column:
    """0 none, 1 encroachment, 2 degradation, 3 other loss, 4 greening."""
    loss = trees < -0.15
    return F.when(loss & ((crops > 0.10) | (built > 0.10)), 1).when(loss & ((bare > 0.10) | (shrub > 0.10) | (grass > 0.10)), 2).when(loss, 3).when(trees > 0.15, 4).otherwise(0)


def source_agrees(source: Column, truth: Column) -> Column:
    return F.coalesce(reduce(lambda out, s: F.when(source == s, truth.isin(*SOURCE_CLASSES[s]) if SOURCE_CLASSES[s] else F.lit(False)).otherwise(out), SOURCE_CLASSES, F.lit(False)), F.lit(False))


def exaggeration(claimed: Column, true: Column, alert: float = 0.10) -> Column:
    """How much louder an alert is than the truth; 999 for an alert without any change, 0 for none of both."""
    return F.when(F.abs(true) > 0.01, F.abs(claimed) / F.abs(true)).when(F.abs(claimed) > alert, 999.0).otherwise(0.0)


def residual_verdict(residual: Column) -> Column:
    return F.when(residual > 0.15, "STRONG").when(residual > 0.08, "MODERATE").when(residual > 0.03, "WEAK").otherwise("SUPPRESS")


def friction(road: Column, edge: Column, slope: Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    """Risk near roads and edges of loss, less on slopes; null at distance 0."""
    return F.try_divide(F.lit(weights[0]), road) + F.try_divide(F.lit(weights[1]), edge) + weights[2] / (slope + 1)
