"""Change scorers as Column expressions. Day-of-year baselines are monthly means blended between month centres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import doy_value, logistic, score_label

THREATS = ("CANOPY_LOSS", "CROP_ENCROACHMENT", "BUILT_ENCROACHMENT")


def plain_score(delta: Column, z: Column, cloud: Column) -> Column:
    """Loss logistic, lifted by a negative z, times the clear share."""
    return F.least(logistic(-delta, 0.12, 18) * (1 + F.greatest(F.lit(0.0), -z) / 4), F.lit(1.0)) * F.greatest(F.lit(0.0), 1 - cloud)


def seasonal_drop(before: Column, after: Column, mean0: Column, mean1: Column) -> Column:
    """Drop beyond what the season explains; a seasonal rise explains nothing."""
    return F.greatest(F.lit(0.0), -(after - before - F.least(F.lit(0.0), mean1 - mean0)))


def drop_parts(drop: Column, before: Column) -> tuple[Column, Column]:
    """Evidence of a drop by its size and by its share of what was there."""
    steep = 25 + 20 * F.greatest(F.lit(0.0), (0.30 - before) / 0.30)
    return logistic(drop, 0.05 + 0.10 * before, steep), logistic(drop / F.greatest(before, F.lit(0.05)), 0.30, 8)


def loss_evidence(before: Column, after: Column, mean0: Column, mean1: Column, std: Column) -> tuple[Column, Column]:
    """Evidence of tree loss before clouds, 0 to 1, and the z-score of what is left."""
    drop = seasonal_drop(before, after, mean0, mean1)
    absolute, relative = drop_parts(drop, before)
    z = (after - F.greatest(before, mean1)) / F.greatest(std, F.lit(0.05))
    raw = 0.7 * absolute + 0.3 * relative
    return F.least(raw * (1 + F.greatest(F.lit(0.0), -z) / 4 * logistic(drop, 0.08, 40)), F.lit(1.0)), z


def cloud_clarity(cloud: Column) -> Column:
    return 1 - logistic(cloud, 0.60, 15)


def seasonal_score(before: Column, after: Column, mean0: Column, mean1: Column, std: Column, cloud: Column) -> Column:
    return F.round(loss_evidence(before, after, mean0, mean1, std)[0] * cloud_clarity(cloud), 3)


def threat_scores(
    before: dict[str, Column], after: dict[str, Column], mean0: Column, mean1: Column, std: Column, cloud: Column, cusum: Column
) -> dict[str, Column]:
    """Sub-scores of three threats, the strongest with its name, and the label of the cloud-weighted score."""
    evidence, _ = loss_evidence(before["trees"], after["trees"], mean0, mean1, std)
    z = (after["trees"] - mean1) / F.greatest(std, F.lit(0.05))
    lift = F.when(z < -1.96, 0.30 * logistic(-z, 1.96, 5)).otherwise(0.0) + F.when(cusum > 0, 0.20 * logistic(cusum, 0.22, 25)).otherwise(0.0)
    tree = F.least(F.round(evidence, 3) + F.least(lift, F.lit(0.35)), F.lit(1.0))
    gain = lambda k: F.greatest(F.lit(0.0), after[k] - before[k])
    crop = logistic(gain("crops"), 0.08 + 0.10 * before["crops"], 25) * (1 - logistic(before["crops"], 0.30, 20)) * logistic(after["crops"], 0.35, 20)
    built = logistic(gain("built"), 0.06 + 0.10 * before["built"], 30) * (1 - logistic(before["built"], 0.20, 20)) * logistic(after["built"], 0.30, 25)
    best = F.greatest(tree, crop, built)
    score = best * F.pow(cloud_clarity(cloud), 1 - best)
    threat = F.when(tree == best, THREATS[0]).when(crop == best, THREATS[1]).otherwise(THREATS[2])
    return {"tree": tree, "crop": crop, "built": built, "threat": threat, "score": score, "label": score_label(score)}


def baseline(doy: Column, means: list[float]) -> Column:
    return doy_value(doy, means)
