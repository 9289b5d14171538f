"""Scorers on cases that once misled them, and the texts of alerts."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import messages as A
from emberline.functions import scalars as S
from emberline.functions import scorers as K
from emberline.plans.series import MEANS, STD

#: Tree share before and after, day, cloud share.
CASES = {
    "confirmed loss": (0.72, 0.49, "2025-02-09", 0.00), "half cloud": (0.72, 0.49, "2025-02-09", 0.50), "mostly cloud": (0.72, 0.49, "2025-02-09", 0.90),
    "small drop": (0.65, 0.58, "2025-02-15", 0.10), "seasonal dip": (0.55, 0.50, "2025-02-20", 0.05), "strong wet loss": (0.85, 0.55, "2025-09-15", 0.05),
    "moderate wet loss": (0.80, 0.68, "2025-09-15", 0.15), "regrowth": (0.60, 0.72, "2025-10-10", 0.10), "stable": (0.70, 0.70, "2025-06-01", 0.00),
    "clearing": (0.85, 0.15, "2025-08-20", 0.00), "clear-cut under cloud": (0.80, 0.20, "2025-05-10", 0.50), "sparse, bulldozed": (0.25, 0.10, "2025-04-15", 0.00),
    "pristine": (0.85, 0.55, "2025-11-01", 0.00), "flutter": (0.30, 0.28, "2025-03-01", 0.05), "last of February": (0.72, 0.49, "2025-02-28", 0.00), "first of March": (0.72, 0.49, "2025-03-01", 0.00),
}


def logistic(x, m, k):
    return 1 / (1 + math.exp(-k * (x - m)))


def mean_on(day):
    """The line between the centres of two months, December running on into January."""
    centres = [*S.MONTH_CENTRES, 380]
    means, d = [*MEANS, MEANS[0]], day.timetuple().tm_yday
    d = d + 365 if d < 15 else d
    i = max(i for i in range(12) if centres[i] <= d)
    return means[i] + (means[i + 1] - means[i]) * (d - centres[i]) / (centres[i + 1] - centres[i])


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(name, b, a, dt.date.fromisoformat(day), c) for name, (b, a, day, c) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, b double, a double, day date, cloud double")
    b, a, cloud, doy = F.col("b"), F.col("a"), F.col("cloud"), F.dayofyear("day")
    mean, before, std = K.baseline(doy, MEANS), K.baseline(F.dayofyear(F.date_sub("day", 15)), MEANS), F.lit(STD)
    none = {"trees": b, "crops": F.lit(0.05), "built": F.lit(0.03)}
    threats = K.threat_scores(none, none | {"trees": a}, before, mean, std, cloud, F.lit(0.0))
    out = df.select("name", K.plain_score(a - b, (a - mean) / STD, cloud).alias("v1"), K.seasonal_score(b, a, before, mean, std, cloud).alias("v2"), *(threats[k].alias(k) for k in ("score", "threat", "label")))
    return {r["name"]: r for r in out.collect()}


@pytest.mark.parametrize("name", CASES)
def test_scores_equal_the_formulas(scores, name):
    b, a, day, cloud = CASES[name]
    day = dt.date.fromisoformat(day)
    mu, mu0 = mean_on(day), mean_on(day - dt.timedelta(days=15))
    v1 = min(logistic(b - a, 0.12, 18) * (1 + max(0, (mu - a) / STD) / 4), 1) * (1 - cloud)
    drop = max(0, -(a - b - min(0, mu - mu0)))
    raw = 0.7 * logistic(drop, 0.05 + 0.1 * b, 25 + 20 * max(0, (0.3 - b) / 0.3)) + 0.3 * logistic(drop / max(b, 0.05), 0.3, 8)
    v2 = min(raw * (1 + max(0, (max(b, mu) - a) / STD) / 4 * logistic(drop, 0.08, 40)), 1) * (1 - logistic(cloud, 0.6, 15))
    assert scores[name]["v1"] == pytest.approx(v1, abs=1e-9) and scores[name]["v2"] == pytest.approx(v2, abs=6e-4)


def test_cases_are_told_apart(scores):
    v = {n: r["v2"] for n, r in scores.items()}
    assert min(v[n] for n in ("confirmed loss", "strong wet loss", "clearing", "clear-cut under cloud", "pristine")) >= 0.70
    assert max(v[n] for n in ("regrowth", "stable", "flutter", "mostly cloud", "seasonal dip")) < 0.25
    assert v["sparse, bulldozed"] >= 0.45 and v["clear-cut under cloud"] > scores["clear-cut under cloud"]["v1"]
    assert abs(v["last of February"] - v["first of March"]) < 0.02
    assert scores["clearing"]["threat"] == "CANOPY_LOSS" and scores["clearing"]["label"] == "HIGH" and scores["stable"]["label"] == "NO ALERT"


def test_texts_of_alerts(spark):
    rows = [("CRITICAL", "D", 60.0, 40.0, True, None, "trees"), ("CRITICAL", "N", 7.25, 40.0, False, False, "crops"), ("HIGH", "D", 25.0, 3.0, None, True, None), ("MODERATE", "N", None, None, False, False, "unknown"), (None, None, 0.04, 1.0, False, False, "water")]
    df = spark.createDataFrame(rows, "s string, dn string, frp double, fwi double, forest boolean, near boolean, cover string")
    c = F.col
    s = A.alert_severity(c("s"), c("forest"), c("near"))
    text = A.alert_message(s, S.frp_category(c("frp")), c("dn"), F.lit(24.5), F.lit(77.25), c("frp"), c("fwi"), S.fwi_class(c("fwi")), c("forest"), c("near"), F.lit(False), c("cover"))
    assert [r[0] for r in df.select(text).collect()] == [
        "CRITICAL [FOREST FIRE]: INFERNO daytime FOREST fire at 24.500N 77.250E — FRP=60.0 MW, FWI=40.0 (Extreme). Immediate ground response required.",
        "HIGH [CROPS]: nighttime fire at 24.500N 77.250E — FRP=7.3 MW, FWI=40.0 (Extreme). Non-forest — monitor for spread to nearby vegetation.",
        "HIGH [NEAR FOREST]: INTENSE daytime fire at 24.500N 77.250E — FRP=25.0 MW, FWI=3.0 (Low). Deploy rapid response team.",
        "MODERATE : nighttime fire at 24.500N 77.250E — FRP=0.0 MW (unknown). Monitor closely.",
        "LOW [WATER]: nighttime fire at 24.500N 77.250E — FRP=0.0 MW (water). Routine monitoring.",
    ]
