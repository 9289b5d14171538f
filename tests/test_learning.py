"""Ensembles, several classes, windows over time, thresholds and as-of dates on planted rules and against loops."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import learning, reports
from emberline.operators.temporal import latest_before


def test_the_stack_beats_each_member(spark):
    """A sum that trees find hard and a band that a regression can't see."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    b, c = rng.random((2, 3000))
    logit = 1.6 * x.sum(axis=1) + np.where(abs(b - 0.5) < 0.25, 4.0, -4.0)
    y = (rng.random(3000) < 1 / (1 + np.exp(-logit))).astype(float)
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, r), float(p), float(q), float(t)) for i, (r, p, q, t) in enumerate(zip(x, b, c, y))], f"k long, {', '.join(f'{n} double' for n in names)}, b double, c double, y double")
    out = learning.stacked_ensemble(df, "k", [*names, "b", "c"], "y").toPandas()
    assert len(out) == 3000 and out["k"].is_unique
    loss = {m: -np.mean(np.log(np.clip(np.where(out["y"] == 1, out[m], 1 - out[m]), 1e-6, 1))) for m in ("logistic", "forest", "boosted", "weighted", "stacked")}
    assert loss["stacked"] < min(loss[m] for m in ("logistic", "forest", "boosted")) - 0.01, loss
    assert set(np.round(out["votes"] * 3)) <= {0, 1, 2, 3}
    scores = [max(((out.loc[out["y"] == 1, m] > 0.5).mean() + (out.loc[out["y"] == 0, m] <= 0.5).mean()) / 2, 0.1) for m in ("logistic", "forest", "boosted")]
    want = sum(s / sum(scores) * out[m] for s, m in zip(scores, ("logistic", "forest", "boosted")))
    assert np.allclose(out["weighted"], want)


def test_no_row_is_scored_by_a_model_that_saw_it(spark):
    """Labels without a rule: a model that had seen a row could remember it, one that had not can't do better than chance."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(v), float(y)) for i, (v, y) in enumerate(zip(rng.random(1500), rng.integers(0, 2, 1500)))], "k long, v double, y double")
    out = learning.stacked_ensemble(df, "k", ["v"], "y").toPandas()
    for m in ("forest", "boosted", "stacked"):
        assert abs(((out[m] > 0.5) == (out["y"] == 1)).mean() - 0.5) < 0.06
    assert out.groupby("fold").size().min() > 400


def test_boosting_over_three_classes(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((2, 3000)) * 100
    y = np.where(a > 60, 2.0, np.where(b > 50, 1.0, 0.0))
    df = spark.createDataFrame([(i, float(p), float(q), float(t)) for i, (p, q, t) in enumerate(zip(a, b, y))], "k long, a double, b double, y double")
    out = learning.boosted_classes(df, "k", ["a", "b"], "y").toPandas()
    p = np.array(out["probabilities"].tolist())
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == out["predicted"]).all()
    test = out[out["split"] == "test"]
    assert (test["predicted"] == test["y"]).mean() > 0.97 and len(test) > 400 and set(out["predicted"]) == {0.0, 1.0, 2.0}


def test_windows_are_scored_and_stacked(spark):
    rng = np.random.default_rng(4)
    v = rng.random(2000) * 100
    df = spark.createDataFrame([(i, i % 40, float(x), float(x > 70)) for i, x in enumerate(v)], "k long, pixel long, v double, y double")
    scored = learning.boosted_filter(df, "k", ["v"], "y").toPandas().set_index("k")["probability"]
    got = {r["pixel"]: r for r in learning.stacked_windows(df, "k", "pixel", ["v"], "y").collect()}
    assert len(got) == 40
    for pixel, r in got.items():
        p = [scored[k] for k in range(pixel, 2000, 40) if scored[k] >= 0.5]
        mean = np.mean(p) if p else 0.0
        consistency = 1 - min(1.0, np.std(p) / mean) if mean > 0.01 else 1.0
        assert r["n_fires"] == len(p) and r["stacked_score"] == pytest.approx(sum(p) * math.sqrt(consistency) if len(p) > 1 else 0.0, abs=1e-5)


def test_thresholds_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 700)
    s = np.round(rng.random(700) * 0.6 + 0.4 * y, 2)
    got = reports.thresholds(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int"), "s", "y").first()
    at = lambda t: (int(((s >= t) & (y == 1)).sum()), int((s >= t).sum()))
    f1 = {t: 2 * at(t)[0] / (at(t)[1] + y.sum()) for t in set(s.tolist())}
    best = max(f1, key=lambda t: (f1[t], t))
    tp, k = at(best)
    assert (got["threshold"], got["tp"], got["fp"], got["fn"], got["tn"]) == (best, tp, k - tp, y.sum() - tp, 700 - y.sum() - k + tp) and got["f1"] == pytest.approx(f1[best])
    safe = min(t for t in f1 if at(t)[0] / at(t)[1] >= 0.8)
    assert got["safe_threshold"] == safe and got["safe_recall"] == pytest.approx(at(safe)[0] / y.sum())
    assert reports.thresholds(spark.createDataFrame([(0.5, 0), (0.7, 0)], "s double, y int"), "s", "y").first()["safe_threshold"] is None


def test_the_latest_event_before_a_date_across_years(spark):
    rng = np.random.default_rng(6)
    day = lambda: dt.date(2015, 1, 1) + dt.timedelta(int(rng.integers(0, 1500)))
    rows = [(i, int(rng.integers(0, 9)), day()) for i in range(400)] + [(400, None, day()), (401, 3, None)]
    events = [(int(rng.integers(0, 8)), day(), 1) for _ in range(40)] + [(1, rows[0][2], 1)] * 3
    out = latest_before(spark.createDataFrame(rows, "id int, k int, at date"), spark.createDataFrame(events, "k int, seen date, id int"), "k", "at", "seen", "last").collect()
    assert len(out) == len(rows)
    for r in out:
        before = [e for k, e, _ in events if k == r["k"] and r["at"] and e < r["at"]]
        assert r["last"] == (max(before) if before else None)


def test_importances_name_the_planted_features(spark):
    rng = np.random.default_rng(11)
    v = rng.random((1500, 4))
    rows = [(i, *map(float, r), None if i % 50 == 0 else float(r[1] > 0.5 and r[3] < 0.6)) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, y double")
    df = df.withColumn("c", F.when(F.col("k") % 9 != 0, F.col("c")))
    got = learning.importances(df, "k", ["a", "b", "c", "d"], "y", iterations=4).collect()
    assert {r["feature"] for r in got[:2]} == {"b", "d"} and len(got) == 4 and sum(r["importance"] for r in got) == pytest.approx(1)
    assert got[1]["importance"] > 3 * got[2]["importance"] and [r["place"] for r in got] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        learning.importances(df.withColumn("y", F.lit(0.0)), "k", ["a"], "y")
