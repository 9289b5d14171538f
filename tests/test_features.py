"""Feature sets against a loop over windows and cells, on tiles smaller than the raster."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import features, grid
from emberline.operators.features import BANDS, REFLECTANCES, SIDES, SPECTRA, window_features

SIZES = {"single": 23, "history": 30, "enriched": 84}
BEGUN = [dt.date(2023, 1, 20), dt.date(2023, 6, 2), dt.date(2023, 12, 9)]


@pytest.fixture(scope="module")
def stack(spark):
    rng = np.random.default_rng(6)
    rows = []
    for w, day in enumerate(BEGUN):
        for r in range(9):
            for c in range(8):
                if rng.random() < 0.9:
                    v = {f"{b}_{s}": float(rng.random()) for b in (*BANDS, *REFLECTANCES) for s in SIDES} | {f"{b}_{s}": float(rng.random() * 2 - 1) for b in SPECTRA for s in SIDES}
                    v |= {f"delta_{b}": float(round(rng.random() - 0.5, 2)) for b in BANDS} | {"cloud_before": float(rng.random()), "cloud_after": float(rng.random())}
                    rows.append({"w": w, "row": r, "col": c, "from": day, "to": day + dt.timedelta(days=25 + w), **v})
    return rows


def expected(rows, kind):
    at = {(x["w"], x["row"], x["col"]): x for x in rows}
    alert = lambda x: (abs(x["delta_trees"]) if kind == "single" else -x["delta_trees"]) >= 0.1
    gain_class = {0: 6, 2: 3, 3: 6, 4: 1, 5: 4, 6: 2, 7: 6}
    for (w, r, c), x in at.items():
        d = [x[f"delta_{b}"] for b in BANDS]
        around = lambda k: [at[w, i, j] for i in range(r - k, r + k + 1) for j in range(c - k, c + k + 1) if (w, i, j) in at]
        mean = lambda k: sum(y["delta_trees"] for y in around(k)) / (2 * k + 1) ** 2
        gains = [-999 if i == 1 else v for i, v in enumerate(d)]
        gain, month = int(np.argmax(gains)), x["from"].month
        f = {f"delta_{b}": v for b, v in zip(BANDS, d)} | {"cloud_before": x["cloud_before"], "cloud_after": x["cloud_after"], "cloud_worst": max(x["cloud_before"], x["cloud_after"])}
        f |= {"n_neighbors_alert": sum(map(alert, around(1))) - alert(x), "mean_neighbor_trees": mean(1), "std_neighbor_trees": np.sqrt(max(0, sum(y["delta_trees"] ** 2 for y in around(1)) / 9 - mean(1) ** 2))}
        f |= {"trees_crops_anti": d[1] < 0 < d[4], "trees_bare_anti": d[1] < 0 < d[7], "dominant_gain_band": gain, "band_diversity": sum(abs(v) > 0.1 for v in d), "abs_delta_trees": abs(d[1]), "abs_max_band": max(map(abs, d))}
        f |= {"month": month, "is_monsoon": month in (6, 7, 8, 9), "is_winter": month in (12, 1, 2)}
        if kind != "single":
            past = [at[v, r, c] for v in range(w) if (v, r, c) in at]
            fired = [i for i, y in enumerate(past) if alert(y)]
            f |= {"delta_trees_5x5_mean": mean(2), "delta_trees_7x7_mean": mean(3), "tree_loss_ratio": abs(d[1]) / (abs(d[1]) + abs(d[4]) + abs(d[7]) + 1e-6)}
            f |= {"cum_alert_count": len(fired), "cum_delta_trees": sum(y["delta_trees"] for y in past), "max_loss_so_far": min([0, *(y["delta_trees"] for y in past)]), "windows_since_first_alert": len(past) - fired[0] if fired else -1}
        if kind == "enriched":
            steps = np.cumsum([0, *(y["ndvi_after"] - y["ndvi_before"] for y in past)])
            kind_of_gain = 5 if d[1] <= -0.3 and gains[gain] < 0.05 else gain_class[gain]
            before, after = ([x[f"{b}_{s}"] for b in BANDS] for s in SIDES)
            ndbi = [(x[f"swir1_{s}"] - x[f"nir_{s}"]) / (x[f"swir1_{s}"] + x[f"nir_{s}"] + 2e-6) for s in SIDES]
            cover = int(np.argmax(before))
            f |= {f"{c}_{s}": x[f"{c}_{s}"] for c in (*BANDS, *SPECTRA, *REFLECTANCES) for s in SIDES} | {f"delta_{c}": x[f"{c}_after"] - x[f"{c}_before"] for c in SPECTRA}
            f |= {"dominant_gain_class": kind_of_gain, "relative_tree_loss": d[1] / (before[1] + 1e-6), "dw_before_class": cover, "dominant_gain_value": gains[gain], "gain_gap": sorted(gains)[-1] - sorted(gains)[-2], "transition_type": 10 * cover + kind_of_gain}
            f |= {f"dw_entropy_{s}": -sum((p + 1e-8) * np.log(p + 1e-8) for p in ps) for s, ps in zip(SIDES, (before, after))}
            f |= {"monsoon_x_grass": f["is_monsoon"] and kind_of_gain == 3, "monsoon_x_shrub": f["is_monsoon"] and kind_of_gain == 4, "winter_x_crops": f["is_winter"] and kind_of_gain == 1}
            f |= {"ndbi_before": ndbi[0], "ndbi_after": ndbi[1], "delta_ndbi": ndbi[1] - ndbi[0], "window_duration_days": 25 + w, "alert_rate": bool(fired)}
            f |= {"cum_delta_ndvi": steps[-1], "max_ndvi_loss_so_far": steps.min(), "cum_delta_nbr": sum(y["nbr_after"] - y["nbr_before"] for y in past), "ndvi_at_first_alert": past[fired[0]]["ndvi_before"] if fired else 0, "ndvi_recovery_flag": steps[-1] - steps.min() > 0.05}
        yield (w, r, c), f


@pytest.mark.parametrize("kind", SIZES)
def test_features_equal_the_loop(spark, stack, kind, monkeypatch):
    monkeypatch.setattr(grid, "TILE", 5)
    out = window_features(spark.createDataFrame(stack), "w", "from", kind, date_after="to")
    assert len(out.columns) == 3 + SIZES[kind] and {t for _, t in out.dtypes[3:]} == {"double"}
    got = {(x["w"], x["row"], x["col"]): x for x in out.collect()}
    want = dict(expected(stack, kind))
    assert got.keys() == want.keys()
    for at, f in want.items():
        assert set(f) == set(out.columns[3:])
        for name, v in f.items():
            assert got[at][name] == pytest.approx(float(v), abs=1e-7), (at, name)


def test_features_of_odd_rows(spark, stack):
    df = spark.createDataFrame(stack)
    assert window_features(df.limit(0), "w", "from").count() == 0
    odd = df.filter("row < 3").withColumn("neighbours", F.lit("taken")).withColumn("__nth", F.lit(1)).withColumn("mean3", F.lit(None).cast("int"))
    odd = odd.withColumn("delta_trees", F.when(F.col("col") != 2, F.col("delta_trees"))).withColumn("from", F.when(F.col("col") != 3, F.col("from")))
    twice = odd.unionByName(odd.filter("row = 1 AND col = 5"))
    got = window_features(twice, "w", "from").collect()
    assert len(got) == twice.count()
    for x in got:
        assert (x["delta_trees"] is None) == (x["col"] == 2) and x["n_neighbors_alert"] is not None and x["cum_delta_trees"] is not None and x["window_duration_days"] == 30
        assert x["col"] != 3 or (x["month"] == 1 and x["is_winter"] == 1)
    with pytest.raises(ValueError):
        window_features(df, "w", "from", "wide")


def test_fixed_classes():
    assert set(features.GAIN_CLASS) == set(BANDS) - {"trees"}
