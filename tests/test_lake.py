"""Snapshots that readers never meet half written, logs of JSON lines, sources by preference, files of large days."""

import datetime as dt
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from emberline.plans.series import harmonic_fit
from emberline.sources import lake

DAY = dt.date(2024, 1, 31)


def test_snapshots_switch_whole_and_keep_their_days(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/published"
    one, two = (spark.createDataFrame(rows, "beat string, n long") for rows in ([("a", 1), ("b", 2)], [("c", 3)]))
    values = lambda **how: sorted(map(tuple, lake.read_published(spark, root, one.schema, **how).collect()))
    assert values() == []
    lake.publish(one, root, DAY)
    reader = lake.read_published(spark, root, one.schema)
    lake.publish(two, root, DAY)  # the day again: a reader from before still reads whole files
    assert sorted(r["beat"] for r in reader.collect()) == ["a", "b"] and values() == [("c", 3)]
    lake.publish(one, root, DAY - dt.timedelta(5))  # an earlier day does not become the latest
    assert values() == [("c", 3)] and values(day=DAY - dt.timedelta(5)) == [("a", 1), ("b", 2)]

    def dies(self, batch):
        raise RuntimeError("died before the switch")

    with monkeypatch.context() as m:
        m.setattr(lake.VersionedTable, "switch", dies)
        try:
            lake.publish(one, root, DAY)
        except RuntimeError:
            pass
    assert values() == [("c", 3)]
    lake.publish(one, root, DAY)
    assert values() == [("a", 1), ("b", 2)]


def test_logs_append_and_pass_over_torn_lines(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = [("HIGH", 1, 0.5), ("LOW", None, None), (None, 3, 1.5), ("a \"quoted\"\nline", 4, 2.0)]
    for _ in range(2):  # repeated entries stay
        lake.append_log(spark.createDataFrame(rows, "level string, code long, score double"), path)
    spark.createDataFrame([('{"level": "HIGH", "co',), ("plain text",), ("",)], "value string").coalesce(1).write.mode("append").text(path)
    log = lake.read_log(spark, path, "level string, code long, score double")
    assert log.count() == 8 and Counter(map(tuple, log.collect())) == Counter(rows * 2)
    assert lake.read_log(spark, path, "code long, missing string").filter("missing is null").count() == 8


def test_first_frame_that_has_a_day_wins(spark):
    a = spark.createDataFrame([("d1", 1), ("d1", 1), (None, 2)], "day string, v long")
    b = spark.createDataFrame([("d1", 3, "x"), ("d2", 4, "x"), ("d2", 4, "x"), (None, 5, "x")], "day string, v long, more string")
    c = spark.createDataFrame([("d2", 6), ("d3", 7)], "day string, v long")
    out = lake.prefer_first(a, b, c, by="day")
    assert Counter(map(tuple, out.collect())) == Counter([("d1", 1, None)] * 2 + [(None, 2, None)] + [("d2", 4, "x")] * 2 + [("d3", 7, None)])
    assert lake.prefer_first(a.limit(0), b.limit(0), by="day").count() == 0


def test_a_large_day_is_written_by_several_tasks(spark, tmp_path):
    n = 60_000
    days = spark.range(n).select((F.rand(3) * 90).alias("latitude"), F.rand(4).alias("longitude"), F.when(F.col("id") < n - 50, F.lit(DAY)).otherwise(F.date_add(F.lit(DAY), 1)).alias("acq_date"))
    size, before = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set(size, "200k")
    try:
        lake.write_detections(days.repartition(6), f"{tmp_path}/lake")
        lake.compact_years(spark, f"{tmp_path}/lake", f"{tmp_path}/years")
    finally:
        spark.conf.set(size, before) if before else spark.conf.unset(size)
    files = lambda p: len({r[0] for r in spark.read.parquet(f"{tmp_path}/{p}").select("_metadata.file_path").distinct().collect()})
    assert files("lake/year=2024/month=1/day=31") > 1 and files("lake/year=2024/month=2/day=1") == 1 and files("years/year=2024") >= 1
    assert lake.read_range(spark, f"{tmp_path}/lake", DAY, DAY).count() == n - 50 and spark.read.parquet(f"{tmp_path}/years").count() == n


def test_harmonic_systems_of_a_batch_match_single_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(d), float(v)) for g in range(40) for d, v in zip(rng.integers(1, 366, 30), rng.normal(size=30))]
    rows += [(40, 100, float(v)) for v in rng.normal(size=15)] + [(41, 10 + 180 * (i % 2), 1.0) for i in range(14)]  # too few different days
    got = {r["g"]: r["coeffs"] for r in harmonic_fit(spark.createDataFrame(rows, "g int, doy int, y double"), "g", "doy", "y").collect()}
    assert sorted(got) == list(range(42))
    for g in got:
        w, y = np.array([d for k, d, _ in rows if k == g]) * (2 * np.pi / 365.25), np.array([v for k, _, v in rows if k == g])
        x = np.stack([np.ones_like(w), np.cos(w), np.sin(w), np.cos(2 * w), np.sin(2 * w)], 1)
        fit = x @ np.array(got[g])
        assert np.allclose(fit, x @ np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)
