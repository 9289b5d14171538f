"""The daily refresh: late days, repeated batches, runs that die between write and switch, and what a batch touches."""

import pytest
from pyspark.sql import functions as F

from emberline.streaming.refresh import DailyRefresh, Dependent, VersionedTable, drain

ROWS = "id long, day string, v long, seen int"


class Died(Exception):
    pass


@pytest.fixture
def made(spark, tmp_path):
    base = VersionedTable(spark, f"file://{tmp_path}/base", ROWS, "day")
    months = VersionedTable(spark, f"file://{tmp_path}/months", "month string, n long, v long", "month")
    build = lambda rows: rows.groupBy(F.substring("day", 1, 7).alias("month")).agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    return base, months, DailyRefresh(base, ["id"], "seen", [Dependent(months, lambda d: d[:7], build)])


def rows_of(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_batches_merge_late_days_and_newer_rows(spark, made):
    base, months, refresh = made
    assert rows_of(base) == [] and base.state() == (-1, {})
    first = spark.createDataFrame([(1, "2024-01-01", 5, 1), (2, "2024-01-02", 6, 1), (3, "2024-02-01", 7, 1), (1, "2024-01-01", 4, 0), (9, None, 1, 1)], ROWS)
    refresh(first, 0)
    assert rows_of(months) == [("2024-01", 2, 11), ("2024-02", 1, 7), (None, 1, 1)]
    late = spark.createDataFrame([(4, "2023-12-31", 1, 1), (2, "2024-01-02", 60, 2), (5, "2024-01-02", 2, 1)], ROWS)
    refresh(late, 1)
    assert rows_of(months) == [("2023-12", 1, 1), ("2024-01", 3, 67), ("2024-02", 1, 7), (None, 1, 1)]
    # only the days that arrived were written again
    assert base.state() == (1, {"2023-12-31": 1, "2024-01-01": 0, "2024-01-02": 1, "2024-02-01": 0, "none": 0})
    assert months.state()[1] == {"2023-12": 1, "2024-01": 1, "2024-02": 0, "none": 0}
    before = rows_of(base), rows_of(months)
    refresh(late, 1)
    refresh(first, 0)
    assert (rows_of(base), rows_of(months)) == before
    refresh(spark.createDataFrame([], ROWS), 2)
    assert (rows_of(base), rows_of(months)) == before


@pytest.mark.parametrize("table, step", [("base", "write_version"), ("base", "switch"), ("months", "write_version"), ("months", "switch")])
def test_a_run_that_dies_changes_nothing_and_can_come_again(spark, made, monkeypatch, table, step):
    base, months, refresh = made
    refresh(spark.createDataFrame([(1, "2024-01-01", 5, 1), (2, "2024-02-01", 6, 1)], ROWS), 0)
    before = {"base": rows_of(base), "months": rows_of(months)}
    batch = spark.createDataFrame([(1, "2024-01-01", 50, 2), (3, "2024-01-05", 7, 1)], ROWS)
    target = {"base": base, "months": months}[table]

    def dies(number, *rest):
        if step == "write_version":  # the files are there, the manifest is not
            target.spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(f"{target.path}/data/{number}")
        raise Died

    with monkeypatch.context() as m:
        m.setattr(target, step, dies)
        with pytest.raises(Died):
            refresh(batch, 1)
    assert rows_of(target) == before[table]
    refresh(batch, 1)
    assert rows_of(base) == [(1, "2024-01-01", 50, 2), (2, "2024-02-01", 6, 1), (3, "2024-01-05", 7, 1)]
    assert rows_of(months) == [("2024-01", 2, 57), ("2024-02", 1, 6)]


def test_old_versions_go_once_nobody_reads_them(spark, made):
    base, _, refresh = made
    for n in range(3):
        refresh(spark.createDataFrame([(1, "2024-01-01", n, n)] + [(2, "2024-03-01", 1, 1)] * (n == 0), ROWS), n)
    held = base.read(["2024-01-01"])
    assert base.vacuum() == [1] and base.vacuum() == []
    assert [r["v"] for r in held.collect()] == [2] and len(rows_of(base)) == 2


def test_a_partition_without_rows_leaves_the_table(spark, made):
    base, _, _ = made
    base.replace(0, spark.createDataFrame([(1, "a", 1, 1), (2, "b", 1, 1)], ROWS), ["a", "b"])
    base.replace(1, spark.createDataFrame([], ROWS), ["a"])
    assert base.state() == (1, {"b": 0}) and rows_of(base) == [(2, "b", 1, 1)]


def test_a_stream_is_drained_in_steps(spark, made, tmp_path):
    base, months, refresh = made
    for n in range(2):
        spark.createDataFrame([(10 * n + i, f"2024-0{n + 1}-0{i + 1}", i, 1) for i in range(3)], ROWS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        drain(spark.readStream.schema(ROWS).parquet(f"file://{tmp_path}/in"), refresh, f"file://{tmp_path}/state")
    drain(spark.readStream.schema(ROWS).parquet(f"file://{tmp_path}/in"), refresh, f"file://{tmp_path}/state")
    assert rows_of(months) == [("2024-01", 3, 3), ("2024-02", 3, 3)] and base.state()[0] == 1
