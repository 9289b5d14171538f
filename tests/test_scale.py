"""Ties, whole jobs and steps that must not grow faster than their input."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from emberline.operators import grid as G
from emberline.operators import spatial
from emberline.plans import catalog
from emberline.plans.rasters import c5_link_overlaps
from emberline.plans.series import e18_largest_drop


def test_of_equal_drops_the_first_day_counts(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, day, 12)
    rows = [(i, at(d), p, "view", v, "") for i, (p, d, v) in enumerate((p, d, v) for p in range(40) for d, v in enumerate((9.0, 5.0, 9.0, 5.0, 9.0, 5.0), 1))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {(r.day, r.fall) for r in e18_largest_drop(spark, str(tmp_path)).collect()} == {(dt.date(2024, 1, 2), 4.0)}


def test_oldest_overlaps_against_all_pairs(spark):
    r = random.Random(5)
    sets = {k: {(r.randrange(5), r.randrange(5 + k % 3 * 6)) for _ in range(r.randrange(1, 14))} for k in r.sample(range(900), 60)}
    rows = [(k, *at) for k, cells in sets.items() for at in cells]
    got = spatial.oldest_overlaps(spark.createDataFrame(rows, "k long, row int, col int"), "k", 0.3, "newer % 2 <> older % 2", block=2)
    want = {}
    for new in sets:
        older = [o for o in sets if o < new and o % 2 != new % 2 and len(sets[o] & sets[new]) / min(len(sets[o]), len(sets[new])) >= 0.3]
        if older:
            want[new] = min(older)
    assert {r.newer: r.older for r in got.collect()} == want
    assert not spatial.oldest_overlaps(spark.createDataFrame([], "k long, row int, col int"), "k", 0.3).count()


def test_c5_meets_patches_on_one_raster(spark, data):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{data}/lineitem.parquet'")
    sql = catalog.ORACLE_SQL["c5_link_overlaps"]
    n = c.execute("SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_quantity < 12").fetchone()[0]
    got = {tuple(r) for r in c5_link_overlaps(spark, data).select("newer", "older").collect()}
    assert got == set(c.execute(sql).fetchall()) and len(got) == n - 1


def _plans(monkeypatch) -> list[str]:
    """Plans of the tables that operators of ``grid`` write from here on."""
    plans, write = [], G.persist_table
    monkeypatch.setattr(G, "persist_table", lambda df, name: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), write(df, name))[1])
    return plans


def test_component_rounds_broadcast_nothing(spark, monkeypatch):
    cells = spark.range(400).selectExpr("cast(id div 20 as int) as row", "cast(id % 20 as int) as col", "cast(id * 7 % 13 as double) as v")
    plans = _plans(monkeypatch)
    labels = G.components(cells.filter("v < 8"), 8)
    assert len(plans) > 3 and not any("Broadcast" in p for p in [*plans, labels._jdf.queryExecution().sparkPlan().toString()])


def test_spectral_windows_move_raw_counts_once(spark):
    from emberline.operators.patches import OPTICAL, spectral_windows

    seen = spark.range(200).selectExpr("id % 3 as place", "date_add(date'2024-01-01', cast(id as int)) as day", *(f"id + {i} as {b}" for i, b in enumerate(OPTICAL)))
    weather = seen.selectExpr("place", "day", "1.0D as temp_c", "2.0D as precip_mm")
    x = spectral_windows(seen, weather, spark.createDataFrame([(1, 100.0, 3.0)], "place long, elevation_m double, slope_deg double"), "place", "day")
    assert "Generate" not in x._jdf.queryExecution().sparkPlan().toString()  # no row a step back, no channels in a join
    assert x.count() == 200 and x.filter("mask[1][2] = 0 and x[1][2] <> 0").count() > 150


def test_a_clipped_ring_is_made_once(spark):
    from pyspark.sql import functions as F

    from emberline.functions import scalars as S

    ring = F.array(*(F.struct((F.col("id") + i).cast("double").alias("x"), F.lit(float(j)).alias("y")) for i, j in ((0, 0), (4, 0), (4, 4), (0, 4))))
    area = S.ring_area(S.clipped(ring, F.lit(2.0), F.lit(1.0), F.lit(9.0), F.lit(9.0)))
    x = spark.range(12).select("id", area.alias("a"))
    assert x._jdf.queryExecution().analyzed().toString().count("zip_with") == 5  # four sides and the area
    assert [r.a for r in x.orderBy("id").collect()] == [3.0 * max(0, min(i + 4, 9) - max(i, 2)) for i in range(12)]


def test_scenes_meet_two_fires_of_a_day(spark, monkeypatch, tmp_path):
    from emberline.plans.fires import k15_f6_h22_h23_fire_links

    spark.range(500).selectExpr("id as o_orderkey", "(id % 2) * 1000 + 7 as o_custkey", "timestamp'2024-01-05 00:00:00' as o_orderdate", "id * 10.0D as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3).selectExpr("7L as l_suppkey", "date_add(date'2024-01-05', cast(id * 20 as int)) as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    met, meet = [], spatial.range_hits
    monkeypatch.setattr(spatial, "range_hits", lambda a, b, *more: (met.append(b.count()), meet(a, b, *more))[1])
    got = k15_f6_h22_h23_fire_links(spark, str(tmp_path)).collect()
    assert met == [2] and {(r.days_gap, r.fire_id, r.spatial_hit) for r in got} == {(0, 149, True), (20, 149, True), (40, 149, True)}


def test_equal_rows_are_fitted_once_and_tasks_stay_small(spark):
    from pyspark.sql import functions as F

    from emberline.operators import learning as L

    x = spark.range(3000).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("y"), F.lit(0.5).alias("weight"))
    assert {tuple(r) for r in L.weighted_rows(x, ["a", "y"]).collect()} == {(float(a), float(y), 250.0) for a in range(3) for y in range(2)}
    sizes = L.spread(spark.range(3000).coalesce(1), ["id"], 3000, 50).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 100


def test_wide_rows_do_not_pass_the_tiles(spark):
    from emberline.operators.features import window_features
    from emberline.plans.stacks import stack

    plan = window_features(stack(spark, "/root/testdata/sf0.001"), "w", "date_before", "enriched", date_after="date_after")._jdf.queryExecution().sparkPlan().toString()
    tiles = [line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line]
    assert tiles and not any("ndvi_before" in line for line in tiles)


def test_only_paths_across_tiles_take_rounds(spark, monkeypatch):
    r = random.Random(3)
    cells = spark.createDataFrame([(i, j) for i in range(-9, 14) for j in range(-5, 17) if r.random() < 0.6], "row int, col int")
    rounds, write = [], G.persist_table

    def counted(df, name):
        out = write(df, name)
        rounds.extend([out.count()] * (name == "rings"))
        return out

    monkeypatch.setattr(G, "persist_table", counted)
    inside = G.polygons(cells.withColumn("row", F.col("row") + 9).withColumn("col", F.col("col") + 5))
    assert rounds and not any(rounds) and inside.count() > 9
    for connectivity in (4, 8):
        whole, cut = (sorted(G.rings(cells, connectivity, tile=n).collect()) for n in (128, 4))
        assert whole == cut and sum(x["area"] for x in cut) == cells.count()


def test_patch_cells_meet_their_sources_in_bounded_tasks(spark, data):
    from emberline.operators.patches import assemble_patches
    from emberline.plans.assembly import l18_patch_cells

    plan = l18_patch_cells(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan  # cells are not sorted to be summed
    patches = spark.createDataFrame([("a", 0, 0, True)], "s string, patch_row long, patch_col long, is_fire boolean")
    cells = spark.createDataFrame([("a", 0, 0, 1.0)], "s string, row int, col int, v double")
    scenes = spark.createDataFrame([("a", "a")], "s string, now string")
    out = assemble_patches(patches, scenes, cells, cells.select("row", "col"), cells, "s", ["now"], ["v"], 4, 2, rows=50_000_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    for keys in ("s#[0-9]+, row#[0-9]+, col#[0-9]+", "row#[0-9]+, col#[0-9]+", "s#[0-9]+, block_row#[0-9]+L, block_col#[0-9]+L"):
        assert re.search(rf"hashpartitioning\({keys}, 100\), REPARTITION_BY_NUM", plan)


def test_a_mean_that_is_the_threshold_is_detected(spark, monkeypatch):
    from fractions import Fraction

    from emberline.plans import rasters

    r, rows, blocks = random.Random(2), [], 60
    while len(rows) < blocks * 25:
        cells = {(i, j): (r.randrange(3, 6) if (i, j) == (0, 0) else r.randrange(5, 8) if max(abs(i), abs(j)) == 1 else r.randrange(0, 9), 1 if (i, j) == (0, 0) else r.choice((1, 1, 3, 7))) for i in range(-2, 3) for j in range(-2, 3)}
        cells = {at: (d if n == 1 else d * n + r.randrange(n), n) for at, (d, n) in cells.items()}
        rest = 125 - sum(Fraction(*x) for at, x in cells.items() if at != (2, 2))
        if 0 <= rest <= 10 and sum(Fraction(*cells[i, j]) for i in (-1, 0, 1) for j in (-1, 0, 1)) >= Fraction(468, 10):
            cells[2, 2] = (rest.numerator, rest.denominator)  # now the mean of the square is 5 hundredths
            rows += [(i + 2, j + 2 + 10 * (len(rows) // 25), d / n / 100) for (i, j), (d, n) in sorted(cells.items())]
    monkeypatch.setattr(rasters, "raster", lambda *_: spark.createDataFrame(rows, "row int, col int, v double"))
    got = {x.col: x.detected for x in rasters.i1_i2_focal(spark, "").filter("row = 2 and col % 10 = 2").collect()}
    assert got == {2 + 10 * i: True for i in range(blocks)}


def test_importances_are_fitted_on_scanned_rows_in_small_tasks(spark, monkeypatch):
    from emberline.operators import learning as L

    before, plans = {k: spark.conf.get(k, None) for k in (L.CLEANUP, L.SPLIT)}, []

    class Fit(L.GBTClassifier):
        def fit(self, x):
            plans.append(x._jdf.queryExecution().sparkPlan().toString())
            return super().fit(x)

    monkeypatch.setattr(L, "GBTClassifier", Fit)
    df = spark.range(2000).selectExpr("cast(id as string) as k", "id % 10 / 10 as a", "cast(id % 10 >= 5 as double) as y")
    assert [r.importance for r in L.importances(df, "k", ["a"], "y", iterations=2).collect()] == [1.0]
    assert len(plans) == 1 and not any(x in plans[0] for x in ("Repartition", "Exchange"))  # else its rows lie on disk twice, as Spark ML makes them once more
    with L.training_table(spark.range(3000).coalesce(1), "train", most=200) as rows:
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and max(sizes) <= 400
        files = rows.inputFiles()
    assert before == {k: spark.conf.get(k, None) for k in before} and files


def test_wide_rows_are_shuffled_once(spark):
    from emberline.operators.features import window_features
    from emberline.plans.stacks import stack

    plan = window_features(stack(spark, "/root/testdata/sf0.001"), "w", "date_before", "enriched", date_after="date_after")._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange" in line]
    assert "Join" not in plan and "hashpartitioning(row" in moves[0] and "REPARTITION_BY_COL" in moves[0]  # by pixel: what lies above needs no other
