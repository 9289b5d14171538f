"""Registration of queries with their SQL, and the domain-shaped views over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of points over years, from ``orders``."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("point_id"), k.alias("id"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 500000).alias("trees"),
        (k * 7 % 100 / 100).alias("crops"), (k * 13 % 100 / 100).alias("built"), (k * 3 % 10 / 20).alias("cloud"), F.col("o_orderpriority").alias("beat"), F.col("o_orderstatus").alias("range_name"),
    )


HISTORY = """hist AS (SELECT o_custkey AS point_id, o_orderkey AS id, o_orderdate::DATE AS date, o_totalprice / 500000 AS trees, (o_orderkey * 7 % 100) / 100.0::DOUBLE AS crops,
 (o_orderkey * 13 % 100) / 100.0::DOUBLE AS built, (o_orderkey * 3 % 10) / 20.0::DOUBLE AS cloud, o_orderpriority AS beat, o_orderstatus AS range_name FROM orders)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel windows in time order, from ``events``: change, cloud, fired."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("pixel"), "event_id", "ts", F.to_date("ts").alias("date"), "value", "event_type", "props",
        ((F.col("value") - 50) / 100).alias("delta"), (F.col("event_id") % 10 / 10).alias("cloud"), (F.col("event_type") == "error").alias("fired"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("p"),
    )


WINDOWS = """win AS (SELECT user_id AS pixel, event_id, ts, ts::DATE AS date, value, event_type, props, (value - 50) / 100 AS delta, (event_id % 10) / 10.0::DOUBLE AS cloud,
 event_type = 'error' AS fired, least(1.0, value / 200) AS p FROM events)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows like the alerts table, from ``orders`` and ``customer``."""
    o, c, k = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("id"), F.col("o_orderpriority").alias("change_type"), F.concat(F.lit("beat_"), F.col("c_nationkey").cast("string")).alias("beat_name"), (k % 97 / 97).alias("confidence"),
        F.when(k % 5 != 0, F.col("o_totalprice") / 500000).alias("stacked_score"), (k % 50 / 10 + 0.1).alias("area_ha"), F.when(k % 7 != 0, k % 3 == 0).alias("sar_boost_applied"),
        (k % 11 / 10).alias("cusum_zone_score"), F.to_date("o_orderdate").alias("detection_date"), (F.col("o_custkey") % 360 - 180.0).alias("centroid_lon"),
        (k % 180 - 90.0).alias("centroid_lat"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("model_version"), F.col("o_orderstatus").alias("source"),
    )


ALERTS = """alerts AS (SELECT o_orderkey AS id, o_orderpriority AS change_type, 'beat_' || c_nationkey AS beat_name, (o_orderkey % 97) / 97.0::DOUBLE AS confidence,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 500000 END AS stacked_score, (o_orderkey % 50) / 10.0::DOUBLE + 0.1::DOUBLE AS area_ha,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 3 = 0 END AS sar_boost_applied, (o_orderkey % 11) / 10.0::DOUBLE AS cusum_zone_score, o_orderdate::DATE AS detection_date,
 (o_custkey % 360) - 180.0::DOUBLE AS centroid_lon, (o_orderkey % 180) - 90.0::DOUBLE AS centroid_lat, 'v' || (o_orderkey % 3) AS model_version, o_orderstatus AS source
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid from ``lineitem``, a row for 240 orders and 64 columns: v (mean discount), q (mean quantity), n; sums of whole numbers, so exact."""
    li = read(spark, sf_dir, "lineitem")
    cells = li.groupBy(F.floor(F.col("l_orderkey") / 240).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")).agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n")
    )
    return cells.select("row", "col", (F.col("d") / F.col("n") / 100).alias("v"), (F.col("q") / F.col("n")).alias("q"), "n")


GRID = """grid AS (SELECT row, col, d / n / 100 AS v, q / n AS q, n FROM (SELECT (l_orderkey // 240)::INT AS row, (l_partkey % 64)::INT AS col,
 sum(round(l_discount * 100)::BIGINT)::DOUBLE AS d, sum(l_quantity::BIGINT)::DOUBLE AS q, count(*) AS n FROM lineitem GROUP BY ALL))"""


def side(spark: SparkSession, sf_dir: str) -> int:
    """Rows and columns of ``raster``."""
    return isqrt(read(spark, sf_dir, "lineitem").count() // 4)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square raster from ``lineitem`` with a cell for about four rows, which grows in both directions; a few cells are missing."""
    n = side(spark, sf_dir)
    cells = read(spark, sf_dir, "lineitem").groupBy(((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % n).cast("int").alias("row"), ((F.col("l_partkey") * 17 + F.col("l_suppkey")) % n).cast("int").alias("col")).agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n")
    )
    return cells.select("row", "col", (F.col("d") / F.col("n") / 100).alias("v"), (F.col("q") / F.col("n")).alias("q"), "n")


RASTER = """side AS (SELECT floor(sqrt(count(*) // 4))::BIGINT AS s FROM lineitem), rast AS (SELECT row, col, d / n / 100 AS v, q / n AS q, n FROM (
 SELECT ((l_orderkey * 31 + l_linenumber) % (SELECT s FROM side))::INT AS row, ((l_partkey * 17 + l_suppkey) % (SELECT s FROM side))::INT AS col,
 sum(round(l_discount * 100)::BIGINT)::DOUBLE AS d, sum(l_quantity::BIGINT)::DOUBLE AS q, count(*) AS n FROM lineitem GROUP BY ALL))"""


def half_up(c, name: str):
    """Six decimals by whole-number rounding, which both engines do alike on equal doubles."""
    return (F.floor(c * 1e6 + 0.5) / 1e6).alias(name)


def r6(c, name: str):
    return F.round(c, 6).alias(name)
