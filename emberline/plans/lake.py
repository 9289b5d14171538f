"""Queries over the lake: tables are written in the formats of the sources, read back, and compared with the tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators.grid import shared_folder
from ..sources import lake
from .registry import query, r6, read


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/emberline/lake-{uuid.uuid4().hex}"


def detections(spark, d):
    e = read(spark, d, "events")
    level = F.when(F.col("event_type") == "click", " H ").when(F.col("event_type") == "error", "n").when(F.col("event_type") == "signup", "low").otherwise("high")
    return e.select((F.col("event_id") % 90 / 2).alias("latitude"), (F.col("user_id") % 180).cast("double").alias("longitude"), F.to_date("ts").alias("acq_date"), (F.hour("ts") * 100 + F.minute("ts")).alias("acq_time"), level.alias("confidence"), F.col("value").alias("frp"))


_DET = "det AS (SELECT ts::DATE AS acq_date, ts, CASE event_type WHEN 'click' THEN 'high' WHEN 'error' THEN 'nominal' WHEN 'signup' THEN 'low' ELSE 'high' END AS confidence, value AS frp FROM events)"


@query(f"WITH {_DET} SELECT acq_date, confidence, count(*) AS n, round(sum(frp), 2) AS frp, max(hour(ts) * 60 + minute(ts)) AS last_minute, count(*) FILTER (frp <= 10 AND frp > 0) AS low FROM det WHERE confidence <> 'low' GROUP BY ALL")
def a1_detections_csv(spark, d):
    """CSV with headers in other cases, written and scanned; weak detections go."""
    path, x = _folder(spark), detections(spark, d)
    x.toDF(*(f" {c.upper()} " if i % 2 else c for i, c in enumerate(x.columns))).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    c = lake.read_detections_csv(spark, path)
    minute = F.hour("acq_datetime") * 60 + F.minute("acq_datetime")
    return c.groupBy("acq_date", "confidence").agg(F.count("*").alias("n"), F.round(F.sum("frp"), 2).alias("frp"), F.max(minute).cast("long").alias("last_minute"), F.count(F.when(F.col("frp_category") == "low", 1)).alias("low"))


@query(f"WITH {_DET} SELECT acq_date, count(*) AS n, round(sum(frp), 2) AS frp FROM det WHERE acq_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY acq_date")
def a2_a3_a4_day_lake(spark, d):
    """Day partitions, one of them written again, then a range scan."""
    path, x = _folder(spark), detections(spark, d)
    lake.write_detections(x, path)
    lake.write_detections(x.filter("acq_date = date'2024-01-09'"), path)
    r = lake.read_range(spark, path, dt.date(2024, 1, 5), dt.date(2024, 1, 20))
    return r.groupBy("acq_date").agg(F.count("*").alias("n"), F.round(F.sum("frp"), 2).alias("frp"))


@query(f"WITH {_DET} SELECT year(acq_date)::INT AS year, month(acq_date)::INT AS month, count(*) AS n FROM det GROUP BY ALL")
def a5_a7_yearly_files(spark, d):
    path, years = _folder(spark), _folder(spark)
    lake.write_detections(detections(spark, d), path)
    lake.compact_years(spark, path, years)
    return spark.read.parquet(years).groupBy("year", F.month("acq_date").alias("month")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT o_orderpriority AS source, greatest(min(o_orderdate)::DATE, DATE '1996-01-01') AS a FROM orders GROUP BY 1), c AS (SELECT source, unnest(generate_series(a, DATE '1996-06-30', INTERVAL 5 DAY))::DATE AS start FROM s) SELECT source, start, least(start + 4, DATE '1996-06-30') AS \"end\" FROM c")
def a6_download_chunks(spark, d):
    s = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.to_date(F.min("o_orderdate")).alias("first"))
    return lake.chunks_of(s, dt.date(1996, 1, 1), dt.date(1996, 6, 30), 5)


@query(f"WITH {_DET}, a AS (SELECT acq_date, 'fresh' AS source FROM det WHERE confidence = 'nominal'), b AS (SELECT acq_date, 'history' AS source FROM det WHERE confidence <> 'nominal') SELECT acq_date, source, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE acq_date NOT IN (SELECT acq_date FROM a)) GROUP BY ALL")
def a8_fresh_first(spark, d):
    """Days take the fresh source where it has any row, else the history."""
    x = detections(spark, d).withColumn("source", F.when(F.col("confidence") == "n", "fresh").otherwise("history")).select("acq_date", "source")
    return lake.prefer_first(x.filter("source = 'fresh'"), x.filter("source = 'history'"), by="acq_date").groupBy("acq_date", "source").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, s_suppkey % 90 AS x, 4.0::DOUBLE AS side, 'tile ' || s_suppkey AS name FROM supplier")
def a15_a18_features(spark, d):
    """Boxes written as features, gathered in a collection and scanned again."""
    path, k = _folder(spark), F.col("s_suppkey")
    p = lambda i, j: F.struct((k % 90 + i).cast("double").alias("x"), (k % 45 + j).cast("double").alias("y"))
    b = read(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("tile "), k.cast("string")).alias("name"), F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4)).alias("ring"))
    lake.write_features(b, path, "ring", ["id", "name"])
    f = lake.read_feature_lines(spark, path)
    return f.select(F.col("properties")["id"].cast("long").alias("id"), F.col("ring")[0]["x"].cast("long").alias("x"), (F.col("ring")[1]["x"] - F.col("ring")[0]["x"]).alias("side"), F.col("properties")["name"].alias("name"))


@query("SELECT 'Beat ' || (o_custkey % 50) AS beat, o_orderdate::DATE AS date, CASE o_orderkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'SKIP' ELSE 'FAIL' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 / 100 END AS cloud, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL")
def a21_a25_run_log(spark, d):
    """Run rows appended to a text log among other lines, and read back by their fields."""
    path, k = _folder(spark), F.col("o_orderkey")
    status = F.when(k % 3 == 0, "PASS").when(k % 3 == 1, "SKIP").otherwise("FAIL")
    cloud = F.when(k % 3 == 0, F.concat(F.lit(" cloud="), (k % 100 / 100).cast("string"))).otherwise("")
    line = F.concat(F.lit("[Beat "), (F.col("o_custkey") % 50).cast("string"), F.lit("] "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), status, cloud)
    read(spark, d, "orders").select(F.when(k % 7 == 0, "-- noise --").otherwise(line).alias("value")).write.mode("append").text(path)
    return lake.parse_log(spark, path).groupBy("beat", "date", "status", "cloud").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN c_custkey % 11 = 0 THEN 'none' ELSE 'range ' || (c_custkey % 11) END AS region, count(*) AS n FROM customer WHERE c_custkey % 11 BETWEEN 0 AND 8 GROUP BY 1")
def a17_a22_regions_and_snapshot(spark, d):
    """Regions filtered by name in any case, published under a date and as the latest."""
    root, k = _folder(spark), F.col("c_custkey") % 11
    r = read(spark, d, "customer").select(F.when(k == 0, "none").otherwise(F.concat(F.lit("range "), k.cast("string"))).alias("region")).groupBy("region").agg(F.count("*").alias("n"))
    lake.publish(r, root, dt.date(2024, 1, 30))
    lake.publish(lake.regions_named(r, "region", ["NONE", *(f"Range {i}" for i in range(1, 9))]), root, dt.date(2024, 1, 31))
    return lake.read_published(spark, root, r.schema)


@query("SELECT o_orderstatus AS level, o_orderpriority AS beat, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 7 END AS code, count(*) AS n, round(sum(o_totalprice), 2) AS score, max(o_orderdate)::DATE AS last FROM orders WHERE NOT (o_orderkey % 2 = 1 AND o_orderkey % 11 = 0) GROUP BY ALL")
def a21_alert_log(spark, d):
    """Two runs append their alerts to one log of JSON lines, the second with torn lines among them; read back by fields."""
    path, k = _folder(spark), F.col("o_orderkey")
    entry = read(spark, d, "orders").select(k, F.col("o_orderstatus").alias("level"), F.col("o_orderpriority").alias("beat"), F.when(k % 5 != 0, k % 7).alias("code"), F.col("o_totalprice").alias("score"), F.to_date("o_orderdate").alias("day"))
    lake.append_log(entry.filter(k % 2 == 0).drop("o_orderkey"), path)
    line = F.to_json(F.struct("level", "beat", "code", "score", "day"))
    entry.filter(k % 2 == 1).select(F.when(k % 11 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.mode("append").text(path)
    log = lake.read_log(spark, path, "level string, beat string, code bigint, score double, day date")
    return log.groupBy("level", "beat", "code").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"), F.max("day").alias("last"))


@query("SELECT CASE WHEN l_orderkey % 100 < 15 THEN 'test' WHEN l_orderkey % 100 < 30 THEN 'val' ELSE 'train' END AS split, count(DISTINCT 'chip_' || (CASE WHEN l_returnflag = 'R' THEN 'pos' ELSE 'neg' END) || '_' || l_orderkey) AS chips, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS positive FROM lineitem GROUP BY 1")
def a23_a26_manifest(spark, d):
    """A manifest in CSV, split into files by set, and what the chip names say."""
    path, k = _folder(spark), F.col("l_orderkey")
    kind = F.when(F.col("l_returnflag") == "R", "pos").otherwise("neg")
    split = F.when(k % 100 < 15, "test").when(k % 100 < 30, "val").otherwise("train")
    chips = read(spark, d, "lineitem").select(F.concat(F.lit("chip_"), kind, F.lit("_"), k.cast("string")).alias("chip"), split.alias("split")).distinct()
    lake.write_manifest(chips, path, "split")
    m = lake.read_manifest(spark, path)
    return m.groupBy("split").agg(F.count("*").alias("chips"), F.count(F.when(F.col("polarity") == "pos", 1)).alias("positive"))


_CELLS = "gr AS (SELECT p_partkey % 90 - 45 AS lat, p_partkey * 7 % 360 - 180 AS lon, p_partkey % 5 * 6 AS lead_h, 273.15::DOUBLE + p_partkey % 40 AS temp, p_partkey % 7 / 1000 AS precip FROM part)"


def weather_grid(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select((k % 90 - 45).alias("lat"), (k * 7 % 360 - 180).alias("lon"), (k % 5 * 6).alias("lead_h"), (k % 40 + 273.15).alias("temp"), (k % 7 / 1000).alias("precip"), k.alias("k"))


@query(f"WITH {_CELLS} SELECT lead_h, count(*) AS points, round(avg(temp) - 273.15, 6) AS temp_c, round(avg(precip), 9) AS precip FROM gr WHERE lon BETWEEN -90 AND 60 AND lat BETWEEN -20 AND 30 GROUP BY lead_h")
def a14_box_weather(spark, d):
    """Mean weather of the grid points in a box per lead time."""
    b = lake.bbox_mean_weather(weather_grid(spark, d), (-90, -20, 60, 30))
    return b.select("lead_h", "points", F.round("temp_c", 6).alias("temp_c"), F.round("precip", 9).alias("precip"))


@query(f"WITH {_CELLS}, st AS (SELECT s_suppkey AS station, s_suppkey % 90 - 45 AS s_lat, s_suppkey * 11 % 360 - 180 AS s_lon FROM supplier), g AS (SELECT DISTINCT lat, lon, min(temp) AS temp, min(precip) AS precip FROM gr GROUP BY ALL), j AS (SELECT station, temp, precip, (lat - s_lat) ** 2 + (lon - s_lon) ** 2 AS d, lat, lon FROM st JOIN g ON abs(lat - s_lat) <= 1 AND abs(lon - s_lon) <= 1) SELECT station, count(*) OVER (PARTITION BY station) AS candidates, d::BIGINT AS d2 FROM j QUALIFY row_number() OVER (PARTITION BY station ORDER BY d, lat, lon) = 1")
def a13_nearest_grid_point(spark, d):
    """Squared distance of the nearest grid point within a degree of each station, and how many there are."""
    k = F.col("s_suppkey")
    st = read(spark, d, "supplier").select(k.alias("station"), (k % 90 - 45).alias("s_lat"), (k * 11 % 360 - 180).alias("s_lon"))
    g = weather_grid(spark, d).groupBy("lat", "lon").agg(F.min("temp").alias("temp"), F.min("precip").alias("precip"))
    near = lake.grid_candidates(g, st)
    return near.groupBy("station").agg(F.count("*").alias("candidates"), F.min("d2").cast("long").alias("d2"))


@query("SELECT n_name AS region, [n_nationkey / 10, n_nationkey % 7 / 10] AS coeffs, n_nationkey * 3 AS n FROM nation")
def a24_saved_models(spark, d):
    """Models written as JSON and loaded again."""
    path, k = _folder(spark), F.col("n_nationkey")
    lake.save_models(read(spark, d, "nation").select(F.col("n_name").alias("region"), F.array(k / 10, k % 7 / 10).alias("coeffs"), (k * 3).cast("long").alias("n")), path)
    return lake.load_models(spark, path, "region string, coeffs array<double>, n bigint")


@query("SELECT 'hill' AS region, DATE '2024-01-05' AS date_before, DATE '2024-01-20' AS date_after, event_id, value AS trees, value / 2 AS crops FROM events")
def a9_a10_window_files(spark, d):
    """A window's pixels with their bands in order, written under a name with region and dates, and scanned with named bands."""
    path, v = _folder(spark), F.col("value")
    read(spark, d, "events").select("event_id", F.array(v, v / 2).alias("bands")).write.parquet(f"{path}/hill_20240105_20240120.parquet")
    return lake.named_bands(lake.window_tables(spark, f"{path}/hill_20240105_20240120.parquet"), "bands", ["trees", "crops"])


_DAYS = "w AS (SELECT o_orderdate::DATE AS date, min(o_orderkey) AS k FROM orders GROUP BY 1)"


@query(f"WITH {_DAYS} SELECT date, round(k % 350 / 10 - 2, 6) AS temp_c, least(100, k % 107)::DOUBLE AS rh_pct, round(k % 40 * 3.6::DOUBLE, 6) AS wind_kmh, CASE WHEN k % 4 = 0 THEN round(k % 90 / 10, 6) END AS precip_mm FROM w")
def a12_weather_json(spark, d):
    """Daily weather as JSON with a map of days per variable, one file a year, scanned into rows a day."""
    path, k = _folder(spark), F.col("k")
    days = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.min("o_orderkey").alias("k"))
    values = {"T2M": k % 350 / 10 - 2, "RH2M": (k % 107).cast("double"), "WS10M": (k % 40).cast("double"), "PRECTOTCORR": F.when(k % 4 == 0, k % 90 / 10).otherwise(-999.0)}
    maps = (F.map_from_entries(F.collect_list(F.struct(F.date_format("date", "yyyyMMdd"), v))).alias(n) for n, v in values.items())
    years = days.groupBy(F.year("date").alias("year")).agg(F.struct(F.struct(*maps).alias("parameter")).alias("properties"))
    years.write.partitionBy("year").json(path)
    x = lake.read_daily_weather(spark, path)
    return x.select("date", *(r6(F.col(c), c) for c in ("temp_c", "rh_pct", "wind_kmh", "precip_mm")))


@query("SELECT 'tile ' || s_suppkey AS name, 5::BIGINT AS points, (s_suppkey % 90)::DOUBLE AS west, (s_suppkey % 45)::DOUBLE AS south, (s_suppkey % 90 + 4)::DOUBLE AS east, (s_suppkey % 45 + 4)::DOUBLE AS north FROM supplier")
def a16_placemarks(spark, d):
    """Boxes written as KML placemarks and scanned again."""
    path, k = _folder(spark), F.col("s_suppkey")
    p = lambda i, j: F.concat_ws(",", (k % 90 + i).cast("string"), (k % 45 + j).cast("string"), F.lit("0"))
    ring = F.struct(F.concat_ws(" ", p(0, 0), p(4, 0), p(4, 4), p(0, 4), p(0, 0)).alias("coordinates"))
    boxes = read(spark, d, "supplier").select(F.concat(F.lit("tile "), k.cast("string")).alias("name"), F.struct(ring.alias("LinearRing")).alias("b"))
    boxes.select("name", F.struct(F.col("b").alias("outerBoundaryIs")).alias("Polygon")).write.format("xml").option("rootTag", "kml").option("rowTag", "Placemark").save(path)
    r, x, y = lake.read_placemarks(spark, path), F.transform("ring", lambda q: q["x"]), F.transform("ring", lambda q: q["y"])
    return r.select("name", F.size("ring").cast("long").alias("points"), F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north"))
