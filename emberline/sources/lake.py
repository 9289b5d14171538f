"""Scans and sinks: CSV detections, day-partitioned lake, GeoJSON and KML features, weather JSON, logs, snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import frp_bin
from ..schemas import DETECTIONS
from ..streaming.refresh import VersionedTable

SNAPSHOT = "snapshot_day"


def read_detections_csv(spark: SparkSession, path: str) -> DataFrame:
    """Detections from CSV with headers in any case; only h/high and n/nominal confidences stay."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    typed = [(f.split()[0], f.split()[1]) for f in DETECTIONS.split(", ")]
    x = raw.select(*(F.expr(f"try_cast({c} AS {t})").alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in typed))
    level = F.lower(F.trim("confidence"))
    level = F.when(level.isin("h", "high"), "high").when(level.isin("n", "nominal"), "nominal").when(level.isin("l", "low"), "low").otherwise(level)
    at = F.to_timestamp(F.concat_ws(" ", F.col("acq_date").cast("string"), F.lpad(F.col("acq_time").cast("string"), 4, "0")), "yyyy-MM-dd HHmm")
    return x.withColumn("confidence", level).filter(F.col("confidence").isin("high", "nominal")).withColumn("acq_datetime", at).withColumn("frp_category", frp_bin(F.col("frp")))


def write_detections(df: DataFrame, lake: str) -> None:
    """Parquet by year, month, day; only the days in the frame are replaced. A large day is split over several tasks."""
    out = df.withColumns({"year": F.year("acq_date"), "month": F.month("acq_date"), "day": F.dayofmonth("acq_date")})
    out.hint("rebalance", "year", "month", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "day").parquet(lake)


def read_range(spark: SparkSession, lake: str, start: dt.date, end: dt.date) -> DataFrame:
    """Detections between two days; the filter on year, month and day prunes partitions, missing days add nothing."""
    day = F.make_date("year", "month", "day")
    months = sorted({(start + dt.timedelta(n)).year for n in range((end - start).days + 1)})
    return spark.read.parquet(lake).filter(F.col("year").isin(months) & day.between(F.lit(start), F.lit(end)))


def read_day(spark: SparkSession, lake: str, day: dt.date) -> DataFrame:
    """Detections of one day; FileNotFoundError if the lake has none."""
    out = read_range(spark, lake, day, day)
    if not out.limit(1).count():
        raise FileNotFoundError(f"no detections on {day}")
    return out


def compact_years(spark: SparkSession, lake: str, out: str) -> None:
    """Day partitions to a file set a year: one file of a small year, several tasks for a large one."""
    spark.read.parquet(lake).drop("month", "day").hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(out)


def plan_chunks(spark: SparkSession, sources: list[tuple[str, dt.date]], start: dt.date, end: dt.date, days: int, done: DataFrame | None = None) -> DataFrame:
    """Download chunks (source, start, end) of ``days`` days, clipped to each source's first day, without those done."""
    s = spark.createDataFrame(sources, "source string, first date")
    s = s.withColumn("from", F.greatest(F.col("first"), F.lit(start))).filter(F.col("from") <= F.lit(end))
    c = s.select("source", F.explode(F.sequence("from", F.lit(end), F.make_interval(days=F.lit(days)))).alias("start"))
    c = c.withColumn("end", F.least(F.date_add("start", days - 1), F.lit(end)))
    return c.join(done.select("source", "start"), ["source", "start"], "left_anti") if done is not None else c


def prefer_first(*frames: DataFrame, by: str) -> DataFrame:
    """Rows of the first frame that has any for a value of ``by``.

    The least frame of each value is found by an aggregation, and the rows are held against it, so no task ranks a whole value.
    """
    tagged = [f.withColumn("__p", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    least = out.groupBy(F.col(by).alias("__by")).agg(F.min("__p").alias("__least"))
    return out.join(least, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__p") == F.col("__least")), "left_semi").drop("__p")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections: file, properties (map), ring (array of x, y structs of the outer boundary)."""
    props = "map<string, string>"
    schema = f"type string, features array<struct<type: string, properties: {props}, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), F.explode("features").alias("f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select("file", F.col("f.properties").alias("properties"), ring.alias("ring"))


def write_features(df: DataFrame, path: str, ring: str, properties: list[str]) -> None:
    """One JSON feature a line."""
    coords = F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Names and outer rings of KML placemarks."""
    schema = "name string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
    k = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    points = F.filter(F.split(F.trim("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+"), lambda p: p != "")
    ring = F.transform(points, lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))
    return k.select("name", ring.alias("ring"))


def read_daily_weather(spark: SparkSession, path: str) -> DataFrame:
    """Weather JSON with a map of days per variable to one row a day; wind from m/s to km/h, -999 becomes null."""
    names = {"T2M": "temp_c", "RH2M": "rh_pct", "WS10M": "wind_ms", "PRECTOTCORR": "precip_mm"}
    schema = "properties struct<parameter: struct<" + ", ".join(f"{k}: map<string, double>" for k in names) + ">>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select("properties.parameter.*")
    days = raw.select(F.explode(F.map_keys("T2M")).alias("day"), *names)
    clean = lambda c: F.when(F.col(c) > -900, F.col(c))
    x = days.select(F.to_date("day", "yyyyMMdd").alias("date"), *(F.element_at(k, F.col("day")).alias(v) for k, v in names.items()))
    x = x.select("date", *(clean(c).alias(c) for c in names.values()))
    return x.select("date", "temp_c", F.greatest(F.lit(0.0), F.least(F.lit(100.0), "rh_pct")).alias("rh_pct"), (F.col("wind_ms") * 3.6).alias("wind_kmh"), "precip_mm")


def grid_candidates(grid: DataFrame, stations: DataFrame) -> DataFrame:
    """Grid points within a degree of each station: all columns and the squared distance ``d2``."""
    near = grid.withColumn("cell", F.struct(F.floor("lat"), F.floor("lon")))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    s = stations.withColumn("dy", F.explode(step)).withColumn("dx", F.explode(step)).withColumn("cell", F.struct(F.floor("s_lat") + F.col("dy"), F.floor("s_lon") + F.col("dx")))
    d2 = F.pow(F.col("lat") - F.col("s_lat"), 2) + F.pow(F.col("lon") - F.col("s_lon"), 2)
    hit = s.join(near, "cell").withColumn("d2", d2)
    return hit.filter((F.abs(F.col("lat") - F.col("s_lat")) <= 1) & (F.abs(F.col("lon") - F.col("s_lon")) <= 1)).drop("dx", "dy", "cell")


def nearest_grid_weather(grid: DataFrame, stations: DataFrame) -> DataFrame:
    """Each station with the values of the nearest grid point; kelvin and metres are converted."""
    best = grid_candidates(grid, stations).groupBy("station").agg(F.min(F.struct("d2", "temp", "precip")).alias("v"))
    t = F.col("v.temp")
    return best.select("station", F.when(t > 100, t - 273.15).otherwise(t).alias("temp_c"), (F.col("v.precip") * 1000).alias("precip_mm"))


def _snapshots(spark: SparkSession, root: str, schema: StructType) -> VersionedTable:
    return VersionedTable(spark, root, StructType([*schema, StructField(SNAPSHOT, StringType())]), SNAPSHOT)


def publish(df: DataFrame, root: str, day: dt.date) -> None:
    """Publish the rows of a day; a day that was there is replaced.

    The rows are written beside the earlier ones and readers turn to them by one rename, so none meets a half-written day.
    """
    snapshots = _snapshots(df.sparkSession, root, df.schema)
    snapshots.replace(snapshots.state()[0] + 1, df.withColumn(SNAPSHOT, F.lit(str(day))), [str(day)])


def read_published(spark: SparkSession, root: str, schema: StructType, day: dt.date | None = None) -> DataFrame:
    """The rows published for ``day``, or for the latest day; none if nothing was."""
    snapshots = _snapshots(spark, root, schema)
    days = [str(day)] if day else [max(snapshots.state()[1], default="")]
    return snapshots.read(days).drop(SNAPSHOT)


def append_log(df: DataFrame, path: str) -> None:
    """Add entries to a log, one JSON object a line; what is there stays, and a null field is left out."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a log by the fields of ``schema``; a line that is no JSON object gives no entry."""
    bad = "__bad"
    entry = F.from_json("value", f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad})
    return spark.read.text(path).select(entry.alias("e")).filter(F.col("e").isNotNull() & F.col(f"e.{bad}").isNull()).select("e.*").drop(bad)


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """Status rows from text logs: beat, date, status, cloud share."""
    g = lambda i: F.regexp_extract("value", r"^\[(\w[\w ]*)\] (\d{4}-\d{2}-\d{2}) (PASS|SKIP|FAIL)(?:.*cloud=([\d.]+))?", i)
    x = spark.read.text(path).select(g(1).alias("beat"), F.expr("try_cast(regexp_extract(value, '(\\\\d{4}-\\\\d{2}-\\\\d{2})', 1) AS date)").alias("date"), g(3).alias("status"), F.expr("try_cast(nullif(regexp_extract(value, 'cloud=([\\\\d.]+)', 1), '') AS double)").alias("cloud"))
    return x.filter("status <> ''")


def window_tables(spark: SparkSession, path: str) -> DataFrame:
    """Pixel tables with region and dates taken from the name ``<region>_<before>_<after>`` of the file or its folder."""
    g = lambda i: F.regexp_extract("_metadata.file_path", r"([^/_]+)_(\d{8})_(\d{8})", i)
    return spark.read.parquet(path).select("*", g(1).alias("region"), F.to_date(g(2), "yyyyMMdd").alias("date_before"), F.to_date(g(3), "yyyyMMdd").alias("date_after"))


def named_bands(df: DataFrame, bands: str, names: list[str]) -> DataFrame:
    return df.select(*(c for c in df.columns if c != bands), *(F.col(bands)[i].alias(n) for i, n in enumerate(names)))


def chunks_of(sources: DataFrame, start: dt.date, end: dt.date, days: int) -> DataFrame:
    """Chunks (source, start, end) of ``days`` days of each of ``sources(source, first)``, from its first day on."""
    s = sources.withColumn("from", F.greatest(F.col("first"), F.lit(start))).filter(F.col("from") <= F.lit(end))
    c = s.select("source", F.explode(F.sequence("from", F.lit(end), F.make_interval(days=F.lit(days)))).alias("start"))
    return c.withColumn("end", F.least(F.date_add("start", days - 1), F.lit(end)))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features one a line: properties (map), ring (array of x, y structs of the outer boundary)."""
    f = spark.read.schema("properties map<string, string>, geometry struct<coordinates: array<array<array<double>>>>").json(path)
    return f.select("properties", F.transform(F.col("geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def regions_named(regions: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """Regions whose name is one of those wanted, in any case."""
    return regions.filter(F.lower(F.trim(name)).isin(*(w.strip().lower() for w in wanted)))


def write_manifest(chips: DataFrame, path: str, split: str) -> None:
    """The manifest as CSV with a header, a folder a split."""
    chips.write.mode("overwrite").option("header", True).partitionBy(split).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Chips of a manifest with polarity and number from their names ``chip_<polarity>_<number>``."""
    g = lambda i: F.regexp_extract("chip", r"^chip_(pos|neg)_(\d+)$", i)
    return spark.read.option("header", True).csv(path).select("*", g(1).alias("polarity"), F.expr("try_cast(regexp_extract(chip, '_([0-9]+)$', 1) AS bigint)").alias("number"))


def bbox_mean_weather(grid: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Mean of the grid points inside the box (west, south, east, north) per lead time; kelvin is converted."""
    t = F.avg("temp")
    inside = grid.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return inside.groupBy("lead_h").agg(F.count("*").alias("points"), F.when(t > 100, t - 273.15).otherwise(t).alias("temp_c"), F.avg("precip").alias("precip"))


def save_models(models: DataFrame, path: str) -> None:
    """Models one JSON object a line."""
    models.write.mode("overwrite").json(path)


def load_models(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
