"""Incremental forms: running counts, windows over event time, deduplication, and weather codes carried per station."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fire import START, step_codes, with_indices
from ..operators.grid import shared_folder


def read_stream(spark: SparkSession, path: str, schema, glob: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def cumulative_alerts(stream: DataFrame, key: str, fired: str) -> DataFrame:
    """Alerts so far per key (update or complete mode)."""
    return stream.groupBy(key).agg(F.count(F.when(F.col(fired), 1)).alias("cum_alert_count"), F.count("*").alias("n"))


def windowed(stream: DataFrame, at: str, size: str, slide: str | None, late: str, value: str) -> DataFrame:
    """Tumbling or hopping event-time windows behind a watermark."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def carried_codes(weather: DataFrame) -> DataFrame:
    """Fire-weather codes of a stream of station days: the state of a station is its last three codes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        codes, last = (state.get[:3], state.get[3]) if state.exists else (tuple(START.values()), None)
        rows = pd.concat(list(frames)).sort_values("date")
        out = []
        for r in rows.itertuples():
            day = pd.Timestamp(r.date)
            if last is not None and day.toordinal() <= last:  # already counted
                continue
            if last is not None and day.year != pd.Timestamp.fromordinal(last).year:
                codes = tuple(round(c, 1) for c in codes)
            codes, last = step_codes(codes, r.temp_c, r.rh_pct, r.wind_kmh, r.precip_mm, day.month), day.toordinal()
            out.append((key[0], day.date(), r.wind_kmh, *codes))
        if last is not None:
            state.update((*codes, last))
        yield pd.DataFrame(out, columns=["station", "date", "wind_kmh", "ffmc", "dmc", "dc"])

    codes = weather.groupBy("station").applyInPandasWithState(
        step, "station string, date date, wind_kmh double, ffmc double, dmc double, dc double", "ffmc double, dmc double, dc double, last int", "append", "NoTimeout"
    )
    return with_indices(codes)


def new_days_only(days: DataFrame, state: DataFrame, key: str, at: str) -> DataFrame:
    """Rows newer than each key's high-water mark."""
    return days.join(state.select(key, F.col(at).alias("__seen")), key, "left").filter(F.col("__seen").isNull() | (F.col(at) > F.col("__seen"))).drop("__seen")


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there into a Parquet table of the shared folder, and read it.

    Appended rows are added to the table; a complete result replaces it.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/emberline/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/table")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/table"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def drained_again(stream: DataFrame, folder: str) -> DataFrame:
    """Append what has arrived since the last call with this ``folder``, where state and table stay, and read the table."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{folder}/table").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")
