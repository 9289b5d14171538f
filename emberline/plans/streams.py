"""Streaming queries, each drained over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.grid import shared_folder
from ..streaming import refresh, streams
from .fires import INDEX_COLUMNS, INDEX_SQL, weather
from .registry import query, r6, read


def _events(spark, d):
    return streams.read_stream(spark, d, read(spark, d, "events").schema, "events.parquet")


def _name() -> str:
    return f"emberline_{uuid.uuid4().hex[:12]}"


@query("SELECT user_id AS pixel, count(*) FILTER (event_type = 'error') AS cum_alert_count, count(*) AS n FROM events GROUP BY user_id")
def m2_cumulative_alerts(spark, d):
    s = _events(spark, d).select(F.col("user_id").alias("pixel"), (F.col("event_type") == "error").alias("fired"))
    return streams.drained(streams.cumulative_alerts(s, "pixel", "fired"), "complete", _name())


@query("SELECT time_bucket(INTERVAL 12 HOURS, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def m6_overpass_windows(spark, d):
    s = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.drained(streams.windowed(s, "ts", "12 hours", None, "2 days", "value"), "complete", _name())
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", r6(F.col("mean"), "mean"))


@query("SELECT w AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 3 DAYS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 DAYS, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 DAYS]) AS w FROM events) GROUP BY w")
def m7_hopping_windows(spark, d):
    s = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.drained(streams.windowed(s, "ts", "6 days", "3 days", "6 days", "value"), "complete", _name())
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT min(user_id) AS low, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events)")
def m5_deduplicated(spark, d):
    s = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "user_id", "event_type", "value")
    out = streams.drained(streams.deduplicated(s, ["user_id", "event_type", "value"], "ts", "60 days"), "append", _name())
    return out.agg(F.min("user_id").alias("low"), F.count("*").alias("n"))


@query("WITH s AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN s USING (user_id) WHERE s.seen IS NULL OR e.ts > s.seen GROUP BY e.user_id")
def m1_high_water_mark(spark, d):
    e = read(spark, d, "events")
    state = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return streams.new_days_only(e, state, "user_id", "ts").groupBy("user_id").agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 10 DAYS))::DATE AS day) SELECT n_name AS beat, day, count(c_custkey) AS n FROM nation CROSS JOIN d LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 10 = dayofyear(day) // 10 % 10 GROUP BY ALL")
def m8_backfill_grid(spark, d):
    n, c = read(spark, d, "nation"), read(spark, d, "customer")
    days = n.select("n_name", "n_nationkey", F.explode(F.expr("sequence(date'2024-01-01', date'2024-03-31', interval 10 days)")).alias("day"))
    j = days.join(c, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_custkey") % 10 == F.floor(F.dayofyear("day") / 10) % 10), "left")
    return j.groupBy(F.col("n_name").alias("beat"), "day").agg(F.count("c_custkey").alias("n"))


#: Arrivals: the second half of the days, the first day (late), and newer versions of some old rows come in a second batch.
_ARRIVALS = """e AS (SELECT event_id, ts::DATE::VARCHAR AS day, event_type, round(value * 100)::BIGINT AS cents, user_id FROM events),
x AS (SELECT event_id, day, event_type, CASE WHEN event_id % 50 = 7 THEN cents + 1 ELSE cents END AS cents, user_id FROM e)"""
_TOTALS = "count(*) AS n, sum(cents)::BIGINT AS cents, count(DISTINCT user_id) AS pixels"


@query(f"WITH {_ARRIVALS} SELECT 'day' AS period, day AS at, event_type, {_TOTALS} FROM x GROUP BY ALL UNION ALL SELECT 'month', day[:7], event_type, {_TOTALS} FROM x GROUP BY day[:7], event_type")
def m4_refresh(spark, d):
    """Two drained arrivals and one that comes again keep the days' and the months' table; both are returned."""
    folder = f"{shared_folder(spark)}/emberline/refresh-{uuid.uuid4().hex}"
    e = read(spark, d, "events").select("event_id", F.to_date("ts").cast("string").alias("day"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "user_id", F.lit(1).alias("seen"))
    first, last = e.agg(F.min("day"), F.max("day")).first()
    half = F.date_add(F.lit(first).cast("date"), F.floor(F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) / 2).cast("int")).cast("string")
    early = (F.col("day") <= half) & (F.col("day") > F.lit(first))
    newer = e.filter(F.col("event_id") % 50 == 7).withColumns({"cents": F.col("cents") + 1, "seen": F.lit(2)})
    base = refresh.VersionedTable(spark, f"{folder}/base", "event_id long, day string, event_type string, cents long, user_id long, seen int", "day")

    def totals(by: str, at):
        schema = f"{by} string, event_type string, n long, cents long, pixels long"
        made = lambda rows: rows.groupBy(at.alias(by), "event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.countDistinct("user_id").alias("pixels"))
        return refresh.VersionedTable(spark, f"{folder}/{by}", schema, by), made

    (days, by_day), (months, by_month) = totals("day", F.col("day")), totals("month", F.substring("day", 1, 7))
    keep = refresh.DailyRefresh(base, ["event_id"], "seen", [refresh.Dependent(days, lambda x: x, by_day), refresh.Dependent(months, lambda x: x[:7], by_month)])
    for part in (e.filter(early), e.filter(~early).unionByName(newer)):
        part.write.mode("append").parquet(f"{folder}/arrivals")
        refresh.drain(spark.readStream.schema(e.schema).parquet(f"{folder}/arrivals"), keep, f"{folder}/state")
    keep(e.filter(~early).unionByName(newer), base.state()[0])  # comes again: changes nothing
    columns = ["event_type", "n", "cents", "pixels"]
    out = days.read().select(F.lit("day").alias("period"), F.col("day").alias("at"), *columns)
    return out.unionByName(months.read().select(F.lit("month").alias("period"), F.col("month").alias("at"), *columns))


@query(INDEX_SQL + f" SELECT {INDEX_COLUMNS} FROM idx")
def m3_carried_codes(spark, d):
    """The fire-weather codes of a stream, each station's last codes carried as state from one arrival of days to the next."""
    folder = f"{shared_folder(spark)}/emberline/codes-{uuid.uuid4().hex}"
    w = weather(spark, d)
    first, last = w.agg(F.min("date"), F.max("date")).first()
    middle = first + (last - first) / 2
    for part in (w.filter(F.col("date") <= F.lit(middle)), w.filter(F.col("date") > F.lit(middle))):
        part.write.mode("append").parquet(f"{folder}/arrivals")
        out = streams.drained_again(streams.carried_codes(spark.readStream.schema(w.schema).parquet(f"{folder}/arrivals")), folder)
    return out.select("station", "date", *(F.round(c, 3).alias(c) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")), "danger_class")
