"""Operators over ordered observations of a key: pairs, streaks, running states, cumulative sums, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive_pairs(df: DataFrame, key: str, order: list[str], date: str, measures: list[str], max_gap: int = 90) -> DataFrame:
    """Each observation with the one before: ``<m>_before``, gap in days; first ones and gaps outside (0, max_gap] go.

    Repeated (key, date) rows keep the first in order, after the shift, so a dropped row still counts as predecessor.
    """
    w = Window.partitionBy(key).orderBy(*order)
    paired = df.select("*", *(F.lag(m).over(w).alias(f"{m}_before") for m in measures), F.lag(date).over(w).alias(f"{date}_before"))
    first = F.row_number().over(Window.partitionBy(key, date).orderBy(*order))
    paired = paired.filter(F.col(f"{date}_before").isNotNull()).withColumn("__n", first).filter("__n = 1").drop("__n")
    paired = paired.withColumn("gap", F.datediff(date, f"{date}_before"))
    return paired.filter((F.col("gap") > 0) & (F.col("gap") <= max_gap))


def running_state(df: DataFrame, key: str, order: list[str], fired: Column, delta: Column) -> DataFrame:
    """State before each row: alerts so far, summed change, deepest loss (at most 0), rows since the first alert (-1: none)."""
    w = Window.partitionBy(key).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(w)
    return (
        df.withColumn("__fired", fired.cast("int")).withColumn("__delta", delta).withColumn("__nth", nth)
        .withColumn("cum_alert_count", F.coalesce(F.sum("__fired").over(past), F.lit(0)))
        .withColumn("cum_delta", F.coalesce(F.sum("__delta").over(past), F.lit(0.0)))
        .withColumn("max_loss_so_far", F.least(F.lit(0.0), F.coalesce(F.min("__delta").over(past), F.lit(0.0))))
        .withColumn("windows_since_first_alert", F.coalesce(F.col("__nth") - F.min(F.when(F.col("__fired") == 1, F.col("__nth"))).over(past), F.lit(-1)))
        .withColumn("already_detected", F.coalesce(F.max("__fired").over(past), F.lit(0)) == 1)
        .drop("__fired", "__delta", "__nth")
    )


def reversals(df: DataFrame, key: str, order: list[str], delta: str, least: float) -> DataFrame:
    """Whether the next change has the other sign and at least ``least``; the last row has none."""
    nxt = F.lead(delta).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("reversal", F.coalesce((F.signum(nxt) == -F.signum(delta)) & (F.abs(nxt) >= least), F.lit(False)))


def streaks(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Longest and current (last) run of consecutive flagged rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.select(key, F.row_number().over(w).alias("n"), flag.alias("f"))
    island = F.col("n") - F.row_number().over(Window.partitionBy(key, "f").orderBy("n"))
    runs = marked.withColumn("island", island).groupBy(key, "f", "island").agg(F.count("*").alias("run"), F.max("n").alias("end"))
    return runs.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col("f"), F.col("run"))), F.lit(0)).alias("max_streak"),
        F.when(F.max_by("f", "end"), F.max_by("run", "end")).otherwise(0).alias("cur_streak"),
    )


def cusum(df: DataFrame, key: str, order: list[str], step: Column) -> DataFrame:
    """One-sided CUSUM S = max(0, S + step), as prefix sum minus its running minimum (at most 0)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = df.withColumn("__c", F.sum(step).over(w))
    return total.withColumn("cusum", F.col("__c") - F.least(F.lit(0.0), F.min("__c").over(w))).drop("__c")


def fill_both_ways(df: DataFrame, key: str, order: list[str], cols: list[str]) -> DataFrame:
    """Last value before, else first value after."""
    w = Window.partitionBy(key).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in cols})


def interpolate(df: DataFrame, key: str, at: str, col: str) -> DataFrame:
    """Linear interpolation of null values over ``at``; the edges carry the nearest value."""
    w = Window.partitionBy(key).orderBy(at)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(col).isNotNull(), F.struct(at, col))
    df = df.withColumn("__p", F.last(known, ignorenulls=True).over(back)).withColumn("__n", F.first(known, ignorenulls=True).over(ahead))
    p, n = F.col("__p"), F.col("__n")
    line = p[col] + (n[col] - p[col]) * (F.col(at) - p[at]) / (n[at] - p[at])
    return df.withColumn(col, F.coalesce(F.col(col), line, p[col], n[col])).drop("__p", "__n")


def merge_ranges(df: DataFrame, key: str, start: str, end: str, gap_days: int = 1) -> DataFrame:
    """Unite overlapping date ranges of a key, and those at most ``gap_days`` apart."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.datediff(start, reach) > gap_days), 1).otherwise(0)
    marked = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def nearest_asof(left: DataFrame, right: DataFrame, row: str, key: str, left_at: str, right_at: str, days: int, value: str) -> DataFrame:
    """Left rows with the right row of the key nearest in time within ``days``; of equally near ones the later. ``row`` tells left rows apart.

    Rows meet on the key and a bucket of ``days``; each left row looks into three buckets, so no key's history is
    crossed with itself.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days).cast("int")
    probes = left.withColumn("__b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: bucket(left_at) + i)))
    found = right.select(F.col(key).alias("__k"), F.col(right_at).alias("__at"), F.col(value).alias("__v"), bucket(right_at).alias("__b2"))
    gap = F.datediff("__at", left_at)
    hit = probes.join(found, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__b2")) & (F.abs(gap) <= days))
    best = hit.groupBy(row).agg(F.min(F.struct(F.abs(gap).alias("gap"), (gap < 0).alias("earlier"), F.col("__v").alias("v"))).alias("m"))
    kept = probes.filter(F.col("__b") == bucket(left_at)).drop("__b")
    return kept.join(best, row, "left").select(*left.columns, F.col("m.gap").alias("gap_days"), F.col("m.v").alias(value))


def temporal_stack(df: DataFrame, key: str, fired: Column, p: Column, min_fires: int = 2) -> DataFrame:
    """Stack of a key's scores: fires, sum, mean, consistency = 1 - clip(std / mean), score = sum * sqrt(consistency)."""
    agg = df.groupBy(key).agg(
        F.count(F.when(fired, 1)).alias("n_fires"), F.sum(F.when(fired, p)).alias("s1"), F.sum(F.when(fired, p * p)).alias("s2")
    )
    mean = F.col("s1") / F.col("n_fires")
    var = F.greatest(F.col("s2") / F.col("n_fires") - mean * mean, F.lit(0.0))
    agg = agg.withColumn("mean_p", F.coalesce(mean, F.lit(0.0)))
    agg = agg.withColumn("consistency", F.when(F.col("mean_p") > 0.01, 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sqrt(var) / F.col("mean_p")))).otherwise(1.0))
    score = F.when(F.col("n_fires") >= min_fires, F.col("s1") * F.sqrt("consistency")).otherwise(0.0)
    return agg.withColumn("stacked_score", score).drop("s1", "s2")


def latest_before(rows: DataFrame, events: DataFrame, key: str, at: str, event_at: str, out: str) -> DataFrame:
    """``rows`` with the date of the key's latest event strictly before ``at``, null without one.

    As-of over years: events of the row's own year are found by a window a key and year, those of earlier years by the last
    event of each year, carried forward. So a key's window holds a year of it, and a row a year of the rest.
    """
    day, year = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")), F.year
    e = events.select(key, F.col(event_at).cast("date").alias("__e")).distinct()
    both = rows.withColumns({"__e": F.lit(None).cast("date"), "__d": day(at), "__y": year(at)})
    both = both.unionByName(e.select(key, "__e", day("__e").alias("__d"), year("__e").alias("__y")).withColumn("__event", F.lit(True)), allowMissingColumns=True)
    inside = F.max("__e").over(Window.partitionBy(key, "__y").orderBy("__d").rangeBetween(Window.unboundedPreceding, -1))
    years = both.groupBy(key, "__y").agg(F.max("__e").alias("__last"))
    before = F.max("__last").over(Window.partitionBy(key).orderBy("__y").rowsBetween(Window.unboundedPreceding, -1))
    years = years.select(F.col(key).alias("__k"), F.col("__y").alias("__ky"), before.alias("__before"))
    found = both.withColumn("__in", inside).filter("__event is null").join(years, F.col(key).eqNullSafe(F.col("__k")) & F.col("__y").eqNullSafe(F.col("__ky")), "left")
    return found.select(*rows.columns, F.coalesce("__in", "__before").alias(out))
