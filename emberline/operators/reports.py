"""Filters, summaries and rankings over the alerts table and its like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alert_filter(
    change_type: str | None = None, model_version: str | None = None, beat: str | None = None, min_score: float | None = None,
    min_area: float | None = None, since: str | None = None, until: str | None = None, sar: bool | None = None,
    min_cusum: float | None = None, bbox: str | None = None,
) -> Column:
    """Conjunction of the given conditions; without any, all rows. The box is "west,south,east,north", else ValueError."""
    score = F.coalesce("stacked_score", "confidence")
    conds = []
    for given, cond in (
        (change_type, lambda v: F.col("change_type") == v), (model_version, lambda v: F.col("model_version") == v), (beat, lambda v: F.col("beat_name") == v),
        (min_score, lambda v: score >= v), (min_area, lambda v: F.col("area_ha") >= v), (since, lambda v: F.col("detection_date") >= F.lit(v)),
        (until, lambda v: F.col("detection_date") <= F.lit(v)), (sar, lambda v: F.coalesce("sar_boost_applied", F.lit(False)) == v), (min_cusum, lambda v: F.col("cusum_zone_score") >= v),
    ):
        if given is not None and given != 0 or given is False:  # a least value of 0 is no condition
            conds.append(cond(given))
    if bbox is not None:
        box = [float(x) for x in bbox.split(",")]
        if len(box) != 4:
            raise ValueError("bbox needs four numbers")
        conds += [F.col("centroid_lon").between(box[0], box[2]), F.col("centroid_lat").between(box[1], box[3])]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def beat_summary(alerts: DataFrame) -> DataFrame:
    """Per beat: alerts, area, mean score, boosted share, mean cusum, last date."""
    return alerts.groupBy("beat_name").agg(
        F.count("*").alias("n_alerts"), F.round(F.sum("area_ha"), 4).alias("total_area_ha"),
        F.round(F.avg(F.coalesce("stacked_score", "confidence")), 6).alias("avg_score"),
        F.round(F.avg(F.coalesce("sar_boost_applied", F.lit(False)).cast("int")), 6).alias("boost_rate"),
        F.round(F.avg("cusum_zone_score"), 6).alias("avg_cusum"), F.max("detection_date").alias("last_date"),
    )


def page(alerts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of alerts by falling score, nulls last; ties by id."""
    return alerts.orderBy(F.coalesce("stacked_score", "confidence").desc_nulls_last(), "id").offset(offset).limit(min(limit, 1000))


def top_per_group(df: DataFrame, group: str, n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def confusion_metrics(df: DataFrame, target: str, pred: str) -> DataFrame:
    """Per class: support, precision, recall, F1, IoU from a confusion count."""
    cm = df.groupBy(F.col(target).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    hit = cm.filter("t = p").select(F.col("t").alias("class"), F.col("n").alias("tp"))
    support = cm.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"))
    said = cm.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("said"))
    m = support.join(said, "class", "full").join(hit, "class", "left").na.fill(0, ["support", "said", "tp"])
    tp, eps = F.col("tp"), 1e-8
    precision, recall = tp / (F.col("said") + eps), tp / (F.col("support") + eps)
    return m.select(
        "class", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"),
        F.round(2 * precision * recall / (precision + recall + eps), 6).alias("f1"),
        F.round(tp / (F.col("support") + F.col("said") - tp + eps), 6).alias("iou"),
    )


def idempotent_append(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is not there yet, one per key (the first in order)."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    fresh = incoming.withColumn("__n", first).filter("__n = 1").drop("__n")
    same = reduce(lambda a, b: a & b, (F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in key))
    return fresh.alias("x").join(existing.select(*key).distinct().alias("y"), same, "left_anti")


def threshold_sweep(df: DataFrame, score: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """Precision, recall, F1 at each threshold of a fixed grid, in one pass."""
    at = df.select(F.col(score).alias("s"), truth.cast("int").alias("y"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    c = at.groupBy("threshold").agg(
        F.count(F.when((F.col("s") >= F.col("threshold")) & (F.col("y") == 1), 1)).alias("tp"),
        F.count(F.when((F.col("s") >= F.col("threshold")) & (F.col("y") == 0), 1)).alias("fp"),
        F.count(F.when((F.col("s") < F.col("threshold")) & (F.col("y") == 1), 1)).alias("fn"),
    )
    tp = F.col("tp")
    return c.withColumn("f1", F.round(F.when(2 * tp + F.col("fp") + F.col("fn") > 0, 2 * tp / (2 * tp + F.col("fp") + F.col("fn"))).otherwise(0.0), 6))


def precision_recall(df: DataFrame, score: str, y: str, buckets: int = 1000) -> DataFrame:
    """The curve over falling scores: s (threshold), pos (of equal scores), tp and k (right and all at or above it).

    Rows are counted by score first; scores are then cumulated within buckets of their range and shifted by the buckets above.
    """
    s = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    ends = s.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    s = s.crossJoin(F.broadcast(ends)).withColumn("b", F.floor((F.col("hi") - F.col("s")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * buckets))
    up = Window.orderBy("b")
    above = s.groupBy("b").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bp"))  # a row a bucket
    above = above.select("b", (F.sum("bn").over(up) - F.col("bn")).alias("n0"), (F.sum("bp").over(up) - F.col("bp")).alias("p0"))
    w = Window.partitionBy("b").orderBy(F.desc("s"))
    r = s.withColumn("k", F.sum("n").over(w)).withColumn("tp", F.sum("pos").over(w)).join(above, "b")
    return r.select("s", "pos", (F.col("tp") + F.col("p0")).alias("tp"), (F.col("k") + F.col("n0")).alias("k"))


def average_precision(df: DataFrame, score: str, y: str, buckets: int = 1000) -> DataFrame:
    """Sum of precision times gain in recall over falling scores; equal scores are one step."""
    r = precision_recall(df, score, y, buckets)
    return r.agg(F.round(F.sum(F.col("pos") * F.col("tp") / F.col("k")) / F.sum("pos"), 6).alias("average_precision"), F.max("k").alias("rows"))


def thresholds(df: DataFrame, score: str, y: str, precision: float = 0.8) -> DataFrame:
    """One row: average precision, the threshold of the best F1 (the highest of equals) with its confusion, precision, recall
    and balanced accuracy, and the lowest threshold whose precision is at least ``precision`` (null if none) with its recall. Without right rows recall is null."""
    r = precision_recall(df, score, y)
    one = r.agg(F.sum("pos").alias("all_pos"), F.max("k").alias("rows"), F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("k")), F.sum("pos")).alias("average_precision"))
    r = r.crossJoin(F.broadcast(one)).withColumns({"f1": 2 * F.col("tp") / (F.col("k") + F.col("all_pos")), "p": F.col("tp") / F.col("k"), "r": F.try_divide(F.col("tp"), F.col("all_pos"))})
    best = F.max(F.struct("f1", F.col("s").alias("threshold"), "tp", "k", "p", "r")).alias("b")
    safe = F.min(F.when(F.col("p") >= precision, F.struct(F.col("s").alias("threshold"), "r"))).alias("q")
    out = r.groupBy("all_pos", "rows", "average_precision").agg(best, safe)
    fp, fn = F.col("b.k") - F.col("b.tp"), F.col("all_pos") - F.col("b.tp")
    tn = F.col("rows") - F.col("all_pos") - fp
    return out.select(
        "rows", "average_precision", "b.threshold", "b.f1", F.col("b.p").alias("precision"), F.col("b.r").alias("recall"), F.col("b.tp").alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        ((F.col("b.r") + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"), F.col("q.threshold").alias("safe_threshold"), F.col("q.r").alias("safe_recall"),
    )


def numbered(df: DataFrame, group: str, bucket: str, *order: str) -> DataFrame:
    """Add ``nth`` (from 1) within each group by (bucket, order): counted in the buckets and shifted by those before."""
    counts = df.groupBy(group, bucket).agg(F.count("*").alias("__n"))
    starts = counts.select(group, bucket, (F.sum("__n").over(Window.partitionBy(group).orderBy(bucket)) - F.col("__n")).alias("__start"))
    within = df.withColumn("__nth", F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order)))
    return within.join(starts, [group, bucket]).withColumn("nth", F.col("__start") + F.col("__nth")).drop("__start", "__nth")
