"""Exact quantiles of large groups, without a task that holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import persist_table, remove_tables

#: Cuts of the sketch's grid, its accuracy, and the number of groups up to which their bounds are broadcast.
CUTS, ACCURACY, GROUPS = 500, 20_000, 10_000


def exact_quantiles(df: DataFrame, value: str, wanted: dict[str, float], by: list[str] | None = None, cuts: int = CUTS) -> DataFrame:
    """``by`` and a column a wanted quantile (name -> share), interpolated between neighbouring values, and ``n``.

    Three steps. A sketch (small, mergeable) encloses each wanted rank between two values, a few cuts of its grid apart. A second
    scan counts exactly what lies below each pair of bounds and what lies between. Only the values in between, a small share
    of the rows, are then ordered: counted a value, range-partitioned, and summed a partition, so ties of any size are one row
    and a task holds a partition of them. Where the sketch's bounds miss a rank, the whole range takes their place, so the
    result is exact in any case. Nulls and NaN are left out; groups without values have no row, a whole table without any
    has nulls.
    """
    groups, names, shares = by or [], [*wanted], [*wanted.values()]
    by = [f"__by{i}" for i in range(len(groups))]  # names of our own columns may clash with theirs
    rows = df.select(*(F.col(c).alias(b) for c, b in zip(groups, by)), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    grid = F.percentile_approx("v", F.array(*(F.lit(i / cuts) for i in range(cuts + 1))), ACCURACY)
    sketch = persist_table(rows.groupBy(*by).agg(F.count("*").alias("n"), grid.alias("g"), F.min("v").alias("low"), F.max("v").alias("high")), "sketch")
    n = F.col("n")
    place = lambda q: F.lit(q) * (n - 1)
    lower, upper = F.array(*(F.floor(place(q)) for q in shares)), F.array(*(F.ceil(place(q)) for q in shares))
    start = F.array(*(F.get("g", F.lit(max(0, int(q * cuts) - 1))) for q in shares))
    end = F.array(*(F.get("g", F.lit(min(cuts, int(q * cuts) + 2))) for q in shares))
    bounds = sketch.select(*by, "n", "low", "high", lower.alias("lower"), upper.alias("upper"), start.alias("start"), end.alias("end"))

    def met(left: DataFrame, small: DataFrame) -> DataFrame:
        few = sketch.count() <= GROUPS
        small = F.broadcast(small) if few else small
        return left.join(small, by) if by else left.crossJoin(small)

    at = range(len(shares))
    below = F.array(*(F.count_if(F.col("v") < F.col("start")[i]) for i in at))
    inside = F.array(*(F.count_if(F.col("v").between(F.col("start")[i], F.col("end")[i])) for i in at))
    counted = met(rows, bounds).groupBy(*by).agg(below.alias("below"), inside.alias("inside"), *(F.first(c).alias(c) for c in ("n", "low", "high", "lower", "upper", "start", "end")))
    held = [(F.col("below")[i] <= F.col("lower")[i]) & (F.col("upper")[i] < F.col("below")[i] + F.col("inside")[i]) for i in at]
    pick = lambda a, b: F.array(*(F.when(held[i], a[i]).otherwise(b) for i in at))
    bounds = persist_table(counted.select(
        *by, "n", "lower", "upper", pick(F.col("start"), F.col("low")).alias("start"), pick(F.col("end"), F.col("high")).alias("end"), pick(F.col("below"), F.lit(0).cast("long")).alias("below"),
    ), "bounds")
    found = F.filter(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: F.col("v").between(F.get("start", i), F.get("end", i)))
    between = met(rows, bounds.select(*by, "start", "end")).select(*by, F.explode(found).alias("i"), "v").groupBy(*by, "i", "v").agg(F.count("*").alias("many"))
    ordered = persist_table(between.repartitionByRange(*by, "i", "v").withColumn("part", F.spark_partition_id()), "between")
    spans = ordered.groupBy(*by, "i", "part").agg(F.sum("many").alias("span"))
    spans = spans.withColumn("before", F.sum("span").over(Window.partitionBy(*by, "i").orderBy("part")) - F.col("span")).drop("span")
    upto = F.sum("many").over(Window.partitionBy(*by, "i", "part").orderBy("v"))
    placed = ordered.withColumn("last", upto).join(spans, [*by, "i", "part"])
    placed = met(placed, bounds.select(*by, "n", "lower", "upper", "below"))
    end_rank = F.col("last") + F.col("before") + F.get("below", F.col("i"))
    hit = lambda ranks: F.when((F.get(ranks, F.col("i")) < end_rank) & (F.get(ranks, F.col("i")) >= end_rank - F.col("many")), F.col("v"))
    values = placed.groupBy(*by, "i").agg(F.max(hit("lower")).alias("a"), F.max(hit("upper")).alias("b"), F.first("n").alias("n"))
    share = F.element_at(F.array(*map(F.lit, map(float, shares))), F.col("i") + 1)
    values = values.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (share * (n - 1) - F.floor(share * (n - 1))))
    column = lambda i, name: F.max(F.when(F.col("i") == i, F.col("q"))).alias(name)
    out = values.groupBy(*by).agg(*(column(i, name) for i, name in enumerate(names)), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    out = persist_table(out.withColumnsRenamed(dict(zip(by, groups))), "quantiles")
    remove_tables(sketch, bounds, ordered)
    return out


def with_quantiles(df: DataFrame, value: str, wanted: dict[str, float], among: Column | None = None) -> DataFrame:
    """``df`` beside the quantiles of its (or the chosen) values, as one broadcast row."""
    q = exact_quantiles(df.filter(among) if among is not None else df, value, wanted).drop("n")
    return df.crossJoin(F.broadcast(q))
