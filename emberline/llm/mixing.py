"""Operator 2: mixing sources to target weights, with DataFrame functions only.

Each source's words form one stream, cut into blocks of ``block`` words (a ``FINE``-th of its target in small sources, so
that these meet theirs too). The mix is a row of slots, grouped into
output shards. How many slots of a shard go to each source is drawn from the multinomial distribution of the target
weights, given each source's total over all shards: a free draw would miss small targets by its sampling error, the
conditioned one meets them. Slot j of a source takes the block at index ``perm(j mod blocks)`` of a pseudorandom
permutation of the source's block indices, so all blocks are taken once before one is taken again; slots and
blocks are joined by that index.

The permutations are swap-or-not shuffles: a bijection of 0..n-1 for any n, computed row by row without a sort.

Null texts have no words, are taken 0 times; a null source is a source of its own, ordered last; repeated rows are
documents of their own; a very long text is one row over many blocks; an empty table gives an empty result. Runs over the
same rows agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, keep, parts, unused

WEIGHTS = (5, 2, 1)
CAP = 3
ROUNDS = 8
FINE = 256


def round_keys(n: Column, key: Column) -> Column:
    """One offset in 0..n-1 for each round of ``permuted``."""
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.pmod(F.xxhash64(key, r), n))


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """Image of x under a pseudorandom permutation of 0..n-1 that ``keys`` choose (swap-or-not)."""

    def swap(v, k):
        mirror = F.pmod(k - v, n)
        return F.when(F.xxhash64(k, F.greatest(v, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(v)

    return F.aggregate(keys, x.cast("long"), swap)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Add ``target`` to ``sizes(source, source_size)``: shares of all sizes by weight, none above ``cap`` times its own.

    Sources are few; a window over all of them is a window over a summary of the table. In order of cap over weight, a
    source is capped while an even share of what the sources before have left would take it above its cap.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = (
        sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("left") * F.col("weight") > F.col("most") * F.col("weights"))
        .withColumn("rank", F.row_number().over(by_ratio))
    )
    first = F.min(F.when(~F.col("capped"), F.struct("rank", "left", "weights"))).over(Window.partitionBy())
    return (
        rest.withColumn("open", first)
        .withColumn("target", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("open.left") * F.col("weight") / F.col("open.weights")))
        .select("source", "source_size", "weight", "target")
    )


def mix_plan(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """Slots of the mix: (skey, shard, j, block_no). ``sources`` has skey, slots and blocks."""
    tasks = parts(sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0], 200_000)
    everything = Window.partitionBy()
    s = (
        sources.filter("slots > 0").withColumn("all_slots", F.sum("slots").over(everything))
        .withColumn("first", F.sum("slots").over(Window.orderBy("skey")) - F.col("slots"))
        .withColumn("deal", round_keys(F.col("all_slots"), F.lit(seed).cast("long")))
        .withColumn("keys", round_keys(F.col("blocks"), F.xxhash64("skey", F.lit(seed))))
    )
    step = 4096
    runs = s.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / step))).alias("run")).repartition(tasks, "skey", "run")
    place = permuted(F.col("first") + F.col("nth"), F.col("all_slots"), F.col("deal"))
    draws = runs.select("*", F.explode(F.sequence(F.col("run") * step, F.least(F.col("slots"), (F.col("run") + 1) * step) - 1)).alias("nth"))
    counts = draws.select("skey", F.floor(place / shard_slots).alias("shard")).groupBy("skey", "shard").agg(F.count("*").alias("n"))
    dealt = counts.withColumn("start", F.sum("n").over(Window.partitionBy("skey").orderBy("shard")) - F.col("n"))
    dealt = dealt.join(s.select("skey", "blocks", "keys"), "skey")
    slots = dealt.repartition(tasks, "skey", "shard").select("skey", "blocks", "keys", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("j"))
    return slots.withColumn("block_no", permuted(F.pmod("j", "blocks"), F.col("blocks"), F.col("keys")))


def mix_documents(docs: DataFrame, block: int = 64, shard_slots: int = 16_384, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words of it in the mix)."""
    source = F.col(source_col)
    base = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            source.alias("source"),
            F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("skey"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "words",
    )
    n = base.count()
    targets = source_targets(base.groupBy("source", "skey").agg(F.sum("size").alias("source_size")).drop("skey"))
    targets = targets.withColumn("skey", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")))
    # shorter blocks for small sources: a target is met to half a block
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / FINE))).cast("long"))
    targets = keep(
        targets.withColumn("slots", F.round(F.col("target") / F.col("block")).cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long")),
        "targets",
    )
    times = mix_plan(targets, shard_slots, seed).groupBy("skey", "block_no").agg(F.count("*").alias("times"))
    # where each document starts in its source's stream: summed within buckets, shifted by the buckets before
    bucketed = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts(n, 2_500))).cast("int"))
    starts = bucketed.groupBy("skey", "bucket").agg(F.sum("size").alias("b"))
    starts = starts.withColumn("start", F.sum("b").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("b")).drop("b")
    order = Window.partitionBy("skey", "bucket").orderBy("doc_id", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        bucketed.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("nth", F.row_number().over(order))
        .join(starts, ["skey", "bucket"]).withColumn("at", F.col("start") + F.col("before"))
        .join(targets.select("skey", "source_size", "target", "block"), "skey")
        .select("doc_id", "skey", "bucket", "nth", "size", "source_size", "target", "block", "at")
    )
    width = F.col("block")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.col("size") - 1) / width)))
    pieces = placed.select("*", F.explode_outer(blocks).alias("block_no"))
    overlap = F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * width) - F.greatest("at", F.col("block_no") * width)
    # the plan of the mix starts from one row a source, so its size is guessed far too small: it must not be broadcast
    return (
        pieces.join(times.hint("merge"), ["skey", "block_no"], "left")
        .groupBy("skey", "bucket", "nth", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.coalesce(overlap * F.col("times"), F.lit(0))).cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, with all their columns: each as often as the mix takes it on average.

    ``taken / size`` is rounded up or down by a pseudorandom draw, so the expected words of a source stay those of the
    mix; documents drawn 0 times, and those without words, are not in it. No document comes more than CAP times. Rows are
    told apart by id (which may be null), text and source; rows equal in all three share their mean.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text"), F.xxhash64("source"))
    row, copies_, copy = (unused(docs, x) for x in ("row", "copies", "copy"))
    rows = docs.withColumn(row, key)
    taken = mix_documents(rows, id_col=row, **how).withColumnRenamed("doc_id", row)
    draw = F.pmod(F.xxhash64(row, F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(F.sum("taken") / F.sum("size") + F.first(draw)).cast("int")
    copies = taken.filter("size > 0").groupBy(row).agg(F.least(F.lit(CAP), times).alias(copies_)).filter(F.col(copies_) > 0)
    return rows.join(copies, row).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(copies_))).alias(copy)).drop(copy)
