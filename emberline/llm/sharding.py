"""Operator 1: best-fit-decreasing packing of indivisible groups into shards.

Equal texts form a group; a group stays in one shard. The packing runs on two levels, so no task and no
driver ever holds all groups:

1. groups smaller than 1/``fine`` of a shard's capacity are dealt over many tasks; each task packs its own,
   largest first, into packs of that size, always taking the tightest pack that still has room;
2. the packs and the larger groups, at most about ``2 * fine`` per shard plus one open pack per task (a task for
   ``per_task`` groups), are packed the same way into the shards on the driver: 16 bytes each, of which ``ITEMS`` are the
   most; beyond it ``per_task`` must grow.

A group that is larger than a shard cannot be packed whole; its rows are dealt by id into pieces of about an
eighth of a shard, and the pieces are packed.

Nulls and odd input: a null text counts no bytes and all null texts form a group; repeated rows are packed as
often as they occur; a very long text is a group like any other; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, parts

ROW_OVERHEAD = 8
ITEMS = 5_000_000


class RemainingTree:
    """Open bins ordered by remaining capacity: a two-level balanced tree of sorted leaves, split when full."""

    LEAF = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, remaining: int, bin_no: int) -> None:
        x = (remaining, bin_no)
        if not self.leaves:
            self.leaves, self.tops = [[x]], [x]
            return
        i = min(bisect_left(self.tops, x), len(self.leaves) - 1)
        leaf = self.leaves[i]
        insort(leaf, x)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[i : i + 1] = [leaf[:half], leaf[half:]]
            self.tops[i : i + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.tops[i] = leaf[-1]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that holds ``size``."""
        i = bisect_left(self.tops, (size, -1))
        if i == len(self.leaves):
            return None
        leaf = self.leaves[i]
        x = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[i] = leaf[-1]
        else:
            del self.leaves[i], self.tops[i]
        return x


def best_fit_decreasing(sizes: np.ndarray, capacity: int, n_bins: int | None = None) -> np.ndarray | None:
    """Bin of each size; sizes must come largest first. With ``n_bins``, None if they do not fit into so many."""
    tree, out, opened = RemainingTree(), np.empty(len(sizes), np.int64), 0
    least = int(sizes[-1]) if len(sizes) else 0
    for i, size in enumerate(sizes.tolist()):
        got = tree.take_tightest(size)
        if got is None:
            if opened == n_bins or (n_bins is not None and size > capacity):
                return None
            got, opened = (max(capacity, size), opened), opened + 1
        out[i] = got[1]
        if got[0] - size >= max(least, 1):
            tree.add(got[0] - size, got[1])
    return out


def fit_into(sizes: np.ndarray, n_bins: int) -> np.ndarray:
    """Bins for sizes (largest first) at the smallest tried capacity at which all fit into ``n_bins`` bins."""
    if not len(sizes):
        return np.empty(0, np.int64)
    even = max(-(-int(sizes.sum()) // n_bins), int(sizes[0]), 1)
    slack = 0
    while (bins := best_fit_decreasing(sizes, even + slack, n_bins)) is None:
        slack = max(even // 8192, slack + max(1, slack // 4))
    return bins


def pack(units: DataFrame, n_shards: int | None = None, capacity: int | None = None, fine: int = 256, per_task: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Pack ``units(unit long, bytes long)`` into ``n_shards`` shards of near-equal bytes, or into as few of ``capacity`` as it gets.

    Returns two tables (unit, shard): the bounded one of large units and that of all others.
    """
    spark = units.sparkSession
    total, n = units.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    room = capacity or max(1, -(-total // n_shards))
    small_room = max(1, room // fine)

    def pack_task(batches):
        from pyspark import TaskContext

        rows = [b for b in batches if len(b)]
        if rows:
            pdf = pd.concat(rows).sort_values(["bytes", "unit"], ascending=[False, True])
            bins = best_fit_decreasing(pdf["bytes"].to_numpy(), small_room)
            yield pd.DataFrame({"unit": pdf["unit"].to_numpy(), "bytes": pdf["bytes"].to_numpy(), "pack": bins + (TaskContext.get().partitionId() << 32)})

    packed = keep(
        units.filter(F.col("bytes") < small_room).repartition(parts(n, per_task), "unit").mapInPandas(pack_task, "unit long, bytes long, pack long"),
        "packs",
    )
    # bounded: 2 * fine packs a shard, an open one a task, and fine large units a shard
    items = keep(
        packed.groupBy("pack").agg(F.sum("bytes").alias("bytes")).select(F.lit(0).alias("large"), F.col("pack").alias("item"), "bytes")
        .unionByName(units.filter(F.col("bytes") >= small_room).select(F.lit(1).alias("large"), F.col("unit").alias("item"), "bytes")),
        "items",
    )
    if (found := items.count()) > ITEMS:
        raise ValueError(f"{found} packs and large groups: raise per_task")
    items = items.toPandas().sort_values(["bytes", "large", "item"], ascending=[False, True, True])
    sizes = items["bytes"].to_numpy(np.int64)
    items["shard"] = fit_into(sizes, n_shards) if capacity is None else best_fit_decreasing(sizes, capacity)
    place = spark.createDataFrame(items[["large", "item", "shard"]].astype({"shard": "int32", "item": "int64"}), "large int, item long, shard int")
    small = packed.join(F.broadcast(place.filter("large = 0").select(F.col("item").alias("pack"), "shard")), "pack").select("unit", "shard")
    return place.filter("large = 1").select(F.col("item").alias("unit"), "shard"), small


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard."""
    text = F.col(text_col)
    base = keep(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("grp"),
        ),
        "sizes",
    )
    total, n = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    room = max(1, -(-total // n_shards))
    # fewer than n_shards groups can be larger than an even share of all bytes
    hot = {r["grp"]: -(-8 * r["b"] // room) for r in base.groupBy("grp").agg(F.sum("size").alias("b")).filter(F.col("b") > room).collect()}
    piece = F.lit(0).cast("long")
    for grp, pieces in hot.items():
        piece = F.when(F.col("grp") == F.lit(grp), F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(pieces))).otherwise(piece)
    base = base.withColumn("unit", F.xxhash64("grp", piece))
    units = keep(base.groupBy("unit").agg(F.sum("size").alias("bytes")), "units")
    large, small = pack(units, n_shards)
    # all copies of a large unit share one key: their rows meet its shard by a broadcast of the bounded table
    tagged = base.join(F.broadcast(large), "unit", "left")
    placed = keep(
        tagged.filter(F.col("shard").isNotNull())
        .unionByName(tagged.filter(F.col("shard").isNull()).drop("shard").join(small, "unit"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(parts(n, 10_000 * n_shards))).cast("int"))
        .select("doc_id", "size", "text_crc32", "unit", "shard", "bucket"),
        "placed",
    )
    return number(placed, "shard", "bucket", "doc_id", "size", "unit").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def number(df: DataFrame, key: str, bucket: str, *order: str) -> DataFrame:
    """Add ``slot``: 0, 1, 2 ... within each key, counted in its buckets and shifted by the buckets before."""
    starts = (
        df.groupBy(key, bucket).agg(F.count("*").alias("n"))
        .withColumn("start", F.sum("n").over(Window.partitionBy(key).orderBy(bucket)) - F.col("n")).drop("n")
    )
    within = df.withColumn("nth", F.row_number().over(Window.partitionBy(key, bucket).orderBy(*order)) - 1)
    return within.join(starts, [key, bucket]).withColumn("slot", F.col("start") + F.col("nth")).drop("nth", "start")
