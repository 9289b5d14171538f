"""Operators 1 and 2 against loops over all units, bins, slots and words of small tables."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from emberline.llm import mixing, sharding


def tightest(sizes, capacity, n_bins=None):
    """Best-fit decreasing by trying every bin; None if ``n_bins`` do not hold all."""
    free, out = [], []
    for s in sizes:
        fits = [(f, b) for b, f in enumerate(free) if f >= s]
        if fits:
            b = min(fits)[1]
        elif n_bins is not None and (len(free) == n_bins or s > capacity):
            return None
        else:
            b = len(free)
            free.append(max(capacity, s))
        free[b] -= s
        out.append(b)
    return out


def test_shards_match_a_loop_over_all_bins(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "z" * int(rng.integers(0, 400)) + str(int(rng.integers(0, 300))), "s") for i in range(900)] + [(i, "y" * 6000 + str(i), "s") for i in range(900, 910)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs).collect()}
    units = docs.select(F.xxhash64(F.xxhash64("text"), F.lit(0).cast("long")).alias("unit"), (F.octet_length("text") + 8).cast("long").alias("size"), "doc_id")
    unit_of = {r["doc_id"]: r["unit"] for r in units.collect()}
    size = {r["unit"]: r["b"] for r in units.groupBy("unit").agg(F.sum("size").alias("b")).collect()}
    room = -(-sum(size.values()) // 24)
    small_room = room // 256
    assert max(size.values()) < room and 0 < sum(b < small_room for b in size.values()) < len(size)
    # units of a task: those that a repartition by unit brings together
    small = spark.createDataFrame([(u, b) for u, b in size.items() if b < small_room], "unit long, bytes long").repartition(8, "unit")
    tasks = defaultdict(list)
    for r in small.select("unit", "bytes", F.spark_partition_id().alias("p")).collect():
        tasks[r["p"]].append((-r["bytes"], r["unit"]))
    members = defaultdict(list)
    for p, found in tasks.items():
        found.sort()
        for (_, u), b in zip(found, tightest([-n for n, _ in found], small_room)):
            members[0, b + (p << 32)].append(u)
    for u, b in size.items():
        if b >= small_room:
            members[1, u].append(u)
    items = sorted((-sum(size[u] for u in us), *item) for item, us in members.items())
    sizes = [-n for n, *_ in items]
    even, slack = max(-(-sum(sizes) // 24), sizes[0]), 0
    while (bins := tightest(sizes, even + slack, 24)) is None:
        slack = max(even // 8192, slack + max(1, slack // 4))
    shard = {u: b for (_, *item), b in zip(items, bins) for u in members[tuple(item)]}
    assert got == {i: shard[u] for i, u in unit_of.items()}


def test_taken_matches_a_list_of_slots(spark):
    rng = np.random.default_rng(9)
    source = lambda i: ("big", "big", "big", "mid", "tiny" if i % 30 == 4 else "mid", None)[i % 6]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), source(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seed = 17
    out = {r["doc_id"]: r for r in mixing.mix_documents(docs, shard_slots=50, seed=seed).collect()}
    skey = {s: "n" if s is None else f"s{s}" for _, _, s in rows}
    # the stream of each source: documents by bucket and id
    bucket = {r["doc_id"]: r["b"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(8)).alias("b")).collect()}
    streams = defaultdict(list)
    for i, t, s in sorted(rows, key=lambda r: (bucket[r[0]], r[0])):
        streams[s] += [i] * len(t.split())
    want = Counter()
    for s, stream in streams.items():
        target = next(out[i]["target"] for i, _, x in rows if x == s)
        width = max(1, min(64, int(target // mixing.FINE)))
        slots, blocks = int(target / width + 0.5), -(-len(stream) // width)
        keys = mixing.round_keys(F.lit(blocks).cast("long"), F.xxhash64(F.lit(skey[s]), F.lit(seed)))
        place = [r[0] for r in spark.range(blocks).orderBy("id").select(mixing.permuted(F.col("id"), F.lit(blocks).cast("long"), keys)).collect()]
        assert sorted(place) == list(range(blocks))
        for j in range(slots):  # every slot takes one block, and each word of it once
            b = place[j % blocks]
            want.update(stream[b * width : (b + 1) * width])
    assert {i: r["taken"] for i, r in out.items()} == {i: want[i] for i, _, _ in rows}


def test_slots_of_a_shard_come_from_one_permutation_of_all(spark):
    sources = spark.createDataFrame([("n", 70, 9), ("sa", 500, 200), ("sb", 1, 1), ("sc", 0, 0)], "skey string, slots long, blocks long")
    got = Counter((r["skey"], r["shard"]) for r in mixing.mix_plan(sources, 64, 17).collect())
    keys = mixing.round_keys(F.lit(571).cast("long"), F.lit(17).cast("long"))
    place = [r[0] for r in spark.range(571).orderBy("id").select(mixing.permuted(F.col("id"), F.lit(571).cast("long"), keys)).collect()]
    owner = ["n"] * 70 + ["sa"] * 500 + ["sb"]
    assert got == Counter((s, p // 64) for s, p in zip(owner, place))


def test_join_counted_splits_hot_keys_without_losing_rows(spark):
    from emberline.llm.common import join_counted

    rows = spark.createDataFrame([("hot", i) for i in range(60)] + [(f"k{i % 20}", i) for i in range(40)] + [(None, 1), ("unknown", 2)], "key string, v int")
    lookup = rows.filter("key is not null and key <> 'unknown'").groupBy("key").agg(F.count("*").alias("n")).withColumn("d", F.length("key"))
    for hot in (2, 10, 1000):
        out = join_counted(rows, lookup, "key", "n", 100, hot)
        assert out.columns == ["key", "v", "d"] and Counter((r["key"], r["v"], r["d"]) for r in out.collect()) == Counter((k, v, len(k)) for k, v in [("hot", i) for i in range(60)] + [(f"k{i % 20}", i) for i in range(40)])
    assert join_counted(rows.limit(0), lookup.limit(0), "key", "n", 0).count() == 0


def test_slot_counts_of_blocks_are_not_broadcast(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('w ', 40) as text", "concat('s', id % 3) as source")
    plan = mixing.mix_documents(docs, block=8)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "block_no" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_slot_counts_are_not_broadcast_in_the_pipeline(spark):
    import corpus_pipeline

    docs = spark.range(300).selectExpr("id as doc_id", "repeat('w ', 40) as text", "'en' as lang", "concat('s', id % 3) as source", "80L as n_chars")
    plan = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "block_no" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
