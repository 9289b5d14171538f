"""Operator 9: near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

1. One pass over whole texts gives each document's number of distinct shingles, a 128-bit digest of its shingle set and
   its band keys. SuperMinHash draws, per shingle, one rank for each component from a random permutation: in step j
   a shingle offers j + r to one component. A document is done once no later step can lower any component.
2. Documents with equal sets collapse to the smallest id: a large group of copies is one row from here on.
3. Representatives that share a band key are candidates. No task lists all pairs of a bucket: first each
   representative is held against the smallest of its buckets' smallest ids, then against the smallest id of each bucket
   where the two are in different components, and last the rest: a representative outside the component of its bucket's
   smallest id meets members of such buckets outside its own component, not by the bucket but by a shingle of both
   prefixes, rarest first. That misses no pair at the threshold, and texts that share a template below it do not meet.
   Pairs already connected are never made, so a group of thousands of near copies costs about one comparison a member.
   Before that, shingles that no other candidate holds are counted: they bound every intersection. So does the place of
   the shingle two prefixes share, and a parity bitmap of each set: every bit in which two bitmaps differ stands for a
   shingle that only one of the sets has. All bounds are exact; pairs they rule out are not verified.
4. Every candidate is verified on the full shingle sets; links join components by linking to the smaller root and
   jumping over parents until nothing changes.

The number of bands makes the chance to miss a pair at the threshold less than one in a million.

Null and empty texts have no shingles and are linked with nothing; repeated rows are documents with equal sets; of rows
that share an id but not the text, that of the smallest digest is compared; a row without id joins the group of its equal
copies with one, else stands alone; very long texts are hashed whole; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, judged, keep, unused
from .shingles import _BYTE, mix, shingle_sets

ROWS_PER_BAND = 5
BROADCAST_IDS = 2_000_000
BITMAP = 2048
SALTS = 16
_U = np.uint64


def bands_for(threshold: float, rows: int = ROWS_PER_BAND, miss: float = 1e-6) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (a row per set, inf for empty ones) of m components."""
    sig = np.full((len(sets), m), np.inf)
    flat = sig.ravel()
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate([np.empty(0, np.uint64), *sets])
    taken: list[np.ndarray] = []
    for j in range(m):
        bits = mix(h + _U((2 * j + 1) * 0xD1342543DE82EF95 % (1 << 64)))
        r = (bits >> _U(11)).astype(np.float64) * 2.0**-53
        k = j + (mix(bits + _U(j + 1)) % _U(m - j)).astype(np.int16)
        slot = k.copy()
        for t in range(j - 1, -1, -1):  # where the earlier swaps have put what stands at k
            slot[taken[t] == slot] = t
        np.minimum.at(flat, doc * m + slot, r + j)
        going = np.flatnonzero((sig.max(axis=1) > j + 1) & np.isin(np.arange(len(sets)), doc))
        if not len(going):
            break
        more = np.isin(doc, going)
        taken = [x[more] for x in [*taken, k]]
        doc, h = doc[more], h[more]
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    v = mix(sig.view(np.uint64)).reshape(len(sig), -1, rows)
    key = (v * _BYTE[64 : 64 + rows]).sum(axis=2, dtype=np.uint64)
    return mix(key + np.arange(1, v.shape[1] + 1, dtype=np.uint64) * _U(0x2545F4914F6CDD1D)).view(np.int64)


def digest_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell shingle sets apart."""
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + _U(99))).view(np.int64)) if len(s) else 0


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), bands."""

    def setup():
        def sign(texts: list) -> tuple[list, ...]:
            out, sets, size = [], [], 0
            for s in shingle_sets(texts, k):
                sets.append(s)
                size += len(s)
                if size > 100_000:
                    out += described(sets)
                    sets, size = [], 0
            return tuple(map(list, zip(*out, *described(sets)))) if texts else ([], [], [], [])

        return sign

    def described(sets: list[np.ndarray]) -> list[tuple]:
        keys = band_keys(super_minhash(sets, bands * rows), rows) if sets else []
        return [(len(s), *digest_of(s), key if len(s) else key[:0]) for s, key in zip(sets, keys)]

    return judged(docs, ["doc_id"], "n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>", setup)


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Full shingle sets and their parity bitmaps (id, set, bits) of the documents in ``ids(id, e1, e2)``, with these digests."""
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id")

    def setup():
        def collect(texts: list) -> tuple[list, ...]:
            sets = list(shingle_sets(texts, k))
            digests = [digest_of(s) for s in sets]
            return [s.view(np.int64) for s in sets], [parity(s) for s in sets], [d[0] for d in digests], [d[1] for d in digests]

        return collect

    found = judged(wanted, ["id", "e1", "e2"], "set array<bigint>, bits array<bigint>, d1 bigint, d2 bigint", setup)
    return found.filter("d1 = e1 and d2 = e2").select("id", "set", "bits").dropDuplicates(["id"])


def parity(s: np.ndarray) -> np.ndarray:
    """Per bit whether an odd number of the set's hashes falls on it."""
    odd = np.bincount((s % _U(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` with den * intersection >= num * union."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    # sizes too far apart cannot reach the threshold
    x = x.filter((F.size("sa") * den >= F.size("sb") * num) & (F.size("sb") * den >= F.size("sa") * num))
    x = x.withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return x.filter(F.col("i") * den >= (F.size("sa") + F.size("sb") - F.col("i")) * num).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each id in ``edges(a, b)``: id, comp."""
    both = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parent = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "parents")
    while True:
        near = both.join(parent.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        linked = parent.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("up"))
        up = parent.select(F.col("id").alias("up"), F.col("comp").alias("upper"))
        step = keep(linked.join(up, "up").select("id", "old", F.least("up", "upper").alias("comp")), "parents")
        drop(parent)
        parent = step.select("id", "comp")
        if not step.filter("old <> comp").limit(1).count():
            drop(both)
            return parent


def reach(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n, most, bits): size and largest possible intersection of each set that can reach the threshold with any other."""
    alone = sets.select("id", F.explode("set").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("alone"))
    sizes = sets.select("id", F.size("set").alias("n"), "bits").join(alone, "id", "left").select("id", "n", "bits", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
    return sizes.filter(F.col("most") * den >= F.col("n") * num)


def prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n, h, at): the shingles h of each set's prefix that other sets hold too, and their places ``at`` from 1.

    Every set lists its shingles in one order, rarest first, those that no other set holds foremost. Two sets that reach
    the threshold share a shingle of their prefixes, the first n - ceil(num / den * n) + 1 of the list.
    """
    words = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("h"))
    common = words.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    held = words.join(common, "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("held"))
    lone = F.col("n") - F.size("held")
    length = F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1 - F.col("lone")
    first = held.withColumn("lone", lone).withColumn("length", length).filter("length > 0")
    listed = first.select("id", "n", "lone", F.posexplode(F.slice("held", F.lit(1), F.col("length"))).alias("at", "w"))
    return listed.select("id", "n", F.col("w.h").alias("h"), (F.col("at") + F.col("lone") + 1).alias("at"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rows: int = ROWS_PER_BAND) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id = component_id)."""
    docs = docs.select("doc_id", "text")
    bands = bands_for(num / den, rows)
    sigs = keep(signatures(docs, k, bands, rows), "signatures")
    digest = ["n_shingles", "d1", "d2"]
    reps = keep(sigs.filter("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "representatives")
    # one set an id, also where rows share the id; then representatives under each band key, and the smallest of each key that has several
    nodes = reps.filter("rep is not null").groupBy("rep").agg(F.min(F.struct(*digest)).alias("d")).select("rep", "d.*")
    banded = sigs.join(nodes.withColumn("doc_id", F.col("rep")), ["doc_id", *digest]).dropDuplicates(["rep"]).select("rep", "d1", "d2", F.explode("bands").alias("key"))

    def buckets(x: DataFrame) -> DataFrame:
        shared = x.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("top")).filter("centre <> top").select("key", "centre")
        return keep(x.join(shared, "key"), "buckets")

    spread = keep(banded, "bands")
    found = buckets(spread)
    sets = keep(sets_of(docs, found.select(F.col("rep").alias("id"), F.col("d1").alias("e1"), F.col("d2").alias("e2")).distinct(), k), "sets")
    able = keep(reach(sets, num, den), "able")
    members = buckets(found.drop("centre", "d1", "d2").join(able.select(F.col("id").alias("rep"), "n", "most"), "rep"))
    drop(spread, found)
    first = keep(members.filter("rep <> centre").groupBy("rep").agg(F.min("centre").alias("a")).select("a", F.col("rep").alias("b")), "pairs")
    used, checked = [members, sets, able, first], first
    labels = components(keep(verify(checked, sets, num, den), "links"))

    def labelled(x: DataFrame, labels: DataFrame, col: str) -> DataFrame:
        found = labels.select(F.col("id").alias(col), F.col("comp").alias("found"))
        return x.join(found, col, "left").withColumn(f"{col}_comp", F.coalesce("found", col)).drop("found")

    for step in ("centres", "rest"):
        tagged = labelled(labelled(members, labels, "rep"), labels, "centre")
        apart = tagged.filter("rep_comp <> centre_comp")
        if step == "centres":
            pairs = apart.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
        else:
            apart = keep(apart.select("key", "rep").distinct(), "apart")
            inside = members.join(apart.select("key").distinct(), "key", "left_semi").select(F.col("rep").alias("id")).distinct()
            shared = keep(prefixes(sets.join(inside, "id", "left_semi"), num, den), "prefixes")
            used += [apart, shared]
            one = shared.join(apart.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
            one, two = (labelled(x.withColumnRenamed("id", c).withColumnRenamed("n", f"{c}_n").withColumnRenamed("at", f"{c}_at"), labels, c) for x, c in ((one, "x"), (shared, "y")))
            # an intersection i reaches the threshold if (num + den) * i >= num * (n + m); the first shared shingle bounds it
            bound = (1 + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))) * (num + den) >= (F.col("x_n") + F.col("y_n")) * num
            met = one.join(two, "h").filter((F.col("x_comp") != F.col("y_comp")) & bound).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            bits = lambda c: able.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("bits").alias(f"{c}_bits"))
            differ = F.aggregate(F.zip_with("a_bits", "b_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
            total = F.col("a_n") + F.col("b_n")
            pairs = met.join(bits("a"), "a").join(bits("b"), "b").filter((total - differ) * (num + den) >= total * (2 * num)).select("a", "b")
        fresh = keep(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        links = keep(verify(fresh, sets, num, den), "links")
        used += [fresh, links]
        checked = checked.unionByName(fresh)
        if links.limit(1).count():
            labels = components(links.unionByName(labels.filter("id <> comp").select(F.col("comp").alias("a"), F.col("id").alias("b"))))
    drop(*used)
    # only sets with copies are looked up, each under SALTS keys, so the copies of one text spread over as many tasks
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    copied = reps.filter("copies > 1").select(*digest, "rep", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    out = sigs.select("doc_id", *digest, salt.alias("salt")).join(copied, [*digest, "salt"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = labelled(out, labels, "rep")
    found = F.coalesce("rep_comp", "doc_id")
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of each near-duplicate group, with all columns; rows without words all stay.

    Rows are numbered in order of id and text (null ids last) and judged by that number, so null and repeated ids lose
    nothing but copies.
    """
    order, row = (F.col("doc_id").asc_nulls_last(), F.xxhash64("text")), unused(docs, "row")
    rows = keep(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()), "numbered")
    keepers = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), **how).filter("kept").select(F.col("doc_id").alias(row))
    return rows.join(keepers, row, "left_semi").select(*docs.columns)
