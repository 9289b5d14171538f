"""Operator 7: threshold-scaled fingerprints of documents, with DataFrame functions only.

A fingerprint keeps the hash of every five-word shingle that falls below a fixed fraction of the hash range, so the
sketches of parts can be merged by union and sketches of very unequal documents estimate containment: what is kept
depends on the shingle alone, not on the document's length. Words are runs of anything but white space, A-Z
lower-cased; a text of fewer than five words is one shingle.

The rule is the same for texts of every length. The error of a likeness falls with the root of the number of hashes
kept, so the fraction is a half: the mean error against the exact likeness of the edited texts is about 0.02, and a text of
few shingles may keep none. The fingerprint therefore also tells the number of different shingles, which parts a text
without words from one of which nothing is kept; no estimate uses it otherwise.

The query also fingerprints an edited text that borrows from the next document in descending id. Neighbours meet by a
window over ranges of ids, cut at quantiles; each range also receives the first document of the range below, so no task
holds more than its range.

A null text is empty; texts without words have an empty fingerprint, likeness 1 to each other and 0 to all others; two
texts with words of which nothing is kept have likeness 0; very long texts are read whole; rows of one id follow each other in the order of a hash of their texts, and rows without id come
last in that order; a single document is its own next one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, keep, parts

SHINGLE = 5
FRACTION = 0.5
QUANTILES = 256


def bound(value: Column, body) -> Column:
    """``body(value)`` for an array-valued body, with ``value`` computed once."""
    return F.flatten(F.transform(F.array(value), body))


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of all shingles, with repeats."""
    words = F.filter(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(h) - k + 1), lambda i: F.xxhash64(*(F.element_at(h, i + j) for j in range(k))))
        whole = F.array(F.xxhash64(h, F.size(h)))
        return F.when(F.size(h) >= k, runs).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def _low(hashes: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(hashes, lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))))


def _below(h: Column, fraction: float) -> Column:
    return F.shiftrightunsigned(h, 32) < int(fraction * (1 << 32))


def sketch(text: Column, k: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted distinct kept hashes (their lower 32 bits)."""
    return _low(F.filter(shingle_hashes(text, k), lambda h: _below(h, fraction)))


def fingerprint(text: Column, k: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Struct (kept, n): the sketch, and the number of the text's different shingles."""

    def told(hashes: Column) -> Column:
        return F.struct(_low(F.filter(hashes, lambda h: _below(h, fraction))).alias("kept"), F.size(hashes).alias("n"))

    return F.element_at(F.transform(F.array(F.array_distinct(shingle_hashes(text, k))), told), 1)


def likeness(a: Column, b: Column) -> Column:
    """Share of common shingles in all shingles of both fingerprints, estimated from the kept ones, 0 to 1."""
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    either = F.size(a["kept"]) + F.size(b["kept"]) - both
    return F.when(either > 0, both / either).when((a["n"] == 0) & (b["n"] == 0), 1.0).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds, of two sketches; null where a's is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: DataFrame, key: str, col: str) -> DataFrame:
    """Sketch of the union of documents by ``key``: their sketches' union."""
    return sketches.select(key, F.explode(col).alias("h")).distinct().groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(col))


def spelled(print_: Column) -> Column:
    """``n:hash,hash,...``; empty for a text without words."""
    return F.when(print_["n"] > 0, F.concat(print_["n"].cast("string"), F.lit(":"), F.array_join(print_["kept"].cast("array<string>"), ","))).otherwise("")


def zones(docs: DataFrame, per_range: int) -> Column:
    """Number of the range of a row, rising with ``doc_id``, below 0 without one; each range holds about ``per_range`` rows.

    Ids are cut at up to ``QUANTILES`` quantiles and between two of them into ranges of equal width. Rows without id are
    ordered by the hash of their text.
    """
    n, nulls = docs.agg(F.count("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    cuts = min(QUANTILES, parts(n, per_range, 1))
    share = F.array(*(F.lit(i / cuts) for i in range(cuts + 1)))
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", share, 10_000)).first()[0] or [0, 0]))
    bounds = bounds if len(bounds) > 1 else [bounds[0], bounds[0] + 1]
    fine = parts(n, per_range * (len(bounds) - 1), 1)
    doc_id = F.col("doc_id")

    def pick(lo: int, hi: int) -> Column:
        """Search for the last bound at or below the id, as nested conditions."""
        if hi - lo == 1:
            within = F.floor((doc_id - bounds[lo]) * F.lit(float(fine)) / float(bounds[hi] - bounds[lo]))
            return F.lit(lo * fine).cast("long") + F.least(F.greatest(within, F.lit(0)), F.lit(fine - 1))
        mid = (lo + hi) // 2
        return F.when(doc_id < bounds[mid], pick(lo, mid)).otherwise(pick(mid, hi))

    buckets = parts(nulls, per_range, 1)
    without = F.least(F.floor((F.xxhash64("text") / float(1 << 64) + 0.5) * buckets), F.lit(buckets - 1)) - buckets
    return F.when(doc_id.isNull(), without).otherwise(pick(0, len(bounds) - 1)).cast("long")


def fingerprint_documents(docs: DataFrame, per_range: int = 4_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("zone", zones(base, per_range))
    # the first row of each range also goes to the range above it; that of the topmost to the lowest
    rank = F.struct(F.coalesce("doc_id", F.lit(0)).cast("long").alias("a"), F.xxhash64("text").alias("b"))
    firsts = base.groupBy("zone").agg(F.max(rank).alias("first"))
    up = Window.orderBy("zone")
    firsts = keep(firsts.select("zone", "first", F.coalesce(F.lead("zone").over(up), F.min("zone").over(Window.partitionBy())).alias("also")), "firsts")
    dealt = base.withColumn("rank", rank).join(firsts, "zone").withColumn("print", fingerprint(F.col("text")))
    own = F.struct("zone", F.lit(0).alias("guest"))
    guest = F.struct(F.col("also").alias("zone"), F.lit(1).alias("guest"))
    at = F.explode(F.when(F.col("rank") == F.col("first"), F.array(own, guest)).otherwise(F.array(own)))
    dealt = dealt.select("doc_id", "text", "print", "rank", at.alias("at")).select("doc_id", "text", "print", "rank", "at.*")
    order = Window.partitionBy("zone").orderBy("guest", F.desc("rank"))
    chars, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    paired = dealt.withColumn("next", F.coalesce(F.lead("text").over(order), "text")).withColumn("next_print", F.coalesce(F.lead("print").over(order), "print")).filter("guest = 0")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next", F.lit(1), half))
    out = paired.select("doc_id", chars.cast("long").alias("n_chars"), edited.alias("edited"), "print", "next_print").withColumn("edited_print", fingerprint(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled(F.col("print")).alias("fingerprint"), spelled(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
