"""Operator 4: benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

A-Z is lower-cased and words are runs of ``ALNUM_WORD``; a window is 13 consecutive words of an item, or a shorter
item as a whole. Text and windows are normalised to words between single spaces, so a match of `` w1 ... w13 ``
is a match of whole words. A text is scanned once, whole; matches are mapped back to word positions and, for the
spans, to offsets in the original text.

Spark makes the windows distinct. An automaton takes about 46 bytes a character of its windows in every Python worker, so it
holds at most ``AUTOMATON_CHARS`` of them. A larger benchmark is scanned in as many passes over the texts as it takes, one
automaton after the other: driver and workers hold one list at a time, passes leave the places of their hits only, and these
meet by row before the verdict. So benchmarks of any size are scanned whole, with the same result.

Null and empty texts have no words; very long texts are scanned whole; null and empty items have no window, nor have items
without id; an id with several rows is one item; repeated documents are judged as often as they occur; empty tables give
empty or clean results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from typing import NamedTuple

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, judged, keep, unused

WINDOW = 13
AUTOMATON_CHARS = 8_000_000

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEEP or 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], length: int = WINDOW) -> list[str]:
    """Windows as text between spaces, one character a byte."""
    n = max(1, len(words) - length + 1) if words else 0
    return [f" {b' '.join(words[i : i + length]).decode('latin-1')} " for i in range(n)]


def automata(windows: Iterable[tuple[str, list[str]]]) -> Iterator[list[tuple[str, list[str]]]]:
    """Windows and their items in lists of bounded total length."""
    part, chars = [], 0
    for w, items in windows:
        if part and chars + len(w) > AUTOMATON_CHARS:
            yield part
            part, chars = [], 0
        part.append((w, items))
        chars += len(w)
    if part:
        yield part


class Windows(NamedTuple):
    """One broadcast list of windows: ``key`` is the scan and the list's number in it."""

    key: tuple[str, int]
    sent: Broadcast


_built: dict[tuple[str, int], object] = {}


def _automaton(windows: Windows):
    """Built once in each Python worker for a list of windows; a worker outlives passes and drops what earlier ones built."""
    if windows.key not in _built:
        import ahocorasick

        _built.clear()
        a = ahocorasick.Automaton()
        for w, items in windows.sent.value:
            a.add_word(w, (len(w), w.count(" ") - 1, items))
        a.make_automaton()
        _built[windows.key] = a
    return _built[windows.key]


def word_hits(text: str | None, automaton) -> tuple[int, list[tuple[int, int, list[str]]]]:
    """Number of words, and (first word, words, items) of each window that occurs."""
    words = normalised_words(text)
    if not words:
        return 0, []
    line = f" {b' '.join(words).decode('latin-1')} "
    found, at, seen = [], 0, 0
    for end, (chars, n, items) in automaton.iter(line):
        start = end - chars + 1  # this window's leading space
        seen += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
        at = start
        found.append((seen, n, items))
    return len(words), found


def windows_in(benchmark: DataFrame) -> DataFrame:
    """window, items (distinct ids as text): the distinct windows of all items."""

    def setup():
        return lambda texts: ([windows_of(normalised_words(t)) for t in texts],)

    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    windows = judged(items, ["item"], "windows array<string>", setup)
    return windows.select("item", F.explode("windows").alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def verdict(text: str | None, n_words: int, found: list[tuple[int, int, list[str]]], spans: bool) -> dict:
    """The struct of ``scan`` for a text and the windows found in it, in any order."""
    items, ranges = set(), []
    for first, length, ids in sorted(found, key=lambda x: x[:2]):
        items.update(ids)
        if ranges and first <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], first + length)
        else:
            ranges.append([first, first + length])
    out = []
    if spans and ranges:
        at = [(m.start(), m.end()) for m in _ORIGINAL_WORD.finditer(text)]
        out = [{"start": at[a][0], "stop": at[b - 1][1]} for a, b in ranges]
    return {"n_words": n_words, "n_hit": sum(b - a for a, b in ranges), "items": sorted(items), "spans": out}


_PLACES = "array<struct<first: bigint, length: bigint, items: array<string>>>"


def places_in(texts: DataFrame, row: str, lists: Iterable[list[tuple[str, list[str]]]]) -> DataFrame:
    """``row`` and ``places``, the windows of all lists found in its text, for rows with any: one pass over the texts a list."""
    spark, scan_id, out = texts.sparkSession, uuid.uuid4().hex, None
    for i, windows in enumerate(lists):
        sent = Windows((scan_id, i), spark.sparkContext.broadcast(windows))

        def places(text: str | None, sent: Windows) -> list[dict]:
            return [{"first": a, "length": n, "items": ids} for a, n, ids in word_hits(text, _automaton(sent))[1]]

        found = judged(texts, [row], f"places {_PLACES}", lambda sent=sent: lambda texts: ([places(t, sent) for t in texts],))
        found = keep(found.filter("size(places) > 0"), "places")
        sent.sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out.groupBy(row).agg(F.flatten(F.collect_list("places")).alias("places"))


def scan(docs: DataFrame, benchmark: DataFrame, keep_cols: list[str], spans: bool = False) -> tuple[DataFrame, str]:
    """``keep_cols`` of each document and a struct (n_words, n_hit, items, spans); its name is returned too."""
    spark, name = docs.sparkSession, unused(docs, "scan")
    made = f"{name} struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: bigint, stop: bigint>>>"
    found = keep(windows_in(benchmark), "windows")
    lists = automata((r["window"], r["items"]) for r in found.toLocalIterator())
    first = [*islice(lists, 2)]
    if len(first) < 2:
        drop(found)
        sent = [Windows((uuid.uuid4().hex, 0), spark.sparkContext.broadcast(x)) for x in first]

        def judge(text: str | None) -> dict:
            n, hits = word_hits(text, _automaton(sent[0])) if sent else (len(normalised_words(text)), [])
            return verdict(text, n, hits, spans)

        return judged(docs, keep_cols, made, lambda: lambda texts: ([judge(t) for t in texts],)), name
    row, both = unused(docs, "row"), unused(docs, "both")
    texts = keep(docs.withColumn(row, F.monotonically_increasing_id()), "texts")
    places = places_in(texts, row, chain(first, lists))
    drop(found)
    met = texts.join(places.withColumnRenamed(row, f"{row}of").withColumnRenamed("places", f"{row}places"), F.col(row) == F.col(f"{row}of"), "left")
    met = met.withColumn(both, F.struct(F.col("text").alias("text"), F.col(f"{row}places").alias("places")))
    last = lambda x: verdict(x["text"], len(normalised_words(x["text"])), [(p["first"], p["length"], p["items"]) for p in x["places"] or ()], spans)
    return judged(met, keep_cols, made, lambda: lambda rows: ([last(x) for x in rows],), both), name


def contaminated(scan_: str) -> Column:
    return F.expr(f"{scan_}.n_hit > 0 AND 20 * {scan_}.n_hit >= {scan_}.n_words")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Merged hit ranges as code-point offsets into the original text: doc_id, start, stop."""
    hits, x = scan(docs, benchmark, ["doc_id"], spans=True)
    return hits.select("doc_id", F.explode(f"{x}.spans").alias("s")).select("doc_id", "s.start", "s.stop")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verdict for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits, x = scan(docs, benchmark, ["doc_id"])
    return hits.select(
        "doc_id", f"{x}.n_words", f"{x}.n_hit", F.size(f"{x}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{x}.items", ","), 256).alias("items_sha256"), contaminated(x).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose share of hit words stays under one in twenty, with all their columns."""
    hits, x = scan(docs, benchmark, docs.columns)
    return hits.filter(~contaminated(x)).select(*docs.columns)


#: The same verdicts as DuckDB SQL.
ORACLE = r"""
WITH bw AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM wins),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
pos AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens)),
hits AS (SELECT p.doc_id, p.i, p.m, x.item_id FROM pos p JOIN wins x ON p.win = x.win AND p.m = x.m),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, (coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w)) AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
