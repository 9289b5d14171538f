"""Operator 6: line deduplication over the whole corpus by deletion neighbourhoods, with DataFrame functions only.

A line is its sequence of words (runs of anything but white space); lines without words always stay. Of equal lines the
earliest stays: the order is that of ids (null first), then of a hash of id and text, then of line numbers. A line also
goes if an earlier distinct line lies within the edit bound: one word inserted, deleted or replaced in lines of at least
``min_words`` words each, which is a similarity of at least 1 - 1 / min_words. ``min_words`` is the method's parameter; with
1 every two lines of one word are neighbours.

Distinct lines emit their deletion variants as hashed keys: the exclusive or of the hashes of (word, position), taken from
running values, so a line costs its length and not its square. Lines of equal length that agree after the deletion of the
same position differ in that word alone; a line that equals another's variant lacks one of its words. Each key needs its
earliest line only, as all lines under a key are neighbours; every pair found so is verified word by word. No group is
expanded into pairs.

Only lines that can have a neighbour emit variants: two lines one edit apart share their first or their last half, so a
count of hashed halves (two or four keys a line) rules out the rest exactly.

Kept lines are the first occurrences of the distinct lines that stay, so occurrences never meet again on a common line.

A null text has no lines; rows equal in id and text are one document and keep the same lines; rows that share only the id
are documents of their own; very long texts and lines cost their length; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, keep

MIN_WORDS = 8
BROADCAST_LINES = 200_000
LINE = ["h1", "h2"]


def one_space(text: Column) -> Column:
    """Runs of blanks as single spaces; texts without odd blanks, nearly all, are only searched."""
    odd = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in ("  ", "\t", "\x0b", "\f", "\r")))
    return F.when(odd, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text)


def documents_of(docs: DataFrame) -> DataFrame:
    """doc_id, rid (hash of id and text, to tell rows of one id apart), text."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")


def half_keys(line: Column, n: Column) -> Column:
    """Hashes of first and last halves, for both ways to halve; lines one edit apart share one."""

    def ends(h: Column) -> list[Column]:
        part = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
        return [F.xxhash64(F.lit(1), h, part(h)), F.xxhash64(F.lit(2), h, part(-h))]

    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.array(*ends(low))).otherwise(F.array(*ends(low), *ends(high)))


def distinct_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """h1, h2 (the line), first (doc_id, rid, line_no), halves (null for lines that can have no neighbour)."""
    texts = documents_of(docs).withColumn("text", one_space(F.col("text")))
    lines = texts.select("doc_id", "rid", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line <> ''")
    n = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1).cast("int")
    lines = lines.withColumn("n", n).select(
        "doc_id", "rid", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"),
        F.when(F.col("n") >= min_words, half_keys(F.col("line"), F.col("n"))).alias("halves"),
    )
    return lines.groupBy(*LINE).agg(F.min(F.struct("doc_id", "rid", "line_no")).alias("first"), F.first("halves").alias("halves"))


def candidate_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2, first, line (words between single spaces) of the lines that share a half with another."""
    halves = distinct.filter("halves is not null").select(*LINE, F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("half")
    near = halves.join(shared, "half", "left_semi").select(*LINE).distinct().join(distinct.drop("halves"), LINE)
    wanted = keep(near.groupBy("first.doc_id", "first.rid").agg(F.collect_list(F.struct(*LINE, "first")).alias("wanted")), "wanted")
    texts, small = documents_of(docs), (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_LINES
    found = texts.join((F.broadcast(wanted) if small else wanted).withColumnRenamed("doc_id", "of").withColumnRenamed("rid", "at"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("rid") == F.col("at")))
    found = found.withColumn("lines", F.split("text", "\n")).select(F.explode(F.transform("wanted", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["first"].alias("first"), F.get("lines", x["first"]["line_no"]).alias("line")))).alias("x"))
    out = keep(found.select("x.*").withColumn("line", F.trim(one_space(F.col("line")))).dropDuplicates(LINE), "candidates")
    drop(wanted)
    return out


def whole_key(words: Column) -> Column:
    return F.aggregate(F.transform(words, lambda w, i: F.xxhash64(w, i)), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def variants(lines: DataFrame) -> DataFrame:
    """h1, h2, n, pos, key: one row for each word of each line, the key is that of the line without this word."""
    words = lines.select(*LINE, F.posexplode(F.split("line", " ")).alias("pos", "word"))
    words = words.select(*LINE, "pos", F.xxhash64("word", "pos").alias("here"), F.xxhash64("word", F.col("pos") - 1).alias("moved"))
    line = Window.partitionBy(*LINE)
    upto = line.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = F.bit_xor("here").over(upto).bitwiseXOR(F.col("here"))
    after = F.bit_xor("moved").over(line).bitwiseXOR(F.bit_xor("moved").over(upto))
    return words.select(*LINE, F.count("*").over(line).cast("int").alias("n"), "pos", before.bitwiseXOR(after).alias("key"))


def verified(a: Column, b: Column) -> Column:
    """Whether two word sequences are at most one edit apart: common start and end leave one word at most."""

    def common(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        differs = F.array_position(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda u, v: u == v), F.lit(False))
        return F.when(differs > 0, differs - 1).otherwise(n)

    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1


def near_lines(lines: DataFrame) -> DataFrame:
    """h1, h2, first of the candidate lines that have an earlier neighbour."""
    deleted = keep(variants(lines), "variants")
    order = lines.select(*LINE, "first")
    # one word replaced: same length, same key after the deletion of the same position
    spot = ["key", "n", "pos"]
    shared = deleted.groupBy(*spot).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select(*spot)
    members = keep(deleted.join(shared, spot).join(order, LINE), "members")
    earliest = members.groupBy(*spot).agg(F.min(F.struct("first", *LINE)).alias("e"))
    replaced = members.join(earliest, spot).filter("e.first < first").select(*LINE, F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"))
    # one word more or less: a line equals a variant of a longer one
    words = F.split("line", " ")
    whole = lines.select(whole_key(words).alias("key"), (F.size(words) + 1).alias("n"), F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("first").alias("whole"))
    met = keep(deleted.join(whole, ["key", "n"]).select(*LINE, "w1", "w2", "whole").distinct().join(order, LINE), "lengthened")
    longer = met.filter("whole < first").select(*LINE, F.col("w1").alias("e1"), F.col("w2").alias("e2"))
    shorter = met.filter("first < whole").groupBy("w1", "w2").agg(F.min(F.struct("first", *LINE)).alias("e"))
    shorter = shorter.select(F.col("w1").alias("h1"), F.col("w2").alias("h2"), F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"))
    pairs = replaced.unionByName(longer).unionByName(shorter).distinct()
    other = lines.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.split("line", " ").alias("others"))
    close = pairs.join(lines.select(*LINE, "first", words.alias("words")), LINE).join(other, ["e1", "e2"])
    close = keep(close.filter(verified(F.col("words"), F.col("others"))).select(*LINE, "first").distinct(), "close")
    drop(deleted, members, met)
    return close


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_kept, n_near (lines that went for an earlier neighbour), text (without the lines that went)."""
    distinct = keep(distinct_lines(docs, min_words), "lines")
    lines = candidate_lines(docs, distinct)
    close = near_lines(lines)
    drop(lines)
    stay = distinct.join(close, LINE, "left_anti").select("first.*").withColumn("near", F.lit(0))
    marks = stay.unionByName(close.select("first.*").withColumn("near", F.lit(1)))
    marks = marks.groupBy(F.col("doc_id").alias("of"), F.col("rid").alias("at")).agg(F.collect_list(F.when(F.col("near") == 0, F.col("line_no"))).alias("stay"), F.sum("near").alias("n_near"))
    out = documents_of(docs).join(marks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("rid") == F.col("at")), "left")
    out = out.withColumn("lines", F.split("text", "\n")).withColumn("stay", F.coalesce("stay", F.array().cast("array<int>")))
    # unless each line has words and stays, lines without words stay beside those marked
    blank = F.filter(F.sequence(F.lit(0), F.array_size("lines") - 1), lambda i: F.btrim(F.get("lines", i), F.lit(" \t\x0b\f\r")) == "")
    out = out.withColumn("left", F.when(F.array_size("stay") < F.array_size("lines"), F.sort_array(F.concat("stay", blank))))
    return out.select(
        "doc_id", F.coalesce(F.array_size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("left"), F.array_size("lines"), F.lit(0)).cast("long").alias("n_kept"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.when(F.array_size("left") < F.array_size("lines"), F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")).otherwise(F.col("text")), F.lit("")).alias("text"),
    )


#: The same result as DuckDB SQL, from all variants of all distinct lines. Ids are unique there.
ORACLE = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(lines))) AS i, unnest(lines) AS line FROM raw),
w AS (SELECT doc_id, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l),
o AS (SELECT doc_id, i, words, row_number() OVER (ORDER BY doc_id, i) AS r FROM w WHERE len(words) > 0),
d AS (SELECT words, min(r) AS r FROM o GROUP BY words),
v AS (SELECT r, words, n, p, list_slice(words, 1, p - 1) || list_slice(words, p + 1, n) AS rest FROM (SELECT r, words, len(words) AS n, unnest(range(1, len(words) + 1)) AS p FROM d WHERE len(words) >= 8)),
sub AS (SELECT r, min(r) OVER (PARTITION BY rest, n, p) AS e FROM v),
del AS (SELECT v.r AS longer, d.r AS whole FROM v JOIN d ON v.rest = d.words WHERE len(d.words) >= 8),
near AS (SELECT r FROM sub WHERE e < r UNION SELECT longer FROM del WHERE whole < longer UNION SELECT whole FROM del WHERE longer < whole),
g AS (SELECT o.doc_id, o.i, o.r = d.r AND o.r IN (SELECT r FROM near) AS near, o.r <> d.r AS copy FROM o JOIN d ON o.words = d.words),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (NOT coalesce(near OR copy, false)) AS n_kept, count(*) FILTER (coalesce(near, false)) AS n_near,
  string_agg(line, chr(10) ORDER BY l.i) FILTER (NOT coalesce(near OR copy, false)) AS text FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_kept, 0)::BIGINT AS n_kept, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(k.text, '') AS text
FROM documents LEFT JOIN k USING (doc_id)
"""
