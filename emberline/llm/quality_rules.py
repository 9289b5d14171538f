"""Operator 11: quality rules learned as decision lists, with DataFrame functions only.

Every text has its base statistics (words, symbols, repeated lines, repeated three-word windows) and a few shares made of them,
each on a grid of whole numbers. From labelled rows sequential covering learns rules for the rejected class: a rule grows by
the threshold condition with the best information gain on two thirds of the rows that no rule covers yet, is pruned to the
prefix that does best on the other third, and stays if its precision there is high enough; the rows it covers then go. The
list ends as one ordered conditional expression (``verdict``), so it can be read, stored as text and run on any table.

Each growing step is one aggregation: counts a class for each value of each feature, at most the grid's size whatever the
number of labelled rows; thresholds lie half way between two neighbouring values. The driver holds these counts only. All
labelled rows are used, and texts are read once: their statistics are written and serve for learning and judging.

A null text is empty and fails the base rules; texts without words have shares of 0; very long texts are read whole; a row
labelled twice counts twice, rows without label or with labels other than 0 and 1 teach nothing; without labels of both
classes there are no rules and the base decides; ties between conditions go to the first feature in alphabetical order,
lower bounds first, and of these to the lowest threshold; repeated windows are told by 64-bit hashes; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
SCALE = 1000
#: Rules, conditions a rule, and the precision a pruned rule needs on the rows held back for pruning.
RULES, CONDITIONS, PRECISION = 16, 4, 0.9


def count_of(text: Column, letters: str) -> Column:
    """Characters of ``letters`` (a regular expression's set) in a text."""
    return F.length(F.regexp_replace(text, f"[^{letters}]+", "")).cast("long")


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_words(places: Column) -> Column:
    """Words in windows of three that begin at the sorted ``places``: each place brings three words less what the next one has too."""
    own = F.zip_with(F.slice(places, F.lit(2), F.size(places)), places, lambda after, at: F.coalesce(F.least(F.lit(3), after - at), F.lit(3)))
    return F.aggregate(own, F.lit(0), lambda a, g: a + g).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts that only features use."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumns({"lines": lines, "hashes": F.transform("words", lambda w: F.xxhash64(w))})
    window = F.transform(F.sequence(F.lit(0), F.size("hashes") - 3), lambda i: F.xxhash64(*(F.get("hashes", i + j) for j in range(3))))
    out = out.withColumn("windows", F.when(F.size("hashes") >= 3, window).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumns({
        "ordered": F.when(again, ordered), "n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": count_of(F.col("text"), SYMBOLS), "n_lines": F.size("lines").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_upper": count_of(F.col("text"), "A-Z"), "n_marks": count_of(F.col("text"), ".,;:!?"), "n_digits": count_of(F.col("text"), "0-9"),
        "n_distinct": F.size(F.array_distinct("hashes")).cast("long"), "n_lettered": F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long"),
    })
    twin = lambda x, i: (F.get("ordered", i - 1)["h"] == x["h"]) | (F.get("ordered", i + 1)["h"] == x["h"])
    places = F.array_sort(F.transform(F.filter("ordered", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
    out = out.withColumn("places", places)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(repeated_words(F.col("places")), F.lit(0).cast("long")).alias("n_repeat_words"),
        "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct", "n_lettered",
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.expr("1000L"), F.floor(part * SCALE / whole))).otherwise(0).cast("int")


def features() -> dict[str, Column]:
    """Shares in thousandths, and the mean word length in tenths (up to 100 characters), all from 0 to ``SCALE``."""
    c = F.col
    return {
        "digits": _share(c("n_digits"), c("word_chars")), "distinct_words": _share(c("n_distinct"), c("n_words")), "lettered_words": _share(c("n_lettered"), c("n_words")),
        "marks": _share(c("n_marks"), c("word_chars")), "mean_word": _share(c("word_chars"), c("n_words") * 100), "repeated_lines": _share(c("n_dup_lines"), c("n_lines")),
        "repeated_words": _share(c("n_repeat_words"), c("n_words")), "symbols": _share(c("n_symbols"), c("word_chars")), "upper": _share(c("n_upper"), c("word_chars")),
    }


@dataclass(frozen=True)
class Condition:
    """``feature`` at least (``least``) or at most ``value``."""

    feature: str
    least: bool
    value: int

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.least else F.col(self.feature) <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.least else '<='} {self.value}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed([*enumerate(rules, 1)]):
        out = F.when(holds(rule), F.lit(i)).otherwise(out)
    return out


def spelled(rules: list[Rule]) -> list[str]:
    return [" and ".join(map(str, r)) for r in rules]


def best_condition(counts: list[tuple[str, int, int, int]]) -> tuple[Condition | None, int, int]:
    """The condition with the best information gain, and what it covers of the class (p) and of the others (n).

    ``counts``: (feature, value, p, n), one for each value that occurs.
    """
    by: dict[str, list[tuple[int, int, int]]] = {}
    for f, v, p, n in sorted(counts):
        by.setdefault(f, []).append((v, p, n))
    best, gain, cover = None, 0.0, (0, 0)
    for f, values in by.items():
        all_p, all_n = sum(p for _, p, _ in values), sum(n for _, _, n in values)
        if not all_p or not all_n:
            continue
        low_p = low_n = 0
        for (v, p, n), (w, _, _) in zip(values, values[1:]):
            low_p, low_n = low_p + p, low_n + n
            for least, q, m, at in ((True, all_p - low_p, all_n - low_n, (v + w + 1) // 2), (False, low_p, low_n, (v + w - 1) // 2 if w > v + 1 else v)):
                if q:
                    g = q * (log2(q / (q + m)) - log2(all_p / (all_p + all_n)))
                    if g > gain + 1e-9:
                        best, gain, cover = Condition(f, least, at), g, (q, m)
    return best, *cover


def grow(rows: DataFrame, names: list[str], most: int) -> Rule:
    """Conditions added while they help and rows of the other class are covered."""
    rule: Rule = ()
    while len(rule) < most:
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in names))).alias("x")
        table = rows.filter(holds(rule)).select("bad", each).groupBy("x.f", "x.v").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        found, _, others = best_condition([(r["f"], r["v"], r["p"], r["n"]) for r in table.collect()])
        if found is None:
            break
        rule += (found,)
        if not others:
            break
    return rule


def prune(rows: DataFrame, rule: Rule, precision: float) -> Rule:
    """The prefix with the best (p - n) / (p + n), the shortest of equals; none if it covers nothing or too many of the others."""
    sums = []
    for k in range(1, len(rule) + 1):
        here = holds(rule[:k])
        sums += [F.count_if(here & (F.col("bad") == 1)).alias(f"p{k}"), F.count_if(here & (F.col("bad") == 0)).alias(f"n{k}")]
    r = rows.agg(*sums).first()
    scored = [(r[f"p{k}"], r[f"n{k}"], k) for k in range(1, len(rule) + 1)]
    p, n, k = max(scored, key=lambda x: ((x[0] - x[1]) / max(x[0] + x[1], 1), -x[2]))
    return rule[:k] if p and p >= precision * (p + n) else ()


def learned(rows: DataFrame, names: list[str], rules: int = RULES, conditions: int = CONDITIONS, precision: float = PRECISION) -> list[Rule]:
    """Decision list for ``bad`` = 1. ``rows``: bad, held (0 to 2, 0: held back for pruning), and the features."""
    out: list[Rule] = []
    while len(out) < rules:
        left = rows.filter(verdict(out).isNull()) if out else rows
        rule = grow(left.filter("held <> 0"), names, conditions)
        rule = prune(left.filter("held = 0"), rule, precision) if rule else ()
        if not rule:
            break
        out.append(rule)
    return out


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """bad, held and the features of the rows that are labelled 0 or 1."""
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("of"), (1 - F.col("quality")).cast("int").alias("bad"))
    rows = stats.filter(~base_failed()).join(known, F.col("doc_id") == F.col("of"))
    return rows.select("bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("held"), *(c.alias(f) for f, c in features().items()))


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > n * MOST_REPEATED)


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """``quality_rules`` and the list behind it."""
    stats = keep(statistics(docs), "statistics")
    rules = learned(keep(labelled(stats, labels), "labelled"), [*features()])
    out = stats.withColumns(features()).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule"), rules


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule (number of the first rule that holds)."""
    return judged(docs, labels)[0]
