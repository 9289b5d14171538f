"""Operator 3: URL filter by rules and by the ratio of two character language models.

Rules (host suffix and path prefix) decide first, the longest rule wins. The URLs they decide train two smoothed
variable-order Markov models, one of accepted and one of rejected URLs: the probability of a character after its last
four is a Witten-Bell mixture of the estimates after 4, 3, 2, 1 and 0 characters. A URL's score is the mean log
ratio over all its characters, scheme, query and fragment included; rules see host and path only. The threshold is calibrated on one fifth of the decided URLs, which the counts leave out: the
score at which the two classes' error rates sum to the least.

All counts are joins and aggregations over every URL; the models are tables, never collected. Each n-gram is counted over
all distinct URLs, and each URL over all rows: n-grams and URLs that more than one in a thousand of the rows share get their
score by broadcast (there are fewer than a thousand of them), the others by a shuffle, so no key of a join is hot.

A null URL, or one without ``://``, has empty host and path, so no rule fits; a null or empty URL scores 0; with one class only the
threshold is 0 and all scores are 0, so the verdict is allow; repeated rows are judged as often as they occur; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, join_counted, keep

#: Rules in force.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 4
ALPHABET = 256
START, END = "\x02", "\x03"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def n_grams(text: Column, order: int) -> Column:
    """One (order + 1)-gram for each character of the text and its end."""
    characters = F.split(F.concat(F.lit(START * order), text, F.lit(END)), "")
    # the array is bound once, so a text costs its length and not its square
    return F.flatten(F.transform(F.array(characters), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - order), lambda i: F.concat(*(F.element_at(c, i + j) for j in range(order + 1))))))


def gram_scores(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n, d) for each (order + 1)-gram of ``texts(text, n_allow, n_block)``: how often it occurs, log ratio of the two models."""
    grams = keep(
        texts.select(F.explode(n_grams(F.col("text"), order)).alias("gram"), "n_allow", "n_block")
        .groupBy("gram").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"), F.count(F.lit(1)).alias("n")),
        "grams",
    )
    p = None
    for k in range(order + 1):
        g = grams.select(F.substring("gram", order + 1 - k, k + 1).alias("g"), "n_allow", "n_block", "n").groupBy("g").agg(*(F.sum(c).alias(c) for c in ("n_allow", "n_block", "n")))
        g = g.withColumn("context", F.substring("g", 1, k)).withColumn("shorter", F.substring("g", 2, k))
        context = g.groupBy("context").agg(*(x.alias(f"{name}_{c}") for c in ("allow", "block") for name, x in (("n", F.sum(f"n_{c}")), ("t", F.count(F.when(F.col(f"n_{c}") > 0, 1))))))
        context = context.select("context", *(F.col(f"{n}_{c}").alias(f"{n}{n}_{c}") for n in "nt" for c in ("allow", "block")))
        g = g.join(context, "context")
        g = g.join(p.drop("times"), "shorter") if p is not None else g.withColumn("q_allow", F.lit(1.0 / ALPHABET)).withColumn("q_block", F.lit(1.0 / ALPHABET))
        for c in ("allow", "block"):
            seen, types = F.col(f"nn_{c}"), F.col(f"tt_{c}")
            g = g.withColumn(f"p_{c}", F.when(seen > 0, (F.col(f"n_{c}") + types * F.col(f"q_{c}")) / (seen + types)).otherwise(F.col(f"q_{c}")))
        p = g.select(F.col("g").alias("shorter"), F.col("n").alias("times"), F.col("p_allow").alias("q_allow"), F.col("p_block").alias("q_block"))
    return p.select(F.col("shorter").alias("gram"), F.col("times").alias("n"), (F.log("q_allow") - F.log("q_block")).alias("d"))


def calibrated(scored: DataFrame) -> DataFrame:
    """One row (threshold): least sum of both error rates over ``scored(score, n_allow, n_block)``, halfway to the score below."""
    steps = scored.withColumn("s", F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "score")) * 100).cast("int")).groupBy("s")
    steps = steps.agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")).filter("a + b > 0")  # 4001 rows at most
    up, whole = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    missed = F.try_divide(F.coalesce(F.sum("a").over(up), F.lit(0)), F.sum("a").over(whole))
    passed = F.try_divide(F.sum("b").over(whole) - F.coalesce(F.sum("b").over(up), F.lit(0)), F.sum("b").over(whole))
    middle = (F.col("s") + F.coalesce(F.lag("s").over(Window.orderBy("s")), F.col("s"))) / 200
    best = steps.select("s", (missed + passed).alias("wrong"), middle.alias("middle")).filter("wrong is not null")  # without either class nothing is left
    return best.agg(F.coalesce(F.min(F.struct("wrong", "s", "middle"))["middle"], F.lit(0.0)).alias("threshold"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    judged = keep(judged.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"), F.coalesce("url", F.lit("")).alias("text")).withColumn("tid", F.md5(F.encode("text", "UTF-8"))), "urls")
    texts = judged.groupBy("tid").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("n_allow"), F.count(F.when(F.col("ruled") == "block", 1)).alias("n_block"))
    held = F.crc32(F.encode("text", "UTF-8")) % 5 == 0
    texts = keep(texts.withColumn("held", held), "texts")
    counted = texts.select("text", *(F.when(F.col("held"), 0).otherwise(F.col(c)).alias(c) for c in ("n_allow", "n_block")))
    model = keep(gram_scores(counted), "model")
    both = counted.agg(((F.sum("n_allow") > 0) & (F.sum("n_block") > 0)).alias("both"))
    pieces = texts.filter("text <> ''").select("tid", F.explode(n_grams(F.col("text"), ORDER)).alias("gram"))
    met = join_counted(pieces, model, "gram", "n", model.agg(F.sum("n")).first()[0] or 0)
    means = met.groupBy("tid").agg(F.avg("d").alias("mean"))
    scored = texts.join(means, "tid", "left").crossJoin(F.broadcast(both)).withColumn("score", F.when(F.col("both"), F.coalesce("mean", F.lit(0.0))).otherwise(0.0))
    scored = keep(scored.select("tid", "score", "held", "n_allow", "n_block", "n_rows"), "scores")
    threshold = calibrated(scored.filter("held"))
    ruled = join_counted(judged.drop("text"), scored.select("tid", "n_rows", "score"), "tid", "n_rows", scored.agg(F.sum("n_rows")).first()[0] or 0)
    ruled = ruled.crossJoin(F.broadcast(threshold))  # one row
    verdict = F.coalesce("ruled", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block"))
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
