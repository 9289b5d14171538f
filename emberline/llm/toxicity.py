"""Operator 5: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

1. Labelled rows outside the held-out fold (crc32 of the id as text, mod 5 = 0) are joined with their texts. The fit
   uses about ``SAMPLE`` of them, chosen by a hash of the id: a documented bound, not one on what is scored.
2. Each n-gram (4 to 6 characters of the lower-cased text, as a 32-bit hash) is counted per class by the documents
   that hold it; Spark sums the counts and ranks the n-grams by the log-count ratio times the root of its support. The
   best ``FEATURES`` are kept.
3. Logistic regression with an L2 penalty is fitted on presence times ratio (a few thousand sparse rows) by Newton
   steps; label 1 weighs up to ``POSITIVE`` times as much, as it is rare.
4. Every whole text is scored: presence of each feature times its weight, squashed to 0..1.

Null and empty texts score the intercept; equal texts score the same; without labels, or with one class only, the
score is the smoothed share of label 1 (0.5 without rows); repeated rows are scored as often as they occur; very long texts
are scored whole; labels without document, id or value are left out; of several labels of an id the largest holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import judged, keep, small_batches, unused

SAMPLE = 12_000
FEATURES = 4_000
POSITIVE = 4.0
ORDERS = (4, 5, 6)
FOLDS = 5
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_SIEVE = 22


def gram_hashes(text: str | None) -> list[np.ndarray]:
    """Hash of the n-gram at each position, an array for each order."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.full(len(codes), 7, np.uint32)
    for n in range(1, ORDERS[-1] + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ codes[n - 1 :]) * _M1
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            out.append(h * _M2)
    return out


class Features:
    """Known n-gram hashes: a sieve on the upper bits, then the sorted list."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known.astype(np.uint32)
        self.sieve = np.zeros(1 << _SIEVE, np.bool_)
        self.sieve[self.known >> np.uint32(32 - _SIEVE)] = True

    def present(self, text: str | None) -> np.ndarray:
        """Positions in the list of the features that the text holds."""
        found = [h[self.sieve[h >> np.uint32(32 - _SIEVE)]] for h in gram_hashes(text)]
        if not len(self.known) or not found:
            return np.empty(0, np.int64)
        h = np.unique(np.concatenate(found))
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return at[self.known[at] == h]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, y) of labelled rows outside the held-out fold, thinned by a hash of the id to about ``sample`` rows."""
    y = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    y = y.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    n = y.count()
    share = min(1.0, sample / max(n, 1))
    y = y.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(y, "doc_id").select("text", "y")


def log_count_ratios(rows: DataFrame, features: int) -> pd.DataFrame:
    """The best n-grams with their naive Bayes log-count ratio: gram, r."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: list[list[np.ndarray]] = [[], []]
            for text, y in zip(pdf["text"], pdf["y"]):
                seen[1 if y else 0].append(np.unique(np.concatenate([np.empty(0, np.uint32), *gram_hashes(text)])))
            for y in (0, 1):
                if seen[y]:
                    gram, n = np.unique(np.concatenate(seen[y]), return_counts=True)
                    yield pd.DataFrame({"gram": gram.astype(np.int64), "n0": n * (1 - y), "n1": n * y})

    classes = rows.groupBy().agg(F.count(F.when(F.col("y") == 0, 1)).alias("d0"), F.count(F.when(F.col("y") == 1, 1)).alias("d1")).first()
    counts = rows.mapInPandas(count, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    r = F.log((F.col("n1") + 1) / (classes["d1"] + 2.0)) - F.log((F.col("n0") + 1) / (classes["d0"] + 2.0))
    ranked = counts.filter("n0 + n1 >= 3").withColumn("r", r).withColumn("power", F.abs("r") * F.sqrt(F.col("n0") + F.col("n1")))
    return ranked.orderBy(F.desc("power"), "gram").limit(features).select("gram", "r").toPandas()


def fit_logistic(x_rows: np.ndarray, x_cols: np.ndarray, y: np.ndarray, r: np.ndarray, l2: float = 1e-5, steps: int = 15) -> tuple[np.ndarray, float]:
    """Weights and intercept on features r (presence times ratio): damped Newton steps, solved by conjugate gradients."""
    n, k = len(y), len(r)
    scale = r / max(np.abs(r).max(), 1e-9)
    cost = np.where(y == 1, min(POSITIVE, (n - y.sum()) / max(y.sum(), 1)), 1.0) / n
    penalty = np.append(np.full(k, l2), 1e-9)

    def forward(v):
        return np.bincount(x_rows, (scale * v[:-1])[x_cols], n) + v[-1]

    def back(g):
        return np.append(np.bincount(x_cols, g[x_rows], k) * scale, g.sum())

    w = np.zeros(k + 1)
    w[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        g = back((p - y) * cost) + penalty * w
        if np.abs(g).max() < 1e-7:
            break
        h, d, res = p * (1 - p) * cost, np.zeros(k + 1), -g
        q, first = res.copy(), res @ res
        now = first
        for _ in range(40):
            hq = back(h * forward(q)) + penalty * q
            a = now / (q @ hq)
            d, res = d + a * q, res - a * hq
            last, now = now, res @ res
            if now < 1e-6 * first:
                break
            q = res + now / last * q
        w += d * min(1.0, 8 / (np.abs(forward(d)).max() + 1e-9))
    return w[:-1] * scale, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """The classifier: sorted n-gram hashes, their weights, the intercept. Bounded by ``features``."""
    small_batches(docs)
    rows = keep(training_rows(docs, labels, sample).repartition(16), "labelled")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = float(np.log((pos + 1) / (n - pos + 1)))
    if pos in (0, n):
        return np.empty(0, np.int64), np.empty(0), prior
    top = log_count_ratios(rows, features).sort_values("gram")
    if not len(top):
        return np.empty(0, np.int64), np.empty(0), prior
    grams, r = top["gram"].to_numpy(np.int64), top["r"].to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(grams)

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(sent.value)
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "x": [features.present(t).astype(np.int32).tobytes() for t in pdf["text"]]})

    got = rows.mapInPandas(present, "y int, x binary").toPandas()  # bounded by the sample
    xs = [np.frombuffer(x, np.int32) for x in got["x"]]
    x_rows = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    w, b = fit_logistic(x_rows, np.concatenate(xs).astype(np.int64), got["y"].to_numpy(float), r)
    return grams, w, b


def with_score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], columns: list[str]) -> tuple[DataFrame, str]:
    """``columns`` of each document and its score, from the whole text; the score's name is returned too."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        grams, w, b = sent.value
        features = Features(grams)

        def score(texts: list) -> tuple[list]:
            z = np.array([b + w[features.present(t)].sum() for t in texts], float)
            return ((1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist(),)

        return score

    name = unused(docs, "score")
    return judged(docs, columns, f"{name} double", setup), name


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of each document: doc_id, held_out, score, predicted."""
    scored, name = with_score(docs, fit(docs, labels), ["doc_id"])
    score = F.col(name)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def tolerable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier does not reject, with all their columns."""
    scored, name = with_score(docs, fit(docs, labels), docs.columns)
    return scored.filter(F.col(name) < 0.5).select(*docs.columns)
