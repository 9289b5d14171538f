"""Operator 12: whitening of embeddings by a covariance from variances alone (polarisation).

Entries become whole numbers on a grid, so every sum below is exact. Over the fit list (each distinct vector once) the exact
sum of squared centred values is aggregated for every dimension i and for every sum of two dimensions i + j; since
Var(i + j) = Var(i) + Var(j) + 2 Cov(i, j), differences of these variances recover all covariances. They are assembled on the
driver for ``eigh``: d (d + 1) / 2 numbers for d dimensions, however many rows there are.

Values are centred at the whole number nearest to the mean before they are squared; what is left of the mean enters exactly
afterwards. Tasks sum in 64-bit whole numbers where a bound on their values shows that nothing can overflow, else in numbers
of any size; sums of tasks meet as decimals of 38 digits. Each task sends one row a dimension or pair, so no key gathers rows.

A null vector, and one with null or non-finite entries, is dropped; so is a vector that has not the table's dimension, which
is the commonest length (the longer of two equally common ones); an empty table, or one without vectors of a positive length,
gives an empty result. Repeated vectors count once in the fit and have a row each in the result, also without or with equal
ids. Directions without variance (to double precision) can't be scaled to 1: there ``whitened`` is null and
``identity_error`` leaves them out; ``explained`` is null if nothing varies. Numbers that leave 64 bits raise an error.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import keep

GRID = 64
SHIFT = 1_000_000
COMPONENTS = 16
BITS = 62


def usable(v: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def on_grid(v: Column) -> Column:
    return F.transform(v, lambda c: F.floor(c.cast("double") * GRID) + SHIFT)


def dimension(vectors: DataFrame) -> int:
    """The commonest length, 0 without vectors."""
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("many")).filter("d > 0")
    top = lengths.orderBy(F.desc("many"), F.desc("d")).first()
    return top["d"] if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def safe(y: np.ndarray, largest: int) -> np.ndarray:
    """``y`` as it is if sums of its rows' values, each at most ``largest``, fit 64 bits, else as Python's whole numbers."""
    return y if largest * max(len(y), 1) < 1 << BITS else y.astype(object)


def summed(vectors: DataFrame, d: int, size: int, kernel: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all rows of what ``kernel`` gives for a matrix of whole numbers: ``size`` whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for batch in batches:
            total += kernel(matrix(batch.column(0), d)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], names=["at", "v"])

    sums = vectors.select("x").mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v"))
    out = [0] * size
    for r in sums.collect():
        out[r["at"]] = int(r["v"])
    return out


def column_sums(x: np.ndarray) -> np.ndarray:
    largest = int(np.abs(x).max(initial=0))
    return np.append(safe(x, largest).sum(axis=0), len(x)) if len(x) else np.zeros(x.shape[1] + 1, object)


def squares(centre: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of squares of all centred dimensions, then of all sums of two."""
    d = len(centre)

    def kernel(x: np.ndarray) -> np.ndarray:
        y = x - centre
        y = safe(y, (2 * int(np.abs(y).max(initial=0))) ** 2)
        parts = [(y * y).sum(axis=0)]
        for i in range(d - 1):
            both = y[:, i : i + 1] + y[:, i + 1 :]
            parts.append((both * both).sum(axis=0))
        return np.concatenate(parts)

    return kernel


def covariance(n: int, sums: list[int], centre: list[int], squared: list[int]) -> np.ndarray:
    """n^2 times the covariance with divisor n, exactly, divided once at the end."""
    d = len(sums)
    rest = [n * c - s for c, s in zip(centre, sums)]  # n times (centre - mean)
    # sum of (n x - S)^2 = n^2 sum of y^2 - n rest^2, as the y = x - centre sum up to -rest
    alone = [n * n * squared[i] - n * rest[i] ** 2 for i in range(d)]
    v = np.empty((d, d))
    k = d
    for i in range(d):
        v[i, i] = alone[i] / n**3
        for j in range(i + 1, d):
            pair = n * n * squared[k] - n * (rest[i] + rest[j]) ** 2
            v[i, j] = v[j, i] = (pair - alone[i] - alone[j]) / (2 * n**3)
            k += 1
    return v


class Model:
    """What tasks need to whiten: centre, rest of the mean, directions, and the figures of the fit."""

    def __init__(self, n: int, sums: list[int], centre: np.ndarray, v: np.ndarray, components: int) -> None:
        value, vector = np.linalg.eigh(v)
        value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
        least = len(sums) * np.finfo(float).eps * max(value[0], 0)
        self.n, self.sums, self.centre = n, np.array(sums, object), centre
        self.rest = np.array([(n * int(c) - s) / n for c, s in zip(centre, sums)])
        self.varies = value > least
        self.directions = vector / np.sqrt(np.where(self.varies, value, 1))
        trace = float(np.trace(v))
        self.explained = [float(e) / trace if trace > 0 else None for e in value]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) + self.rest) @ self.directions

    def deviation(self, x: np.ndarray) -> np.ndarray:
        largest = self.n * max(int(np.abs(x).max(initial=0)), 1) + max((abs(int(s)) for s in self.sums), default=0)
        if largest < 1 << BITS:
            y = self.n * x - self.sums.astype(np.int64)
            y = safe(y.T, int(np.abs(y).max(initial=0)) ** 2)
        else:
            y = (self.n * x.astype(object) - self.sums).T
        return (y * y).sum(axis=0)


def fitted(fit: DataFrame, d: int, components: int) -> Model | None:
    *sums, n = summed(fit, d, d + 1, column_sums)
    if not n:
        return None
    centre = [(2 * s + n) // (2 * n) for s in sums]
    squared = summed(fit, d, d * (d + 1) // 2, squares(np.array(centre, np.int64)))
    return Model(n, sums, np.array(centre, np.int64), covariance(n, sums, centre, squared), components)


def identity_error(fit: DataFrame, d: int, model: Model) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    c = int(model.varies.sum())
    if not c:
        return None
    rows, cols = np.triu_indices(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rows) + c)
        for batch in batches:
            w = model.whiten(matrix(batch.column(0), d))[:, model.varies]
            total += np.append((w.T @ w)[rows, cols], w.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "v"])

    got = {r["at"]: r["v"] / model.n for r in fit.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    mean = [got[len(rows) + i] for i in range(c)]
    return max(abs(got[k] - mean[i] * mean[j] - (i == j)) for k, (i, j) in enumerate(zip(rows.tolist(), cols.tolist())))


def whitened(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    spark = embeddings.sparkSession
    schema = StructType([
        embeddings.schema["vec_id"], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ])
    vectors = embeddings.select("vec_id", F.col(vector).alias("v")).filter(usable(F.col("v"))).select("vec_id", on_grid(F.col("v")).alias("x"))
    d = dimension(vectors)
    vectors = vectors.filter(F.size("x") == d)
    fit = keep(vectors.select("x").distinct(), "fit")
    model = fitted(fit, d, components) if d else None
    if model is None:
        return spark.createDataFrame([], schema)
    error, c = identity_error(fit, d, model), len(model.explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0), matrix(batch.column(1), d)
            m, w = len(x), model.whiten(x)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.repeat(np.arange(m), c))), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, model.n)),
                pa.array(np.repeat(model.deviation(x), c).tolist(), pa.int64()), pa.array(w.ravel(), mask=np.tile(~model.varies, m)),
                pa.array(model.explained * m, pa.float64()), pa.array([error] * (m * c), pa.float64()),
            ], names=schema.names)

    return vectors.mapInArrow(run, schema)
