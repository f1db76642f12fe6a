"""Whitening of embeddings by polarisation: variances of dimensions and of sums of two dimensions, nothing else.

1. Vectors become exact integers `x = floor(scale * c)`; the fit list holds each distinct vector once.
2. One pass over the fit list sums every dimension, a second one the squares of all centred dimensions and of all
   sums of two centred dimensions. Tasks add them up in integers (Python's own where 64 bits could overflow), Spark
   adds the tasks' rows as decimals.
3. `cov(i, j) = (var(i + j) - var(i) - var(j)) / 2`, in integers, gives the matrix `eigh` splits on the driver:
   its size is the square of the dimensions, whatever the number of rows.
4. One pass over all rows projects them; a last one over the fit list measures the covariance of what came out.

Centring takes the integer part of the mean off and the square of the remainder at the end, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vacanta.session import settle

SCALE = 256
COMPONENTS = 4
# An eigenvalue below this share of the largest one is rounding: its component cannot be scaled to variance one.
LEAST_SHARE = 1e-12
# Entries are kept within this size, so that the whole arithmetic fits decimals of 38 digits.
LARGEST = 2**40
_ROWS = 4_096


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """`floor(scale * c)` of every entry as long; null for a vector that is null, empty, or has a null or non-finite entry."""
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("long"))
    fine = (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), whole)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _whole(values: np.ndarray, largest: int) -> np.ndarray:
    """`values` as they are where 64 bits hold results up to `largest`, as Python integers otherwise."""
    return values if largest < 2**62 else values.astype(object)


def squares(z: np.ndarray) -> list[int]:
    """Sums of `z_i ** 2` and `(z_i + z_j) ** 2` for i <= j, row by row of the upper triangle, exact."""
    if not len(z):
        return [0] * (z.shape[1] * (z.shape[1] + 1) // 2)
    z = _whole(z, 4 * int(np.abs(z).max()) ** 2 * len(z))
    out: list[int] = []
    for i in range(z.shape[1]):
        pair = z[:, i : i + 1] + z[:, i:]
        pair[:, 0] = z[:, i]
        out += [int(v) for v in (pair * pair).sum(axis=0)]
    return out


def _added(fit: DataFrame, width: int, of) -> list[int]:
    """Sums over all rows of the lists `of(matrix)`, `width` integers each: one decimal per place reaches the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                total = [a + b for a, b in zip(total, of(batch.column(0).slice(start, _ROWS)))]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(v) for v in total])], names=["place", "part"])

    sums = fit.select("x").mapInArrow(add, "place int, part string").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    return [int(v) for _, v in sorted((r["place"], r["total"]) for r in sums)] or [0] * width


@dataclass
class Whitening:
    """What was fitted: number of distinct vectors, sums per dimension, components (rows) with their eigenvalues, total variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of the rows of `x`: the centred row on each component, over the root of its eigenvalue."""
        mean = np.array([s // self.n for s in self.sums])
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (((x - mean).astype(np.float64) - rest) @ self.vectors.T) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of `(n * x - sum) ** 2` for every row, exact."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        x = _whole(x, largest * largest * max(1, x.shape[1]))
        y = x * self.n - np.array(self.sums, dtype=x.dtype)
        return (y * y).sum(axis=1)


def covariance(fit: DataFrame, n: int, d: int) -> tuple[list[int], list[list[int]]]:
    """Sums per dimension and the covariance matrix times `n ** 2`, all integers, of the rows `x` of `fit`."""
    sums = _added(fit, d, lambda c: [int(v) for v in _whole(_matrix(c, d), LARGEST * _ROWS).sum(axis=0)])
    mean, rest = np.array([s // n for s in sums]), [s % n for s in sums]
    total = _added(fit, d * (d + 1) // 2, lambda c: squares(_matrix(c, d) - mean))
    at = iter(total)
    square = [[next(at) for _ in range(i, d)] for i in range(d)]
    # n times the sum of squares about the true mean, from sums about its integer part.
    own = [n * square[i][0] - rest[i] ** 2 for i in range(d)]
    out = [[0] * d for _ in range(d)]
    for i in range(d):
        out[i][i] = own[i]
        for j in range(i + 1, d):
            both = n * square[i][j - i] - (rest[i] + rest[j]) ** 2
            out[i][j] = out[j][i] = (both - own[i] - own[j]) // 2
    return sums, out


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors `x` of `fit`; None if there are none or all are equal."""
    n, d = fit.agg(F.count("x"), F.max(F.size("x"))).first()
    if not n:
        return None
    sums, matrix = covariance(fit, n, d)
    exact = np.array([[float(Fraction(v, n * n)) for v in row] for row in matrix])
    values, vectors = np.linalg.eigh(exact)
    kept = [k for k in range(d - 1, -1, -1) if values[k] > 0 and values[k] > LEAST_SHARE * values[-1]][:components]
    if not kept:
        return None
    return Whitening(n, sums, vectors[:, kept].T.copy(), values[kept].copy(), float(Fraction(sum(matrix[i][i] for i in range(d)), n * n)))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, measured on its rows."""
    d, k = len(model.sums), len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                w = model.project(_matrix(batch.column(0).slice(start, _ROWS), d))
                first += w.sum(axis=0)
                second += w.T @ w
        flat = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["place", "part"])

    sums = fit.select("x").mapInArrow(add, "place int, part double").groupBy("place").agg(F.sum("part").alias("total")).collect()
    flat = np.array([v for _, v in sorted((r["place"], r["total"]) for r in sums)]) / model.n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """`(vec_id, component, n, deviation, whitened, explained, identity_error)`: a row per usable row of
    `vectors(vec_id, embedding, ...)` and component, the component of the largest variance first.

    Rows whose vector is null, empty, or holds a null or non-finite entry are left out, as are those of another length than
    most rows have (of two lengths as frequent, the larger one stays). Entries beyond 2^40 after scaling count as 2^40.
    Equal vectors are fitted once and each keeps its rows, null or repeated vec_ids included. Components whose
    variance is only rounding have no rows: none come from an empty table or from one distinct vector.
    `deviation` is null where it passes 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("x")).where("x IS NOT NULL")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length["d"]
    rows = rows.where(F.size("x") == d)
    fit = settle(rows.select("x").distinct())
    model = fit_whitening(fit, components)
    if model is None:
        return spark.createDataFrame([], schema)
    error, k = identity_error(fit, model), len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            m = len(x)
            far = pa.array([int(v) if v < 2**63 else None for v in model.deviation(x)], pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), far.take(each),
                 pa.array(model.project(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
