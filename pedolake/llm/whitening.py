"""Whitening of embeddings: distributed centred covariance, leading eigenpairs by Sturm counts, projection.

1. One scan counts the vectors and sums every dimension exactly (in two halves, so no sum overflows).
2. A second scan takes the centred products: n*x - S is formed in integers, divided once, and each task adds
   up one matrix. Matrices of tasks are added in two levels of tasks; one of dims x dims reaches the driver.
3. Householder reflections make it tridiagonal, bisection on Sturm counts finds the leading eigenvalues,
   inverse iteration their vectors; vectors of close eigenvalues are made orthogonal to each other in turn.
4. A third scan measures the covariance of the whitened vectors, the last one projects. Only the components
   (dims x components) are sent to the tasks, a size that does not depend on the rows.

Every component takes the sign that makes its largest entry positive.

Defined results: rows whose vector is null or empty or holds null or non-finite entries, or entries of 2**56
and more, are left out; of vectors of several lengths those of the most frequent one remain (of the shorter
on ties). Directions without variance (below 1e-12 of the largest) are no components, so equal vectors give no
rows, like an empty table. Repeated and null ids are rows of their own. A deviation that is no long is null in
``whitened_rows`` and exact in ``whiten``. Other columns are ignored.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tune

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Components of less variance than this share of the first one's are left out.
NIL = 1e-12
#: Tasks that add up the matrices of all others, before one adds up theirs.
FAN = 32
#: Vectors whose products are taken at once.
ROWS = 4096
_BIG = float(1 << 62)


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of x) of the usable vectors of a batch, by length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        c = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(c * SCALE)
            good = (np.abs(x) < _BIG).all(1)  # false for NaN as well
        if good.any():
            yield at[good], x[good].astype(np.int64) + OFFSET


@dataclass
class Moments:
    """Vectors, dimensions and exact sums of each; ``low`` is the floor of the mean, ``rest`` what is left of the sum."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.low = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the difference to the integer below the mean is exact."""
        return (x - self.low) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)**2, exactly."""
        y = x - self.low
        widest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if x.shape[1] * widest**2 < 1 << 63:
            y = self.n * y - self.rest
            return (y * y).sum(1).tolist()
        y = self.n * y.astype(object) - self.rest.astype(object)
        return (y * y).sum(1).tolist()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each length: rows, and the sums of the upper and lower halves of x."""
    total: dict[int, list] = {}
    for batch in batches:
        for _, x in integers(batch.column(0)):
            own = total.setdefault(x.shape[1], [0, 0, 0])
            own[0] += len(x)
            own[1] = own[1] + (x >> 32).sum(0)
            own[2] = own[2] + (x & 0xFFFFFFFF).sum(0)
    for d, (n, high, low) in total.items():
        at = np.arange(d)
        yield pa.record_batch(
            [pa.array(np.full(d, d, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)],
            names=["dims", "at", "n", "high", "low"],
        )


def moments(vectors: DataFrame, column: str = "embedding") -> Moments | None:
    """Exact counts and sums of the vectors of the most frequent length; None if there are none."""
    parts = vectors.select(column).mapInArrow(_sums, "dims int, at int, n long, high long, low long")
    wide = "decimal(38,0)"
    parts = parts.groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    by_length: dict[int, list] = {}
    for r in parts.collect():  # one row for each dimension
        by_length.setdefault(r["dims"], []).append(r)
    if not by_length:
        return None
    rows = sorted(by_length[min(by_length, key=lambda d: (-by_length[d][0]["n"], d))], key=lambda r: r["at"])
    return Moments(rows[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in rows])


def summed(parts: DataFrame) -> np.ndarray:
    """The sum of all rows' matrices (column ``m``, doubles as bytes), added up in tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m in batch.column(0):
                m = np.frombuffer(m.as_buffer(), np.float64)
                total = m.copy() if total is None else total + m
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    for tasks in (FAN, 1):
        parts = parts.repartition(tasks).mapInArrow(add, "m binary")
    return np.frombuffer(parts.first()["m"], np.float64)


def products(vectors: DataFrame, m: Moments, by: np.ndarray | None, column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Covariance (divisor n) and mean of the centred vectors, or of their projections on the columns of ``by``."""
    d = len(m.sums)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = mean = 0.0
        for batch in batches:
            for _, x in integers(batch.column(0)):
                for k in range(0, len(x) if x.shape[1] == d else 0, ROWS):
                    y = m.centred(x[k : k + ROWS])
                    y = y if by is None else y @ by
                    square, mean = square + y.T @ y, mean + y.sum(0)
        if not np.isscalar(square):
            yield pa.record_batch([pa.array([np.concatenate([square.ravel(), mean]).tobytes()], pa.binary())], names=["m"])

    both = summed(vectors.select(column).mapInArrow(multiply, "m binary")) / m.n
    k = d if by is None else by.shape[1]
    mean = both[k * k :]
    return both[: k * k].reshape(k, k) - np.outer(mean, mean), mean  # means are next to 0: nothing cancels


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the unit vectors of the reflections that a symmetric matrix is reduced by."""
    a, n, mirrors = v.astype(np.float64).copy(), len(v), []
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        size = np.abs(u).max()
        if size == 0 or not np.any(u[1:]):
            mirrors.append(np.zeros_like(u))
            continue
        u /= size
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        u /= np.linalg.norm(u)
        mirrors.append(u)
        p = a[k + 1 :, k + 1 :] @ u
        w = 2 * (p - (u @ p) * u)
        a[k + 1 :, k + 1 :] -= np.outer(u, w) + np.outer(w, u)
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues below each of the places: negative pivots of T - place*I."""
    small = np.finfo(float).tiny ** 0.5
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = np.where(np.abs(q) < small, -small, q)
        q = d - at - e * e / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until no double lies between its bounds."""
    n = len(diagonal)
    reach = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    high += np.abs(high) * 1e-15 + 1e-300
    wanted = n - 1 - np.arange(k)  # this many lie below
    while True:
        mid = low + (high - low) / 2
        open_ = (mid > low) & (mid < high)
        if not open_.any():
            return low
        below = sturm_counts(diagonal, off, mid) > wanted
        high, low = np.where(open_ & below, mid, high), np.where(open_ & ~below, mid, low)


class _Shifted:
    """T - value*I by elimination with row exchanges."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, value: float, small: float):
        n = len(diagonal)
        self.u, self.swap, self.factor = np.zeros((n, 3)), np.zeros(n, bool), np.zeros(n)
        row = np.array([diagonal[0] - value, off[0] if n > 1 else 0.0, 0.0])
        for i in range(n - 1):
            below = np.array([off[i], diagonal[i + 1] - value, off[i + 1] if i + 2 < n else 0.0])
            if abs(below[0]) > abs(row[0]):
                self.swap[i], row, below = True, below, row
            if row[0] == 0:
                row[0] = small
            self.factor[i] = below[0] / row[0]
            self.u[i] = row
            row = np.array([below[1] - self.factor[i] * row[1], below[2] - self.factor[i] * row[2], 0.0])
        self.u[n - 1] = row
        self.u[np.abs(self.u[:, 0]) < small, 0] = small

    def solve(self, b: np.ndarray) -> np.ndarray:
        x, n = b.copy(), len(b)
        for i in range(n - 1):
            if self.swap[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= self.factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                x[i] -= self.u[i, 1] * x[i + 1]
            if i + 2 < n:
                x[i] -= self.u[i, 2] * x[i + 2]
            x[i] /= self.u[i, 0]
        return x


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit vectors as columns."""
    diagonal, off, mirrors = tridiagonal(v)
    size = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)) or 1.0
    diagonal, off = diagonal / size, off / size
    values, rng = leading_values(diagonal, off, k), np.random.default_rng(7)
    eps, n = np.finfo(float).eps, len(v)
    vectors, first = np.zeros((n, k)), 0
    for j in range(k):
        if j and values[j - 1] - values[j] > 1e-3 * max(abs(values[0]), eps):
            first = j  # a new cluster of close values
        shifted = _Shifted(diagonal, off, values[j] - (j - first) * 2 * eps, eps)  # equal values are held apart
        x = rng.standard_normal(n)
        for _ in range(5):
            for _ in range(2):  # twice is enough
                x -= vectors[:, first:j] @ (vectors[:, first:j].T @ x)
            x = shifted.solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
        for _ in range(2):
            x -= vectors[:, first:j] @ (vectors[:, first:j].T @ x)
        vectors[:, j] = x / np.linalg.norm(x)
    for i in range(len(mirrors) - 1, -1, -1):
        u = mirrors[i]
        vectors[i + 1 :] -= 2 * np.outer(u, u @ vectors[i + 1 :])
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1, 1)
    return values * size, vectors / np.linalg.norm(vectors, axis=0)


@dataclass
class Whitener:
    """What a table's whitening is: moments, eigenvalues, components as columns, share of the variance, error."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Whitener | None:
    """Fits on all usable vectors; None where there is no variance."""
    tune(spark)
    m = moments(vectors, column)
    if m is None:
        return None
    v, _ = products(vectors, m, None, column)
    v = (v + v.T) / 2
    values, axes = leading_pairs(v, min(components, len(v)))
    keep = values > NIL * max(values[0], 0)
    if not keep.any():
        return None
    values, axes = values[keep], axes[:, keep]
    got, _ = products(vectors, m, axes / np.sqrt(values), column)
    return Whitener(m, values, axes, values / np.trace(v), float(np.abs(got - np.eye(len(values))).max()))


def whiten(spark: SparkSession, vectors: DataFrame, w: Whitener, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per usable vector: its id, deviation (decimal), whitened (array of doubles)."""
    tune(spark)
    m, by, d = w.moments, w.vectors / np.sqrt(w.values), len(w.moments.sums)
    wide = pa.decimal128(38, 0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch.column(1)):
                if x.shape[1] != d:
                    continue
                out = m.centred(x) @ by
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * out.shape[1], out.ravel())
                far = [s if s < 10**38 else None for s in m.deviations(x)]
                far = pa.array([None if s is None else decimal.Decimal(s) for s in far], wide)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), far, lists], names=["id", "deviation", "whitened"])

    id_type = vectors.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return vectors.select(id_column, column).mapInArrow(project, schema).withColumnRenamed("id", id_column)


def whitened_rows(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    w = fit(spark, vectors, components)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    if w is None:
        return spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(x)) for x in w.explained])
    rows = whiten(spark, vectors, w).select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(w.moments.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, "at").alias("explained"),
        F.lit(w.identity_error).alias("identity_error"),
    )
