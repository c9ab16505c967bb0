"""Whitening of embeddings: covariance by tasks, leading components on the driver, projection of every row.

Entries become whole numbers. Sums over the distinct vectors are exact; each task centres its
vectors by them and multiplies, and tasks add up the rows of these matrices. What reaches the
driver is one matrix of as many rows as a vector has entries, however many vectors there are.

There it is made tridiagonal by Householder reflections. Sturm counts tell how many
eigenvalues lie below a number, so bisection encloses each of the leading ones; inverse
iteration gives their vectors, made orthogonal again within clusters of close eigenvalues.
The components, divided by the roots of the eigenvalues, go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this are taken as this, so that sums and differences stay whole numbers of 64 bits.
LARGEST = 1 << 40
#: Eigenvalues closer than this share of the matrix' norm are a cluster.
CLUSTER = 1e-3
EPS = float(np.finfo(float).eps)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the unit vectors of the reflections that make a symmetric matrix tridiagonal."""
    a = np.array(matrix, float)
    size, mirrors = len(a), []
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        norm = float(np.linalg.norm(v))
        if norm == 0 or not np.any(v[1:]):
            mirrors.append(None)
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        x = a[k + 1 :, k]
        x -= 2 * v * (v @ x)
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are less than each number: the negative pivots of a Sturm sequence."""
    least = EPS * max(1e-300, float(np.max(np.abs(diagonal), initial=0) + np.max(np.abs(off), initial=0))) ** 2 + 1e-300
    pivot = diagonal[0] - at
    n = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < least, np.where(pivot < 0, -least, least), pivot)
        pivot = d - at - e * e / pivot
        n += pivot < 0
    return n


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection to the last bits of the largest."""
    around = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    norm = float(np.max(np.abs(diagonal) + around))
    low, high = np.full(k, float(np.min(diagonal - around)) - 2 * EPS * norm), np.full(k, float(np.max(diagonal + around)) + 2 * EPS * norm)
    # The j-th largest is the least number below which there are size - j of them.
    below = len(diagonal) - np.arange(k)
    while np.max(high - low) > 2 * EPS * norm:
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        under = counts_below(diagonal, off, middle) >= below
        low, high = np.where(under, low, middle), np.where(under, middle, high)
    return (low + high) / 2


def _factors(diagonal: np.ndarray, off: np.ndarray, value: float, least: float):
    """Elimination with row exchanges of the matrix less ``value``; no pivot is smaller than ``least``."""
    size = len(diagonal)
    main, upper, upper2 = diagonal - value, np.append(off, 0.0), np.zeros(size)
    steps = []
    for i in range(size - 1):
        below, swap = off[i], abs(off[i]) > abs(main[i])
        if swap:
            main[i], below = below, main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            upper2[i], upper[i + 1] = upper[i + 1], 0.0
        if abs(main[i]) < least:
            main[i] = least
        by = below / main[i]
        main[i + 1] -= by * upper[i]
        upper[i + 1] -= by * upper2[i]
        steps.append((swap, by))
    if abs(main[-1]) < least:
        main[-1] = least
    return main, upper, upper2, steps


def _solved(factors, right: np.ndarray) -> np.ndarray:
    main, upper, upper2, steps = factors
    x = right.copy()
    for i, (swap, by) in enumerate(steps):
        if swap:
            x[i], x[i + 1] = x[i + 1], x[i]
        x[i + 1] -= by * x[i]
    for i in range(len(x) - 1, -1, -1):
        later = (upper[i] * x[i + 1] if i + 1 < len(x) else 0.0) + (upper2[i] * x[i + 2] if i + 2 < len(x) else 0.0)
        x[i] = (x[i] - later) / main[i]
        if abs(x[i]) > 1e200:
            x *= 1e-200
    return x


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    size = len(matrix)
    k = min(k, size)
    scale = float(np.max(np.abs(matrix), initial=0))
    if not scale:
        return np.zeros(k), np.eye(size)[:, :k]
    diagonal, off, mirrors = tridiagonal(np.asarray(matrix, float) / scale)
    values = leading_values(diagonal, off, k)
    norm = float(np.max(np.abs(diagonal)) + 2 * np.max(np.abs(off), initial=0))
    least, rng = EPS * norm, np.random.default_rng(0)
    vectors = np.zeros((size, k))
    first, shift = 0, np.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > CLUSTER * norm:
            first, shift = j, np.inf
        shift = min(values[j], shift - 10 * least)  # equal ones are told apart by a few last bits
        factors = _factors(diagonal, off, shift, least)
        y = rng.standard_normal(size)
        for _ in range(4):
            y = _solved(factors, y / np.linalg.norm(y))
            y /= np.linalg.norm(y)
            for _ in range(2):
                y -= vectors[:, first:j] @ (vectors[:, first:j].T @ y)
                y /= np.linalg.norm(y)
        vectors[:, j] = y
    for at in range(len(mirrors) - 1, -1, -1):
        if (v := mirrors[at]) is not None:
            vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


def whole_entries(vector: Column, size: int | None = None) -> Column:
    """Entries as whole numbers, filled up with those of zeros to ``size``."""
    bound = F.lit(float(LARGEST))
    x = F.transform(vector.cast("array<double>"), lambda c: F.floor(F.greatest(-bound, F.least(bound, F.lit(float(SCALE)) * c))).cast("long") + SHIFT)
    return x if size is None else F.concat(x, F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(size) - F.size(x)))


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(size: int):
    """One row a task: the number of vectors, then the sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size, np.int64)
        for batch in batches:
            total[0] += batch.num_rows
            total[1:] += _matrix(batch.column(0), size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["s"])

    return run


class Centre:
    """The mean of whole vectors as quotients and remainders, so that differences from it lose nothing to the size of the entries."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole, self.rest = n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of the squares of n x - S, exact; None beyond 64 bits."""
        y = x - self.whole
        if float(np.max(np.abs(y), initial=0)) ** 2 * max(1, x.shape[1]) >= 2.0**62 or float(np.max(np.abs(y), initial=0)) * self.n * max(1, x.shape[1]) >= 2.0**62:
            y, rest = y.astype(object), self.rest.astype(object)
        else:
            rest = self.rest
        n, last = self.n, sum(int(r) ** 2 for r in self.rest)
        found = (n * n * int(a) - 2 * n * int(b) + last for a, b in zip((y * y).sum(axis=1), (y * rest).sum(axis=1)))
        return [d if d < 1 << 63 else None for d in found]


def _scatter(size: int, centre: Centre, to):
    """The rows of the task's sum of products of centred vectors, first taken by the matrix ``to`` if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = centre.of(_matrix(batch.column(0), size))
            z = z if to is None else z @ to.value
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            row = v.values.to_numpy()
            sums[i] = sums[i] + row if i in sums else row.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "v"])


def _covariance(fit: DataFrame, size: int, centre: Centre, to=None) -> np.ndarray:
    schema = "i int, v array<double>"
    rows = fit.mapInArrow(_scatter(size, centre, to), schema).repartition("i").mapInArrow(_added, schema).collect()  # one row for each entry of a vector
    return np.array([r.v for r in sorted(rows)]) / centre.n


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten(size: int, centre: Centre, to, explained: list[float], error: float):
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                x = _matrix(batch.column(1), size)
                rows, flat = len(x), (centre.of(x) @ to.value).ravel()
                at = np.repeat(np.arange(rows), k)
                columns = [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, centre.n)),
                    pa.array(centre.deviations(x), pa.int64()).take(pa.array(at)),
                    pa.array(flat, from_pandas=True),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def whiten(embeddings: DataFrame, *, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``RESULT``: each row of ``embeddings`` on the leading components, once a component.

    Rows whose vector is null or has null or non-finite entries are left out. Vectors shorter
    than the longest go on with zeros. Entries become whole numbers; the covariance is that of
    the distinct vectors. Rows that repeat an id or a vector are whitened each; null ids stay
    null. A component without variance (all vectors equal in it) explains 0 and whitens to
    null; ``deviation`` is null beyond 64 bits. Further columns are not read; an empty table,
    or one of empty vectors, gives no rows.
    """
    source = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(finite(F.col("v")))
    spark, size = embeddings.sparkSession, source.agg(F.max(F.size("v"))).first()[0]
    if not size:
        return spark.createDataFrame([], RESULT)
    fit = stash(source.select(whole_entries(F.col("v"), size).alias("x")).distinct(), "vectors")
    sums = fit.mapInArrow(_sums(size), "s array<long>").select(F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    centre = Centre(sums[0].s, [r.s for r in sums[1:]])
    covariance = _covariance(fit, size, centre)
    values, vectors = leading_components(covariance, components)
    trace = float(np.trace(covariance))
    real = values > size * EPS * max(values[0], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        projection = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), np.nan)
    error = 0.0
    if real.any():
        kept = _covariance(fit, size, centre, spark.sparkContext.broadcast(projection[:, real]))
        error = float(np.max(np.abs(kept - np.eye(len(kept)))))
    unstash(fit)
    explained = [float(v / trace) if r else 0.0 for v, r in zip(values, real)]
    rows = source.select("vec_id", whole_entries(F.col("v"), size).alias("x"))
    return rows.mapInArrow(_whiten(size, centre, spark.sparkContext.broadcast(projection), explained, error), RESULT)
