"""Whitening of embeddings: exact distributed sums, centred covariance, own eigensolver, broadcast projection.

The covariance is a sum of one small matrix a task. Its leading eigenvalues are found on the driver by Householder
reduction to a tridiagonal matrix, bisection on Sturm counts, and inverse iteration in which vectors of close eigenvalues
are kept orthogonal; the matrix has the vectors' dimension and does not grow with the rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows that a task works on at a time.
BLOCK_ROWS = 4096
#: Scaled entries beyond it, either way, count as it: it is where doubles stop being exact integers.
LARGEST = 2.0 ** 52
_EPS = np.finfo(np.float64).eps


# The eigensolver

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of the tridiagonal form of a symmetric matrix."""
    a = np.array(matrix, np.float64)
    n, reflections = len(a), []
    for k in range(n - 2):
        column = a[k + 1:, k].copy()
        length = np.linalg.norm(column)
        v = column.copy()
        v[0] += np.copysign(length, column[0])
        if np.any(column[1:]) and length > 0:
            v /= np.linalg.norm(v)
            # A' = H A H with H = 1 - 2 v v': a rank-two update of the rest.
            p = a[k + 1:, k + 1:] @ v
            w = 2 * (p - (v @ p) * v)
            a[k + 1:, k + 1:] -= np.outer(v, w) + np.outer(w, v)
            a[k + 1:, k] = a[k, k + 1:] = 0
            a[k + 1, k] = a[k, k + 1] = -np.copysign(length, column[0])
        else:
            v = np.zeros_like(column)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_count(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues lie below each point of `at`: the negative pivots of T - x."""
    below, pivot = np.zeros(len(at), np.int64), np.ones(len(at))
    for i, d in enumerate(diagonal):
        pivot = d - at - (squares[i - 1] / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, beside: np.ndarray, count: int) -> np.ndarray:
    """The `count` largest eigenvalues, falling, each by bisection between Gershgorin's bounds until no double lies between."""
    radius = np.abs(np.concatenate([[0], beside])) + np.abs(np.concatenate([beside, [0]]))
    low, high = float(np.min(diagonal - radius)), float(np.max(diagonal + radius))
    scale = max(abs(low), abs(high), np.finfo(np.float64).tiny)
    squares, tiny = beside ** 2, scale * _EPS ** 2
    wanted = len(diagonal) - 1 - np.arange(count)
    lows, highs = np.full(count, low - scale * _EPS), np.full(count, high + scale * _EPS)
    for _ in range(200):
        middle = lows + (highs - lows) / 2
        if np.all((middle <= lows) | (middle >= highs) | (highs - lows <= scale * _EPS / 8)):
            break
        over = sturm_count(diagonal, squares, middle, tiny) > wanted
        highs, lows = np.where(over, middle, highs), np.where(over, lows, middle)
    return lows + (highs - lows) / 2


def _solve_shifted(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """x with (T - shift) x = right, by elimination with row interchanges."""
    n = len(diagonal)
    d, up, up2, low, x = diagonal - shift, np.append(beside, 0.0), np.zeros(n), np.append(beside, 0.0), right.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            d[i], low[i] = low[i], d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        pivot = d[i] if abs(d[i]) > tiny else np.copysign(tiny, d[i])
        factor = low[i] / pivot
        d[i] = pivot
        d[i + 1] -= factor * up[i]
        up[i + 1] -= factor * up2[i]
        x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        pivot = d[i] if abs(d[i]) > tiny else np.copysign(tiny, d[i])
        x[i] = (x[i] - (up[i] * x[i + 1] if i + 1 < n else 0) - (up2[i] * x[i + 2] if i + 2 < n else 0)) / pivot
        if abs(x[i]) > 1e100:
            x /= abs(x[i])
    return x


def leading_vectors(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of a tridiagonal matrix by inverse iteration; within a cluster of close eigenvalues each is made
    orthogonal to those before it, in every step."""
    n = len(diagonal)
    norm = max(np.max(np.abs(diagonal)), np.max(np.abs(beside), initial=0), np.finfo(np.float64).tiny)
    close, tiny = norm * 1e-3, norm * _EPS
    random, vectors = np.random.default_rng(7), np.zeros((len(values), n))
    first = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > close:
            first = i
        # Equal values are set apart a little, so that their solutions differ.
        shift = value - 2 * tiny * sum(abs(values[first:i] - value) <= tiny)
        for _ in range(3):
            x = random.uniform(-1, 1, n)
            for _ in range(6):
                x = _solve_shifted(diagonal, beside, shift, x, tiny * _EPS)
                x /= np.linalg.norm(x)
                for _ in range(2):
                    x -= vectors[first:i].T @ (vectors[first:i] @ x)
                length = np.linalg.norm(x)
                if length > 1e-12:
                    x /= length
            if length > 1e-12:
                break
        vectors[i] = x
    return vectors


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and their unit eigenvectors as rows; of each the entry of largest size is positive."""
    scale = float(np.max(np.abs(matrix), initial=0.0))
    if not scale:
        return np.zeros(count), np.eye(len(matrix))[:count]
    diagonal, beside, reflections = tridiagonal(matrix / scale)
    values = leading_values(diagonal, beside, count)
    vectors = leading_vectors(diagonal, beside, values).T
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.where(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(count)] < 0, -1, 1)
    return values * scale, vectors.T


# The distributed part

def _scaled(batch: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of a batch's last column, and floor(1024 c) + 100000 of their entries, as doubles."""
    vectors = batch.column(batch.num_columns - 1)
    usable = np.flatnonzero(np.diff(np.asarray(vectors.offsets)) == dimension)
    usable = usable[np.asarray(vectors.is_valid())[usable]]
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    known = ~np.isnan(flat) & np.isfinite(flat)
    starts = np.asarray(vectors.offsets)[usable]
    at = starts[:, None] + np.arange(dimension)
    usable, at = usable[known[at].all(axis=1)], at[known[at].all(axis=1)]
    with np.errstate(over="ignore"):
        x = np.floor(flat[at] * SCALE)
    return usable, np.clip(x, -LARGEST, LARGEST) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            rows, x = _scaled(part, dimension)
            if len(rows):
                yield part, rows, x


def usual_dimension(vectors: DataFrame, vector: str) -> int:
    """The most frequent length of vectors (the largest of several); 0 where there are none."""
    top = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def exact_sums(vectors: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """Number of usable vectors and exact sums of their scaled entries, per dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dimension, object)
        for _, rows, x in _blocks(batches, dimension):
            # 4096 entries of up to 2^52 fit into 64 bits.
            n, total = n + len(rows), total + x.astype(np.int64).sum(axis=0).astype(object)
        if n:
            values = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
            yield pa.record_batch([pa.array(range(dimension), pa.int32()), values, pa.array([n] * dimension, pa.int64())], ["dim", "s", "n"])

    parts = vectors.mapInArrow(add, "dim int, s decimal(38,0), n long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rows = sorted(parts.collect())  # one row a dimension
    return (rows[0]["n"] if rows else 0), [int(r["s"]) for r in rows]


def _exact_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they hold it, else as Python's whole numbers."""
    bound = n * int(np.max(np.abs(x), initial=0)) + max(map(abs, sums))
    kind = np.int64 if bound < 1 << 62 else object
    return x.astype(np.int64).astype(kind) * n - np.array(sums, kind)


def _centred(deviations: np.ndarray, n: int) -> np.ndarray:
    """x - S/n, each entry rounded once."""
    return (deviations / n).astype(np.float64)


def _matrix_sum(df: DataFrame, rows_of: Callable, size: int) -> np.ndarray:
    """Sum over all rows of the outer product of each row that `rows_of` makes of batches with itself, one matrix a task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for rows in rows_of(batches):
            total += rows.T @ rows
        at = np.arange(size)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    # Rows of the matrix are added up by Spark; `posexplode` keeps the sums in the executors.
    parts = df.mapInArrow(add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # size * size numbers
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


class Whitening:
    """A fitted whitening: the exact mean as n and sums, eigenvalues, unit components and the covariance's trace."""

    def __init__(self, dimension: int, n: int, sums: list[int], values: np.ndarray, components: np.ndarray, trace: float):
        self.dimension, self.n, self.sums, self.values, self.components, self.trace = dimension, n, sums, values, components, trace
        # Beneath it an eigenvalue is what rounding leaves of zero.
        self.least = max(dimension, 1) * _EPS * max(float(values[0]) if len(values) else 0.0, 0.0)
        self.real = [e > self.least for e in values]

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows given as n * x - S; NaN along components without variance."""
        root = np.sqrt(np.where(self.real, self.values, np.nan))
        return _centred(deviations, self.n) @ self.components.T / root


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Mean and leading components of the usable vectors: those of the most frequent length without null or non-finite entries."""
    only = embeddings.select(F.col(vector).alias("v"))
    dimension = usual_dimension(only, "v")
    n, sums = exact_sums(only, dimension) if dimension else (0, [])
    if not n:
        return Whitening(dimension, 0, [], np.zeros(0), np.zeros((0, dimension)), 0.0)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, x in _blocks(batches, dimension):
            yield _centred(_exact_deviations(x, n, sums), n)

    covariance = _matrix_sum(only, centred, dimension) / n
    values, vectors = leading_components(covariance, min(components, dimension))
    return Whitening(dimension, n, sums, values, vectors, float(np.trace(covariance)))


def transform(embeddings: DataFrame, fitted: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation, whitened): exact decimal sum of (n x - S)^2, and whitened coordinates, of each usable row."""
    model = embeddings.sparkSession.sparkContext.broadcast(fitted)
    key_type = dict(embeddings.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, rows, x in _blocks(batches, m.dimension):
            d = _exact_deviations(x, m.n, m.sums)
            fits = m.dimension * float(np.max(np.abs(d), initial=0)) ** 2 < 2.0 ** 62
            exact = ((d if fits else d.astype(object)) ** 2).sum(axis=1)
            yield pa.record_batch([
                batch.column(0).take(pa.array(rows)), pa.array([Decimal(int(v)) for v in exact], pa.decimal128(38, 0)),
                pa.array(list(m.project(d)), pa.list_(pa.float64())),
            ], [key, "deviation", "whitened"])

    return embeddings.select(key, vector).mapInArrow(run, f"`{key}` {key_type}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, fitted: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over the components that have variance."""
    real = np.flatnonzero(fitted.real)
    if not len(real):
        return None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(batch.num_rows, -1)[:, real]

    covariance = _matrix_sum(whitened.select("whitened"), rows, len(real)) / fitted.n
    return float(np.max(np.abs(covariance - np.eye(len(real)))))


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component (from 1, by falling eigenvalue): key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, of another than the most frequent length, or holds null or non-finite entries are left
    out; repeated rows and null keys are kept; an empty table, or one without usable vectors, gives no rows. Vectors of fewer
    dimensions have as many components. Along a component without variance (equal vectors, one row, too few dimensions)
    `whitened` is null; `explained` is null where there is no variance at all. Further columns are not read. A `deviation` of
    more than 64 bits is null here; `transform` gives it as a decimal.
    """
    fitted = fit(embeddings, vector, components)
    spark, kind = embeddings.sparkSession, dict(embeddings.dtypes)[key]
    if not fitted.n:
        return spark.createDataFrame(
            [], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = materialize(transform(embeddings, fitted, key, vector), "whitened")
    error = identity_error(rows, fitted)
    shares = [float(e) / fitted.trace if fitted.trace > 0 else None for e in fitted.values]
    explained = F.array(*(F.lit(s).cast("double") for s in shares))
    return rows.select(key, "deviation", F.posexplode("whitened").alias("at", "w")).select(
        key, (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), F.expr("try_cast(deviation AS LONG)").alias("deviation"),
        F.nanvl("w", F.lit(None).cast("double")).alias("whitened"), F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
