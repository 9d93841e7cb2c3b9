"""Vector expressions on `array<float>` columns and the blocked centroid product."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector

from clustrum.session import materialize

UNIT_TOLERANCE = 1e-5
# A centroid block travels to every Python worker; larger matrices are folded in block by block.
CENTROID_BLOCK_BYTES = 64 << 20

NEAREST_TYPE = "struct<cluster_id:int,similarity:double,runner_up:double>"


def as_doubles(vector: Column | str) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    return column.cast("array<double>")


def as_vector(vector: Column | str) -> Column:
    return array_to_vector(as_doubles(vector))


def norm(vector: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def is_finite(vector: Column | str) -> Column:
    infinity = F.lit(float("inf"))
    return F.forall(
        as_doubles(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity)
    )


def is_unit(vector: Column | str) -> Column:
    return F.abs(norm(vector) - 1) <= UNIT_TOLERANCE


def stacked_rows(vectors: pa.Array) -> np.ndarray:
    """A batch of vectors as one matrix; they all need the same, nonzero length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or not (lengths > 0).all() or len(set(lengths.tolist())) > 1:
        raise ValueError("vectors must be finite and nonzero, of one length")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), -1)


def listed_rows(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def similarities(vector: Column | str, centroids: np.ndarray) -> Column:
    """Dot product with every centroid, as one array per row (n x k values, no join)."""

    @F.arrow_udf("array<double>")
    def product(vectors: pa.Array) -> pa.Array:
        return listed_rows(stacked_rows(vectors) @ centroids.T)

    return product.asNondeterministic()(vector)  # evaluated once, whatever is filtered or exploded later


def _fold_block(vector: Column | str, block: np.ndarray, first_id: int, state: Column | None) -> Column:
    """Best and second-best centroid so far; an equal score keeps the lower id."""

    def best_two(vectors: pa.Array, label, top, second):
        scores = stacked_rows(vectors) @ block.T
        rows = np.arange(len(scores))
        best = scores.argmax(axis=1)
        value = scores[rows, best]
        scores[rows, best] = -np.inf
        runner = scores.max(axis=1) if block.shape[0] > 1 else np.full(len(scores), -np.inf)
        best = best + first_id
        if label is not None:
            kept = top >= value
            runner = np.where(kept, np.maximum(second, value), np.maximum(top, runner))
            best, value = np.where(kept, label, best), np.where(kept, top, value)
        return pa.StructArray.from_arrays(
            [pa.array(best.astype(np.int32)), pa.array(value),
             pa.array(runner, mask=np.isneginf(runner))],
            names=["cluster_id", "similarity", "runner_up"],
        )

    if state is None:
        @F.arrow_udf(NEAREST_TYPE)
        def first(vectors: pa.Array) -> pa.Array:
            return best_two(vectors, None, None, None)

        return first.asNondeterministic()(vector)

    @F.arrow_udf(NEAREST_TYPE)
    def following(vectors: pa.Array, label: pa.Array, top: pa.Array, second: pa.Array) -> pa.Array:
        second = second.to_numpy(zero_copy_only=False)
        return best_two(
            vectors, label.to_numpy(zero_copy_only=False), top.to_numpy(zero_copy_only=False),
            np.where(np.isnan(second), -np.inf, second),
        )

    return following.asNondeterministic()(vector, state["cluster_id"], state["similarity"], state["runner_up"])


def nearest_centroid(
    df: DataFrame, centroids: np.ndarray, vector: str = "embedding", block_bytes: int = CENTROID_BLOCK_BYTES
) -> DataFrame:
    """Adds `nearest`: highest dot product, its centroid id and the second-highest product.

    Map-only. One block of centroids serves any usual model; a matrix beyond `block_bytes` is
    folded in one bounded block after the other, with the running best two written in between.
    """
    centroids = np.asarray(centroids, dtype=np.float64)
    blocks = min(len(centroids), math.ceil(centroids.nbytes / block_bytes))
    first_id, state = 0, None
    for number, block in enumerate(np.array_split(centroids, blocks)):
        df = df.withColumn("nearest", _fold_block(vector, block, first_id, state))
        first_id += len(block)
        state = F.col("nearest")
        if number + 1 < blocks:
            df = materialize(df, "nearest-block")
    return df


def centroid_matrix(centroids: DataFrame, vector: str = "centroid", max_bytes: int = 2 << 30) -> np.ndarray:
    """Centroids in id order as one matrix; ids have to be 0..k-1. A model, not data: size checked first."""
    size = centroids.agg(
        F.count(F.lit(1)).alias("k"), F.max(F.size(vector)).alias("d"),
        F.min("cluster_id").alias("low"), F.max("cluster_id").alias("high"),
        F.count_distinct("cluster_id").alias("ids"),
    ).first()
    if not size.k or (size.low, size.high, size.ids) != (0, size.k - 1, size.k):
        raise ValueError("centroid ids have to be 0..k-1")
    if size.k * size.d * 8 > max_bytes:
        raise ValueError("centroid matrix beyond what a driver may hold")
    rows = centroids.select("cluster_id", vector).orderBy("cluster_id").collect()
    return np.array([r[vector] for r in rows], dtype=np.float64)
