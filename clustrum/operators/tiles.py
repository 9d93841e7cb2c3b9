"""Sums over all pairs of rows, tile by tile: blocks of rows meet in tasks, and no pair leaves its task."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.functions.vectors import stacked_rows
from clustrum.operators.sampling import fixed_sample
from clustrum.session import checked_broadcast, materialize

#: Rows of one side of a tile, and how many of them are compared at a time.
TILE_ROWS, STRIP_ROWS = 4096, 512


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of `a` to all of `b`; those that a matrix product would blur are taken from differences."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
    found = squares - 2 * (a @ b.T)
    i, j = np.nonzero(found <= 1e-6 * squares)
    for at in np.array_split(np.arange(len(i)), max(1, len(i) * a.shape[1] // (1 << 22))):
        found[i[at], j[at]] = ((a[i[at]] - b[j[at]]) ** 2).sum(axis=1)
    return np.sqrt(found)


def tile_pairs(rows: DataFrame, blocks: int) -> DataFrame:
    """(low, high, block, ...): every row once for each pair of its block with another, or with itself; low <= high."""
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("other", other)
    return met.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), *[c for c in met.columns if c != "other"])


def distance_sums(rows: DataFrame, tile: int = TILE_ROWS) -> DataFrame:
    """(row, label, cluster, total): of each row the sum of its distances to the rows of every cluster, itself included.

    `rows`: row (unique), label, v. Each pair of rows is compared in one task, for both of its rows.
    """
    blocks = max(1, -(-rows.count() // tile))

    def compare(pair: pa.Table) -> pa.Table:
        blocks_of = pair["block"].to_numpy()
        sides = [pair.filter(pa.array(blocks_of == b)).combine_chunks() for b in dict.fromkeys((pair["low"][0].as_py(), pair["high"][0].as_py()))]
        if any(s.num_rows == 0 for s in sides):
            return empty
        vectors = [stacked_rows(s["v"].combine_chunks()) for s in sides]
        known = [np.unique(s["label"].to_numpy(), return_inverse=True) for s in sides]
        member = [np.eye(len(labels))[at] for labels, at in known]
        totals = [np.zeros((len(vectors[0]), len(known[-1][0]))), np.zeros((len(vectors[-1]), len(known[0][0])))]
        for start in range(0, len(vectors[0]), STRIP_ROWS):
            strip = slice(start, start + STRIP_ROWS)
            d = distances(vectors[0][strip], vectors[-1])
            totals[0][strip] = d @ member[-1]
            totals[1] += d.T @ member[0][strip]
        out = []
        for side, (labels, _), total in zip(sides, known[::-1], totals):
            n, k = total.shape
            out.append(pa.table({
                "row": side["row"].take(pa.array(np.repeat(np.arange(n), k))), "label": side["label"].take(pa.array(np.repeat(np.arange(n), k))),
                "cluster": pa.array(np.tile(labels, n)), "total": pa.array(total.ravel())}))
        return pa.concat_tables(out)

    empty = pa.table({"row": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "cluster": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
    sums = tile_pairs(rows, blocks).groupBy("low", "high").applyInArrow(compare, "row long, label long, cluster long, total double")
    return sums.groupBy("row", "label", "cluster").agg(F.sum("total").alias("total"))


def worst_ratios(clusters: DataFrame, tile: int = TILE_ROWS) -> DataFrame:
    """(row, worst): of each cluster the largest (s_i + s_j) / d_ij over all others, d the distance of their centres; 0 for equal centres.

    `clusters`: row (unique), v (centre), s. Tiles of centres meet in tasks; no table of all pairs is formed anywhere.
    """
    blocks = max(1, -(-clusters.count() // tile))

    def compare(pair: pa.Table) -> pa.Table:
        blocks_of = pair["block"].to_numpy()
        sides = [pair.filter(pa.array(blocks_of == b)).combine_chunks() for b in dict.fromkeys((pair["low"][0].as_py(), pair["high"][0].as_py()))]
        if any(s.num_rows == 0 for s in sides):
            return empty
        vectors, spread = ([f(s) for s in sides] for f in (lambda s: stacked_rows(s["v"].combine_chunks()), lambda s: s["s"].to_numpy()))
        worst = [np.full(s.num_rows, -np.inf) for s in sides]
        for start in range(0, len(vectors[0]), STRIP_ROWS):
            strip = slice(start, start + STRIP_ROWS)
            d = distances(vectors[0][strip], vectors[-1])
            ratio = (spread[0][strip][:, None] + spread[-1]) / np.where(d == 0, np.inf, d)
            if len(sides) == 1:
                at = np.arange(len(ratio))
                ratio[at, at + start] = -np.inf
            worst[0][strip] = np.maximum(worst[0][strip], ratio.max(axis=1))
            worst[-1] = np.maximum(worst[-1], ratio.max(axis=0))
        return pa.concat_tables([pa.table({"row": s["row"], "worst": pa.array(w)}) for s, w in zip(sides, worst)])

    empty = pa.table({"row": pa.array([], pa.int64()), "worst": pa.array([], pa.float64())})
    return tile_pairs(clusters, blocks).groupBy("low", "high").applyInArrow(compare, "row long, worst double").groupBy("row").agg(F.max("worst").alias("worst"))


def silhouette_euclidean(
    df: DataFrame, id_column: str, vector: str, label: str = "cluster_id", sample_rows: int | None = None, seed: int = 42, tile: int = TILE_ROWS,
) -> DataFrame:
    """One row: exact mean silhouette under Euclidean distance, over all assigned rows or a seeded sample of them, and its rows.

    A row alone in its cluster scores 0. Null unless there are at least two clusters and fewer than rows. The cost grows with
    the square of the rows; a task holds one tile. Null and negative labels and null vectors are left out.
    """
    assigned = df.where((F.col(label) >= 0) & F.col(vector).isNotNull()).select(
        F.col(id_column), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    if sample_rows is not None:
        assigned = fixed_sample(assigned, id_column, seed, sample_rows)
    # Written out, so that a row's number stays what it is.
    rows = materialize(assigned.select(F.monotonically_increasing_id().alias("row"), "label", "v"), "silhouette-rows")
    sizes = rows.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    sums = distance_sums(rows, tile).join(checked_broadcast(sizes), "cluster")
    own = F.col("cluster") == F.col("label")
    scored = sums.groupBy("row").agg(
        F.max(F.when(own, F.col("size"))).alias("size"), F.max(F.when(own, F.col("total") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    top = F.greatest("a", "b")
    score = F.when((F.col("size") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    clusters = sizes.agg(F.count(F.lit(1)).alias("clusters"))
    means = scored.agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("silhouette_n_samples"))
    defined = F.col("clusters").between(2, F.col("silhouette_n_samples") - 1)
    return means.crossJoin(clusters).select(F.when(defined, F.col("mean")).alias("silhouette_euclidean"), "silhouette_n_samples")
