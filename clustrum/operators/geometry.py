"""Geometry of a partition: centroids, assignment, similarity, separation and quality scores.

Rows are unit vectors. Everything that looks like an n x n or n x k comparison is written with
per-cluster sums (k rows) or one matrix product per Arrow batch, so each score is one or two passes
over the vectors and shuffles only k partial sums per task.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrum.functions.vectors import (
    stacked_rows, as_vector, centroid_matrix, is_finite, is_unit, nearest_centroid, norm, similarities,
)
from clustrum.operators.cleaning import ContractError
from clustrum.operators.cohorts import fingerprint_columns
from clustrum.operators.ordering import describe
from clustrum.operators.sampling import fixed_sample
from clustrum.operators.tiles import TILE_ROWS, worst_ratios
from clustrum.session import bounded_collect, checked_broadcast, materialize

MAX_CLUSTERS = 100_000
GEOMETRY_FRACTIONS = (0, 0.05, 0.5, 0.95, 1)


def cluster_sums(df: DataFrame, vector: str = "embedding", label: str = "cluster_id") -> DataFrame:
    """Per cluster: row count, vector sum and sum of squared norms. Partial sums, k rows per task."""
    return (
        df.filter(F.col(label) >= 0)
        .withColumn("_v", as_vector(vector))
        .groupBy(F.col(label).alias("cluster_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            vector_to_array(Summarizer.sum(F.col("_v"))).alias("vector_sum"),
            F.sum(F.pow(norm(vector), 2)).alias("square_sum"),
        )
    )


def centroids_of(df: DataFrame, vector: str = "embedding", label: str = "cluster_id", unit: bool = True) -> DataFrame:
    """Mean vector per cluster, scaled to unit length for cosine work."""
    sums = cluster_sums(df, vector, label)
    scale = norm("vector_sum") if unit else F.col("n").cast("double")
    return sums.withColumn("_scale", scale).select(
        "cluster_id", F.transform("vector_sum", lambda x: x / F.col("_scale")).alias("centroid")
    )


def vector_centroid_product(df: DataFrame, centroids: DataFrame, id_column: str, vector: str = "embedding") -> DataFrame:
    """n x k similarities in long form, from one matrix product per batch."""
    matrix = centroid_matrix(centroids)
    return df.select(id_column, F.posexplode(similarities(vector, matrix)).alias("cluster_id", "similarity"))


def assign_clusters(df: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds `cluster_id` of the nearest centroid. Nothing is fitted; dimensions have to agree."""
    return (
        _with_nearest(df, centroids, vector)
        .withColumn("cluster_id", F.col("nearest.cluster_id"))
        .drop("nearest")
    )


def _with_nearest(df: DataFrame, centroids: DataFrame | np.ndarray, vector: str) -> DataFrame:
    matrix = centroids if isinstance(centroids, np.ndarray) else centroid_matrix(centroids)
    checked = F.when(F.size(vector) == matrix.shape[1], F.col(vector)).otherwise(
        F.raise_error(F.lit("embedding dimension differs from the model")).cast(df.schema[vector].dataType)
    )
    return nearest_centroid(df.withColumn(vector, checked), matrix, vector)


def assignment_geometry(df: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds similarity, distance and margin of the assigned (nearest) centroid; clipped to [-1, 1]."""
    clip = lambda c: F.when(c > 1, 1.0).when(c < -1, -1.0).otherwise(c)
    similarity = clip(F.col("nearest.similarity"))
    return _with_nearest(df, centroids, vector).withColumns({
        "cluster_id": F.col("nearest.cluster_id"),
        "assigned_centroid_cosine_similarity": similarity,
        "assigned_centroid_cosine_distance": 1 - similarity,
        "assignment_margin": similarity - clip(F.col("nearest.runner_up")),
    }).drop("nearest")


def check_geometry(df: DataFrame, centroids: DataFrame, vector: str = "embedding", label: str = "cluster_id") -> DataFrame:
    """Refuses vectors or centroids that are not finite unit rows, and labels that are not the argmax."""
    model = centroids.agg(
        F.count(F.lit(1)).alias("k"),
        F.count_if(~is_finite("centroid") | ~is_unit("centroid")).alias("bad"),
    ).first()
    if model.k < 2 or model.bad:
        raise ContractError("centroids have to be two or more finite unit vectors")
    if not isinstance(df.schema[label].dataType.typeName(), str) or df.schema[label].dataType.typeName() not in (
        "integer", "long", "short", "byte"
    ):
        raise ContractError("cluster ids have to be integers")
    rows = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(vector).isNull() | ~is_finite(vector) | ~is_unit(vector)).alias("bad"),
        F.count_if(~F.coalesce(F.col(label).between(0, model.k - 1), F.lit(False))).alias("range"),
    ).first()
    if not rows.n or rows.bad or rows.range:
        raise ContractError(f"invalid geometry: {rows.asDict()}")
    wrong = _with_nearest(df, centroids, vector).filter(F.col("nearest.cluster_id") != F.col(label))
    if wrong.limit(1).count():
        raise ContractError("labels differ from centroid assignments")
    return df


def describe_geometry(df: DataFrame, value: str, n_clusters: int, label: str = "cluster_id") -> DataFrame:
    """Count, mean, deviation, min, p05, median, p95, max per cluster; empty ones are `unavailable`."""
    found = describe(df, value, [label], GEOMETRY_FRACTIONS)
    every = df.sparkSession.range(n_clusters).select(F.col("id").cast("int").alias(label))
    return every.join(found, label, "left").select(
        label,
        F.when(F.col("count").isNull(), "unavailable").otherwise("available").alias("status"),
        F.coalesce("count", F.lit(0)).alias("count"),
        "mean", "std_population", "min", "p05", "median", "p95", "max",
    )


def cluster_geometry(geometry: DataFrame, n_clusters: int) -> DataFrame:
    """Per cluster and measure (similarity, dispersion, margin): share and the figures of `describe_geometry`.

    The three measures are stacked and described in one pass, groups being (measure, cluster).
    """
    measures = {
        "assigned_similarity": "assigned_centroid_cosine_similarity",
        "dispersion": "assigned_centroid_cosine_distance",
        "margin": "assignment_margin",
    }
    stacked = geometry.select(
        "cluster_id",
        F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(c).alias("v")) for m, c in measures.items()))),
    )
    found = describe(stacked, "v", ["measure", "cluster_id"], GEOMETRY_FRACTIONS)
    every = geometry.sparkSession.range(n_clusters).select(
        F.col("id").cast("int").alias("cluster_id"), F.explode(F.array(*map(F.lit, measures))).alias("measure")
    )
    total = found.groupBy("measure").agg(F.sum("count").alias("_total"))
    return every.join(found, ["measure", "cluster_id"], "left").join(F.broadcast(total), "measure").select(
        "measure", "cluster_id", F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / F.col("_total")).alias("proportion"),
        "mean", "std_population", "min", "p05", "median", "p95", "max",
    )


def geometry_summary(geometry: DataFrame) -> DataFrame:
    """The three measures over all rows."""
    stacked = geometry.select(F.inline(F.array(
        F.struct(F.lit("assigned_similarity").alias("measure"), F.col("assigned_centroid_cosine_similarity").alias("v")),
        F.struct(F.lit("dispersion").alias("measure"), F.col("assigned_centroid_cosine_distance").alias("v")),
        F.struct(F.lit("margin").alias("measure"), F.col("assignment_margin").alias("v")),
    )))
    return describe(stacked, "v", ["measure"], GEOMETRY_FRACTIONS).drop("std_sample")


def centroid_separation(centroids: DataFrame) -> DataFrame:
    """Cosine distance of every two centroids, clipped to [0, 2] (k x k model cells, not data pairs)."""
    matrix = centroid_matrix(centroids)
    cells = centroids.select("cluster_id", F.posexplode(similarities("centroid", matrix)).alias("other_id", "s"))
    return cells.select(
        F.col("cluster_id").alias("cluster_a"), F.col("other_id").alias("cluster_b"),
        F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - F.col("s"))).alias("cosine_distance"),
    )


def separation_summary(centroids: DataFrame) -> DataFrame:
    upper = centroid_separation(centroids).filter("cluster_a < cluster_b")
    return describe(upper, "cosine_distance", (), GEOMETRY_FRACTIONS).drop("std_sample")


def cluster_counts(df: DataFrame, n_clusters: int, cohorts: Sequence[str], label: str = "cluster_id", cohort: str = "cohort") -> DataFrame:
    """Zero-filled counts and proportions per cluster for two cohorts, and their difference; those of an empty cohort are null."""
    reference, production = cohorts
    counted = df.groupBy(F.col(label).alias("cluster_id")).agg(
        F.count_if(F.col(cohort) == reference).alias("r"), F.count_if(F.col(cohort) == production).alias("p")
    )
    every = df.sparkSession.range(n_clusters).select(F.col("id").cast("int").alias("cluster_id"))
    full = every.join(counted, "cluster_id", "left").select(
        "cluster_id", F.coalesce("r", F.lit(0)).alias("reference_count"), F.coalesce("p", F.lit(0)).alias("production_count")
    )
    totals = counted.agg(F.sum("r").alias("_r"), F.sum("p").alias("_p"))
    shares = full.join(F.broadcast(totals)).withColumns({
        "reference_proportion": F.try_divide("reference_count", "_r"),
        "production_proportion": F.try_divide("production_count", "_p"),
    })
    return shares.withColumn(
        "proportion_delta", F.col("production_proportion") - F.col("reference_proportion")
    ).drop("_r", "_p")


def partition_summary(df: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Rows, clusters, coverage, noise ratio and the largest share among assigned rows."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    assigned = F.when(F.col(label) >= 0, F.col("n"))
    total, kept = F.sum("n"), F.coalesce(F.sum(assigned), F.lit(0))
    return counted.agg(
        total.alias("n_samples"),
        F.count(assigned).alias("n_clusters"),
        (kept / total).alias("coverage"),
        (1 - kept / total).alias("noise_ratio"),
        (F.max(assigned) / F.sum(assigned)).alias("largest_cluster_ratio"),
    )


def population_balance(df: DataFrame, n_clusters: int, label: str = "cluster_id") -> DataFrame:
    """Represented and empty clusters, largest share, largest-to-smallest non-empty ratio."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = F.array_except(F.sequence(F.lit(0), F.lit(n_clusters - 1)), F.collect_list(F.col(label).cast("int")))
    return counted.agg(
        F.count(F.lit(1)).alias("represented_clusters"),
        F.concat_ws(",", every.cast("array<string>")).alias("empty_cluster_ids"),
        (F.max("n") / F.sum("n")).alias("largest_cluster_proportion"),
        (F.max("n") / F.min("n")).alias("largest_to_smallest_ratio"),
    )


def inertia(df: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Spherical objective: sum of one minus the similarity to the nearest centroid."""
    return _with_nearest(df, centroids, vector).agg(F.sum(1 - F.col("nearest.similarity")).alias("inertia"))


def kmeans_inertia(df: DataFrame, vector: str = "embedding", label: str = "cluster_id") -> DataFrame:
    """Euclidean objective of a given partition: sum of squared distances to the cluster means."""
    sums = cluster_sums(df, vector, label)
    return sums.agg(F.sum(
        F.col("square_sum") - F.pow(norm("vector_sum"), 2) / F.col("n")
    ).alias("inertia"))


def silhouette_cosine(df: DataFrame, vector: str = "embedding", label: str = "cluster_id", groups: Sequence[str] = ()) -> DataFrame:
    """Exact mean cosine silhouette of the assigned rows, null unless 2 <= clusters < rows.

    For unit rows the mean distance to a cluster is `1 - x . S / n` with S its vector sum, so the
    score needs the k sums and one product per row: no pairs of rows are formed. `groups` scores
    several partitions of one table at once (their sums are a model per group: groups x k x d values).
    """
    groups = list(groups)
    assigned = df.filter(F.col(label) >= 0)
    sums = (
        assigned.withColumn("_v", as_vector(vector)).groupBy(*groups, F.col(label).cast("long").alias("_label"))
        .agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col("_v"))).alias("vector_sum"))
    )
    if groups:
        return _silhouette_of_groups(assigned, materialize(sums, "cluster-sums"), vector, label, groups)
    model = {r["_label"]: (r.n, r.vector_sum) for r in bounded_collect(sums, MAX_CLUSTERS, "clusters")}
    labels = np.array(sorted(model))
    counts = np.array([model[x][0] for x in labels], dtype=np.float64)
    table = np.array([model[x][1] for x in labels], dtype=np.float64)
    defined = 2 <= len(labels) < counts.sum()

    @F.arrow_udf("double")
    def silhouette(vectors: pa.Array, given: pa.Array) -> pa.Array:
        return pa.array(_silhouette_scores(stacked_rows(vectors), given.to_numpy(zero_copy_only=False), labels, counts, table))

    score = silhouette(vector, F.col(label).cast("long")) if defined else F.lit(None).cast("double")
    total = assigned.agg(F.count(F.lit(1)).alias("silhouette_n_samples"), F.avg(score).alias("silhouette_cosine"))
    return total.select("silhouette_cosine", "silhouette_n_samples")


def _silhouette_scores(matrix: np.ndarray, given: np.ndarray, labels: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Silhouette of unit rows with labels `given`, from the sums and sizes of at least two clusters (`labels`, ascending)."""
    products = matrix @ sums.T
    own = np.searchsorted(labels, given)
    rows = np.arange(len(given))
    means = 1 - products / counts
    size = counts[own]
    # The own cluster leaves the row itself out; its distance to itself is zero.
    lengths = (matrix * matrix).sum(axis=1)
    inside = (size - 1 - (products[rows, own] - lengths)) / np.maximum(size - 1, 1)
    means[rows, own] = np.inf
    nearest = means.min(axis=1)
    top = np.maximum(inside, nearest)
    return np.where((size > 1) & (top > 0), (nearest - inside) / np.where(top > 0, top, 1), 0.0)


#: Rows of a group that meet its model in one task.
GROUP_ROWS = 100_000


def _silhouette_of_groups(assigned: DataFrame, sums: DataFrame, vector: str, label: str, groups: list[str]) -> DataFrame:
    """`silhouette_cosine` per group: the rows of a group, in parts, meet the sums of its clusters in a cogroup. However many
    groups there are, a task holds one part and one group's model."""
    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}).alias("_key")
    keyed = sums.select(key, "_label", "n", "vector_sum")
    sizes = keyed.groupBy("_key").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"))
    sizes = checked_broadcast(sizes.withColumn("parts", F.ceil(F.col("rows") / GROUP_ROWS).cast("int")))
    model = keyed.join(sizes, "_key").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "_key", "_part", "_label", "n", "vector_sum")
    rows = assigned.select(key, F.col(label).cast("long").alias("_label"), F.col(vector).cast("array<double>").alias("_v")).join(sizes, "_key")
    rows = rows.select("_key", F.pmod(F.xxhash64("_v", "_label"), F.col("parts")).cast("int").alias("_part"), "_label", "_v")

    def score(part: pa.Table, clusters: pa.Table) -> pa.Table:
        total = 0.0
        if part.num_rows and clusters.num_rows > 1:
            clusters = clusters.sort_by("_label")
            known = clusters["_label"].to_numpy(), clusters["n"].to_numpy().astype(np.float64), stacked_rows(clusters["vector_sum"].combine_chunks())
            total = _silhouette_scores(stacked_rows(part["_v"].combine_chunks()), part["_label"].to_numpy(), *known).sum()
        named = part if part.num_rows else clusters
        return pa.table({"_key": named["_key"].slice(0, 1), "total": pa.array([float(total)])})

    scored = rows.groupBy("_key", "_part").cogroup(model.groupBy("_key", "_part")).applyInArrow(score, "_key string, total double")
    names = sums.select(key, *groups).dropDuplicates(["_key"])
    found = scored.groupBy("_key").agg(F.sum("total").alias("total")).join(sizes, "_key").join(checked_broadcast(names), "_key")
    defined = F.col("clusters").between(2, F.col("rows") - 1)
    return found.select(*groups, F.when(defined, F.col("total") / F.col("rows")).alias("silhouette_cosine"), F.col("rows").alias("silhouette_n_samples"))


def davies_bouldin(df: DataFrame, vector: str = "embedding", label: str = "cluster_id", tile: int = TILE_ROWS) -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij, Euclidean, over assigned rows; null unless 2 <= clusters < rows.

    Centroids are compared tile by tile on the executors, however many clusters there are.
    """
    assigned = df.filter(F.col(label) >= 0).select(F.col(label).alias("cluster_id"), F.col(vector).cast("array<double>").alias("_x"))
    means = checked_broadcast(centroids_of(assigned, "_x", "cluster_id", unit=False))
    gap = F.sqrt(F.aggregate(F.zip_with("_x", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x))
    spread = assigned.join(means, "cluster_id").groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("s"), F.first("centroid").alias("v"))
    clusters = materialize(spread.select(F.col("cluster_id").cast("long").alias("row"), "v", "s", "n"), "cluster-spread")
    sizes = clusters.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"))
    worst = worst_ratios(clusters.select("row", "v", "s"), tile).agg(F.avg("worst").alias("worst"))
    return worst.crossJoin(sizes).select(F.when(F.col("k").between(2, F.col("rows") - 1), F.col("worst")).alias("davies_bouldin"))


def box_summary(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Five numbers per group behind a box plot."""
    return describe(df, value, groups, (0, 0.25, 0.5, 0.75, 1)).select(*groups, "count", "min", "p25", "median", "p75", "max")


def held_out_silhouette(
    df: DataFrame, id_column: str, vector: str = "embedding", label: str = "cluster_id", sample_size: int = 0, seed: int = 42
) -> DataFrame:
    """Silhouette of all rows, or of the same seeded sample for every configuration, with a fingerprint of
    the ids used and the reason when the score is undefined."""
    sample = fixed_sample(df.select(id_column, vector, label), id_column, seed, sample_size)
    used = sample.agg(F.count(F.lit(1)).alias("silhouette_n_samples"), *fingerprint_columns([id_column]))
    score = silhouette_cosine(sample, vector, label).select("silhouette_cosine")
    reason = F.when(F.col("silhouette_cosine").isNull(), "needs 2 to n - 1 represented clusters")
    return used.join(F.broadcast(score)).withColumn("undefined_reason", reason)


def evaluate_clustering(
    df: DataFrame, vector: str = "embedding", label: str = "cluster_id",
    id_column: str | None = None, sample_size: int = 0, seed: int = 42,
) -> DataFrame:
    """One row: partition summary, Davies-Bouldin and silhouette of the assigned rows.

    The silhouette is exact by default; with `id_column` and `sample_size` it uses a seeded sample.
    """
    scored = df.filter(F.col(label) >= 0)
    if sample_size and id_column:
        scored = fixed_sample(scored, id_column, seed, sample_size)
    return (
        partition_summary(df, label)
        .join(F.broadcast(davies_bouldin(df, vector, label)))
        .join(F.broadcast(silhouette_cosine(scored, vector, label)))
    )


