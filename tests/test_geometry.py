import math

import numpy as np
import pytest

from clustrum.functions.vectors import nearest_centroid
from clustrum.operators import geometry as g
from clustrum.operators.cleaning import ContractError
from clustrum.operators.models import silhouette_squared_euclidean

POINTS = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [-0.6, 0.8]]
CENTRES = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]


def points(spark, vectors=POINTS, labels=None):
    labels = labels if labels is not None else [0] * len(vectors)
    return spark.createDataFrame(list(enumerate(zip(vectors, labels))), "id int, v struct<embedding: array<double>, cluster_id: int>").select("id", "v.*")


def centres(spark, vectors=CENTRES):
    return spark.createDataFrame(list(enumerate(vectors)), "cluster_id int, centroid array<double>")


def test_small_exact_geometry(spark):
    rows = g.assignment_geometry(points(spark).drop("cluster_id"), centres(spark)).orderBy("id").collect()
    assert [r.cluster_id for r in rows] == [0, 0, 1, 1]
    assert [r.assigned_centroid_cosine_similarity for r in rows] == pytest.approx([1, 0.8, 1, 0.8])
    assert [r.assignment_margin for r in rows] == pytest.approx([1, 0.2, 1, 0.2])
    spread = {(r.cluster_a, r.cluster_b): r.cosine_distance for r in g.centroid_separation(centres(spark)).collect()}
    assert spread[0, 2] == pytest.approx(2) and spread[0, 1] == pytest.approx(1) and spread[1, 1] == pytest.approx(0)
    frame = g.assignment_geometry(points(spark).drop("cluster_id"), centres(spark))
    empty = g.describe_geometry(frame, "assignment_margin", 3).filter("cluster_id = 2").first()
    assert (empty.status, empty["count"], empty["mean"]) == ("unavailable", 0, None)
    balance = g.population_balance(frame, 3).first()
    assert (balance.represented_clusters, balance.empty_cluster_ids, balance.largest_to_smallest_ratio) == (2, "2", 1.0)


def test_ties_go_to_the_lowest_id_and_blocks_agree(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 5))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = np.concatenate([vectors[:7], vectors[:3]])
    rows = points(spark, vectors.tolist())
    one = nearest_centroid(rows, model).orderBy("id").collect()
    many = nearest_centroid(rows, model, block_bytes=3 * 5 * 8).orderBy("id").collect()
    scores = vectors @ model.T
    for r, m, s in zip(one, many, scores):
        order = sorted(range(len(s)), key=lambda i: (-s[i], i))
        assert r.nearest.cluster_id == m.nearest.cluster_id == order[0] or math.isclose(s[order[0]], s[r.nearest.cluster_id])
        assert r.nearest.similarity == pytest.approx(m.nearest.similarity)
        assert r.nearest.runner_up == pytest.approx(m.nearest.runner_up)
        assert r.nearest.cluster_id < 7


def test_single_centroid_has_no_margin(spark):
    row = g.assignment_geometry(points(spark).drop("cluster_id"), centres(spark, CENTRES[:1])).first()
    assert row.assignment_margin is None


@pytest.mark.parametrize("vectors,labels,model", [
    ([[2.0, 0.0]], [0], CENTRES), ([[0.0, 0.0]], [0], CENTRES), ([[float("nan"), 1.0]], [0], CENTRES),
    ([[1.0, 0.0]], [0], [[2.0, 0.0], [0.0, 1.0]]), ([[1.0, 0.0]], [1], CENTRES), ([[1.0, 0.0]], [7], CENTRES),
    ([[1.0, 0.0]], [-1], CENTRES), ([[1.0, 0.0]], [0], [[1.0, 0.0]]), ([], [], CENTRES),
])
def test_invalid_geometry_refused(spark, vectors, labels, model):
    with pytest.raises(ContractError):
        g.check_geometry(points(spark, vectors, labels), centres(spark, model))


def test_labels_have_to_be_integers(spark):
    rows = spark.createDataFrame([([1.0, 0.0], 0.0)], "embedding array<double>, cluster_id double")
    with pytest.raises(ContractError):
        g.check_geometry(rows, centres(spark))


def test_wrong_dimension_stops(spark):
    with pytest.raises(Exception, match="dimension"):
        g.assign_clusters(points(spark, [[1.0, 0.0, 0.0]]), centres(spark)).collect()


def silhouette_by_pairs(vectors, labels, distance):
    scores = []
    for i, own in enumerate(labels):
        means = {}
        for k in set(labels):
            others = [distance(vectors[i], vectors[j]) for j in range(len(labels)) if labels[j] == k and j != i]
            means[k] = np.mean(others) if others else None
        if means[own] is None:
            scores.append(0)
            continue
        a, b = means[own], min(v for k, v in means.items() if k != own)
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_scores_equal_pairwise_definitions(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40, 4)) + np.repeat(rng.normal(size=(4, 4)) * 2, 10, axis=0)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = [0] * 15 + [1] * 14 + [2] * 10 + [3]
    rows = points(spark, vectors.tolist(), labels)
    cosine = silhouette_by_pairs(vectors, labels, lambda a, b: 1 - a @ b)
    assert g.silhouette_cosine(rows).first().silhouette_cosine == pytest.approx(cosine)
    squared = silhouette_by_pairs(vectors, labels, lambda a, b: ((a - b) ** 2).sum())
    assert silhouette_squared_euclidean(rows, "embedding").first()[0] == pytest.approx(squared)
    array, means = np.array(labels), {k: vectors[np.array(labels) == k].mean(axis=0) for k in set(labels)}
    spread = {k: np.linalg.norm(vectors[array == k] - means[k], axis=1).mean() for k in means}
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in means if j != i) for i in means]
    assert g.davies_bouldin(rows).first()[0] == pytest.approx(np.mean(worst))


@pytest.mark.parametrize("labels", [[0, 0, 0, 0], [0, 1, 2, 3], [-1, -1, -1, -1], [-1, -1, 0, 1]])
def test_undefined_scores_are_null(spark, labels):
    row = g.evaluate_clustering(points(spark, POINTS, labels)).collect()
    assert len(row) == 1 and all(r.davies_bouldin is None and r.silhouette_cosine is None for r in row)


def test_partition_summary_with_noise(spark):
    row = g.partition_summary(points(spark, POINTS, [-1, 0, 0, 2])).first()
    assert (row.n_samples, row.n_clusters, row.coverage, row.noise_ratio) == (4, 2, 0.75, 0.25)
    assert row.largest_cluster_ratio == pytest.approx(2 / 3)


def test_model_size_is_checked(spark):
    from clustrum.functions.vectors import centroid_matrix

    with pytest.raises(ValueError):
        centroid_matrix(centres(spark), max_bytes=16)
    with pytest.raises(ValueError):
        centroid_matrix(centres(spark).filter("cluster_id > 0"))


def test_held_out_sample_is_shared_and_explained(spark):
    rows = points(spark, POINTS * 5, [0, 1, 1, 0] * 5)
    one = g.held_out_silhouette(rows, "id", sample_size=9).first()
    two = g.held_out_silhouette(rows.withColumn("cluster_id", 1 - rows.cluster_id).repartition(3), "id", sample_size=9).first()
    assert one.silhouette_n_samples == 9 and one.fingerprint == two.fingerprint and one.undefined_reason is None
    undefined = g.held_out_silhouette(points(spark), "id").first()
    assert undefined.silhouette_cosine is None and "represented" in undefined.undefined_reason
