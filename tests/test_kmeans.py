"""Own Lloyd iterations: fixed points, empty clusters, repeated rows, equal results for equal seeds."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrum.operators import kmeans, models


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(rows)], "id int, embedding array<double>").repartition(parts)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("spherical", [False, True])
def test_centroids_are_a_fixed_point(spark, spherical):
    x = np.random.default_rng(2).normal(size=(200, 4)) + 0.5
    centers, cost, taken = kmeans.fit(frame(spark, x), 6, 3, 100, 7, 1e-9, spherical)
    y = unit(x) if spherical else x
    distance = 1 - y @ centers.T if spherical else ((y[:, None] - centers[None]) ** 2).sum(-1)
    labels = distance.argmin(1)
    means = np.stack([y[labels == k].mean(0) for k in range(6)])
    assert np.allclose(centers, unit(means) if spherical else means, atol=1e-7) and taken < 100
    assert cost == pytest.approx(distance.min(1).sum())


def plain_lloyd(x, centers, steps):
    for _ in range(steps):
        labels = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
        centers = np.stack([x[labels == k].mean(0) if (labels == k).any() else c for k, c in enumerate(centers)])
    return centers


def test_given_starts_follow_plain_iterations_whatever_the_partitions(spark):
    x = np.random.default_rng(3).normal(size=(150, 3))
    start = x[:5]
    for steps in (1, 4):
        for parts in (1, 6):
            centers, _, taken = kmeans.fit(frame(spark, x, parts), 5, 1, steps, 1, 0.0, False, initial=start)
            assert np.allclose(centers, plain_lloyd(x, start, steps)) and taken == steps


def test_equal_seeds_give_equal_starts_and_others_differ(spark):
    x = np.random.default_rng(4).normal(size=(120, 2))
    vectors = lambda parts: frame(spark, x, parts).select(F.col("embedding").alias("v"), F.xxhash64("embedding").alias("hash"))
    a, b, c = (kmeans.plus_plus_starts(vectors(p), 4, 2, seed, False) for p, seed in ((1, 1), (5, 1), (5, 2)))
    assert np.array_equal(a, b) and not np.array_equal(a, c) and not np.array_equal(a[0], a[1])
    assert all(any(np.array_equal(p, row) for row in x) for p in a.reshape(-1, 2)) and len({tuple(p) for p in a[0]}) == 4


def test_plus_plus_draws_by_squared_distance(spark):
    # One row far away: it is the second centroid nearly always, though it is one of 200.
    x = np.concatenate([np.random.default_rng(5).normal(0, 0.01, (199, 1)), [[50.0]]])
    vectors = frame(spark, x).select(F.col("embedding").alias("v"), F.xxhash64("embedding").alias("hash"))
    starts = kmeans.plus_plus_starts(vectors, 2, 40, 9, False)
    assert (starts.max(axis=(1, 2)) == 50.0).all()
    # The first one is drawn evenly.
    assert 0.1 < (starts[:, 0, 0] > 0).mean() < 0.9


def test_empty_clusters_take_the_farthest_rows(spark):
    x = np.array([[0.0, 0], [0, 1], [1, 0], [40, 0], [0, 41], [42, 42]])
    # All of four starts but one lie where no row is nearest.
    start = np.array([[0.3, 0.3], [900, 900], [901, 901], [902, 900]])
    centers, cost, _ = kmeans.fit(frame(spark, x), 4, 1, 20, 1, 1e-9, False, initial=start)
    assert sorted(map(tuple, centers.round(6))) == sorted([(0, 41), (round(1 / 3, 6), round(1 / 3, 6)), (40, 0), (42, 42)])
    assert cost == pytest.approx(((x[:3] - 1 / 3) ** 2).sum())


@pytest.mark.parametrize("method", models.METHODS)
def test_always_k_centroids_on_repeated_rows(spark, method):
    rows = [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 3 + [[0.6, 0.8]]
    centroids, labelled, cost = models.fit_and_assign(frame(spark, rows), method, n_clusters=6, n_init=2, max_iter=10)
    assert centroids.count() == 6 and cost == pytest.approx(0, abs=1e-12)
    groups = labelled.groupBy("embedding").agg(F.count_distinct("cluster_id").alias("n"), F.first("cluster_id").alias("c")).collect()
    assert [r.n for r in groups] == [1, 1, 1] and len({r.c for r in groups}) == 3
    equal, _, _ = models.fit_and_assign(frame(spark, [[3.0, 4.0]] * 7), method, n_clusters=7, n_init=1, max_iter=3)
    assert equal.count() == 7


def test_zero_vectors_have_no_direction(spark):
    with pytest.raises(Exception, match="no direction"):
        kmeans.fit(frame(spark, [[0.0, 0.0], [1.0, 0.0]]), 1, 1, 2, 1, 0.0, True)


def test_seeds_fitted_together_are_fitted_as_alone(spark):
    # Far starts leave clusters empty: each fit draws its far rows as it would alone.
    x = np.random.default_rng(12).normal(size=(300, 3)) + np.repeat(np.eye(3) * 9, 100, axis=0)
    for spherical in (False, True):
        together = kmeans.fit_seeds(frame(spark, x), 7, 2, 12, [5, 6, 9], 1e-9, spherical)
        for seed, (centers, cost, taken) in zip([5, 6, 9], together):
            alone = kmeans.fit(frame(spark, x), 7, 2, 12, seed, 1e-9, spherical)
            assert np.allclose(centers, alone[0]) and cost == pytest.approx(alone[1]) and taken == alone[2]
    start = np.concatenate([x[:2], np.full((2, 3), 50.0)])
    one, other = kmeans.fit_seeds(frame(spark, x), 4, 1, 3, [1, 2], 0.0, False, initial=start)
    assert np.allclose(one[0], other[0]) and np.allclose(one[0], kmeans.fit(frame(spark, x), 4, 1, 3, 1, 0.0, False, initial=start)[0])
    assert kmeans.fit_seeds(frame(spark, x), 4, 1, 3, [], 0.0, False) == []
