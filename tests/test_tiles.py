"""Exact Euclidean silhouette, tile by tile, against its definition over all pairs."""
import numpy as np
import pytest

from clustrum.operators import tiles


def plain(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {own})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


def frame(spark, x, labels):
    rows = [(i, [float(c) for c in v], int(k), 0.5) for i, (v, k) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id int, v array<double>, cluster_id int, total double").repartition(3)


@pytest.mark.parametrize("tile", [1000, 37, 5])
def test_equals_the_definition(spark, tile):
    rng = np.random.default_rng(1)
    labels = np.concatenate([rng.integers(0, 4, 90), [7], [-1] * 5])
    x = rng.normal(size=(96, 3)) + np.maximum(labels, 0)[:, None]
    x[:10] = x[10:20]
    out = tiles.silhouette_euclidean(frame(spark, x, labels), "id", "v", tile=tile).first()
    assert out.silhouette_n_samples == 91 and out.silhouette_euclidean == pytest.approx(plain(x[:91], labels[:91]), abs=1e-12)


def test_near_rows_far_from_the_origin_keep_their_distance():
    a = np.array([[1e6, 1e6], [1e6 + 1e-3, 1e6], [0.0, 0.0]])
    assert tiles.distances(a, a)[0].tolist() == pytest.approx([0.0, a[1, 0] - a[0, 0], np.hypot(1e6, 1e6)], rel=1e-12)


def test_undefined_cases(spark):
    x = np.arange(8.0).reshape(4, 2)
    for labels, n in (([1, 1, 1, 1], 4), ([0, 1, 2, 3], 4), ([-1] * 4, 0)):
        out = tiles.silhouette_euclidean(frame(spark, x, labels), "id", "v").first()
        assert out.silhouette_euclidean is None and out.silhouette_n_samples == n
    assert tiles.silhouette_euclidean(frame(spark, x, [0, 0, 1, 1]).limit(0), "id", "v").first().silhouette_euclidean is None
    same = tiles.silhouette_euclidean(frame(spark, np.ones((4, 2)), [0, 0, 1, 1]), "id", "v").first()
    assert same.silhouette_euclidean == 0.0


def test_each_pair_of_blocks_is_one_tile(spark):
    rows = spark.range(200).selectExpr("id AS row", "0 AS label", "array(1.0) AS v")
    met = tiles.tile_pairs(rows, 4)
    assert met.count() == 800 and met.select("low", "high").distinct().count() == 10 and met.where("low > high").isEmpty()


def davies(x, labels):
    known = sorted(set(labels))
    means = np.stack([x[labels == k].mean(0) for k in known])
    s = np.array([np.linalg.norm(x[labels == k] - m, axis=1).mean() for k, m in zip(known, means)])
    worst = []
    for i in range(len(known)):
        gaps = [(s[i] + s[j]) / g for j in range(len(known)) if j != i and (g := np.linalg.norm(means[i] - means[j])) > 0]
        worst.append(max(gaps, default=0.0))
    return float(np.mean(worst))


@pytest.mark.parametrize("tile", [4096, 7, 2])
def test_davies_bouldin_by_tiles_equals_all_pairs(spark, tile):
    from clustrum.operators.geometry import davies_bouldin

    rng = np.random.default_rng(9)
    labels = rng.integers(0, 25, 400)
    x = rng.normal(size=(400, 3)) + labels[:, None] % 7
    x[labels == 3], x[labels == 4] = 1.0, 1.0
    out = davies_bouldin(frame(spark, x, labels), "v", tile=tile).first()
    assert out.davies_bouldin == pytest.approx(davies(x, labels), rel=1e-9)
    for few in ([1] * 400, [-1] * 400):
        assert davies_bouldin(frame(spark, x, few), "v").first().davies_bouldin is None


def test_silhouettes_of_many_groups_equal_those_of_each(spark, monkeypatch):
    from pyspark.sql import functions as F

    from clustrum.operators import geometry

    monkeypatch.setattr(geometry, "GROUP_ROWS", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in v], int(rng.integers(0, 4)) if i % 60 else 0, i % 6, None if i % 6 == 5 else "m") for i, v in enumerate(x)]
    rows = [(i, v, 2 if g == 4 else k, g, m) for i, v, k, g, m in rows]
    df = spark.createDataFrame(rows, "id int, v array<double>, cluster_id int, seed int, method string")
    found = {(r.seed, r.method): r for r in geometry.silhouette_cosine(df, "v", groups=["seed", "method"]).collect()}
    assert set(found) == {(g, None if g == 5 else "m") for g in range(6)} and found[4, "m"].silhouette_cosine is None
    for (seed, method), r in found.items():
        one = geometry.silhouette_cosine(df.where(F.col("seed") == seed), "v").first()
        assert r.silhouette_n_samples == one.silhouette_n_samples == 40
        assert r.silhouette_cosine == (None if one.silhouette_cosine is None else pytest.approx(one.silhouette_cosine, abs=1e-12))
