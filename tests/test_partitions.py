import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from clustrum.operators import partitions as p


def ari_by_pairs(a, b):
    """Hubert and Arabie over all pairs of rows."""
    pairs = list(itertools.combinations(range(len(a)), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    left = sum(a[i] == a[j] for i, j in pairs)
    right = sum(b[i] == b[j] for i, j in pairs)
    expected, top = left * right / len(pairs), (left + right) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


def compare(spark, a, b):
    rows = spark.createDataFrame(list(zip(a, b)), "a int, b int")
    return p.compare_partitions(rows, "a", "b").first()


def test_ari_equals_pair_counting_and_is_symmetric(spark):
    rng = random.Random(4)
    a = [rng.randrange(-1, 3) for _ in range(60)]
    b = [x if rng.random() < 0.6 else rng.randrange(-1, 4) for x in a]
    forward, backward = compare(spark, a, b), compare(spark, b, a)
    assert forward.ari == pytest.approx(ari_by_pairs(a, b)) == pytest.approx(backward.ari)
    kept = [(x, y) for x, y in zip(a, b) if x >= 0 and y >= 0]
    assert forward.ari_assigned_only == pytest.approx(ari_by_pairs(*zip(*kept)))
    assert (forward.n_common, forward.n_common_assigned) == (60, len(kept))


@pytest.mark.parametrize("a,b,ari,assigned", [
    ([0, 0, 0], [1, 1, 1], 1.0, 1.0), ([0, 1, 2], [2, 0, 1], 1.0, 1.0), ([0], [0], None, None), ([-1, -1], [-1, -1], 1.0, None),
])
def test_ari_edges(spark, a, b, ari, assigned):
    row = compare(spark, a, b)
    assert (row.ari, row.ari_assigned_only) == (ari, assigned)


def labels(spark, broken=()):
    rng = random.Random(1)
    rows = []
    for encoder, method, seed in itertools.product(("e1", "e2"), ("kmeans", "spherical_kmeans"), range(42, 47)):
        if (encoder, method, seed) not in broken:
            rows += [(encoder, method, seed, i, rng.randrange(3)) for i in range(12)]
    return rows, spark.createDataFrame(rows, "encoder string, method string, seed int, id int, label int")


def test_full_sweep_has_ten_pairs_per_configuration(spark):
    rows, frame = labels(spark)
    pairs = p.pairwise_ari(frame, ["encoder", "method"], "id").cache()
    assert pairs.count() == 40
    by_run = {}
    for e, m, s, i, x in rows:
        by_run.setdefault((e, m, s), []).append(x)
    for r in pairs.collect():
        assert r.ari == pytest.approx(ari_by_pairs(by_run[r.encoder, r.method, r.seed_a], by_run[r.encoder, r.method, r.seed_b]))
    expected = p.pairwise_runs(frame, ["encoder", "method"]).select("encoder", "method", "seed_a", "seed_b")
    assert expected.exceptAll(pairs.select("encoder", "method", "seed_a", "seed_b")).count() == 0 and expected.count() == 40
    peers = p.peer_ari(pairs, ["encoder", "method"]).collect()
    assert len(peers) == 20 and all(r.ari_pairs == 4 for r in peers)


def test_aggregate_marks_undefined_scores_and_picks_the_winner(spark):
    _, frame = labels(spark)
    pairs = p.pairwise_ari(frame, ["encoder", "method"], "id")
    runs = frame.select("encoder", "method", "seed").distinct().withColumn(
        "silhouette",
        F.when((F.col("encoder") == "e1") & (F.col("method") == "kmeans") & (F.col("seed") == 43), None)
        .when((F.col("encoder") == "e2") & (F.col("method") == "kmeans") & (F.col("seed") == 43), float("nan"))
        .when(F.col("encoder") == "e2", 0.5).otherwise(0.25 + F.col("seed") / 1000))
    out = p.sweep_aggregate(runs, pairs, ["encoder", "method"]).cache()
    found = {(r.encoder, r.method): r for r in out.collect()}
    assert not found["e1", "kmeans"].eligible and found["e1", "kmeans"].silhouette_mean is None
    assert not found["e2", "kmeans"].eligible and found["e2", "kmeans"].valid_silhouettes == 4
    assert found["e1", "spherical_kmeans"].silhouette_std == pytest.approx(math.sqrt(2.5) / 1000)
    winner = p.select_winner(out, runs, 42).collect()
    assert [(r.encoder, r.method, r.seed) for r in winner] == [("e2", "spherical_kmeans", 42)]


def test_incomplete_and_unexpected_sweeps_are_found(spark):
    grid = p.grid_of(spark, {"encoder": ["e1", "e2"], "method": ["kmeans", "spherical_kmeans"], "seed": list(range(42, 47))})
    assert grid.count() == 20
    found = grid.filter("not (encoder = 'e1' and seed = 44)").union(spark.createDataFrame([("e9", "kmeans", 42)], grid.schema))
    problems = p.missing_configurations(grid, found, grid.columns).collect()
    assert sorted((r.problem, r.encoder, r.method, r.seed) for r in problems) == [
        ("missing", "e1", "kmeans", 44), ("missing", "e1", "spherical_kmeans", 44), ("unexpected", "e9", "kmeans", 42)]


def test_samples_have_to_agree(spark):
    rows = spark.createDataFrame([("a", "h"), ("a", "g")], "observation_ids string, sample_hash string")
    with pytest.raises(ValueError):
        p.check_same_sample(rows)
    p.check_same_sample(rows.limit(1))


def test_ranking_breaks_ties_by_name_and_excludes_undefined(spark):
    rows = spark.createDataFrame(
        [("spherical_kmeans", 0.3), ("kmeans", 0.3), ("other", None), ("odd", float("nan")), ("far", float("inf"))],
        "method string, silhouette_cosine double")
    out = {r.method: r for r in p.rank_models(rows).collect()}
    assert (out["kmeans"]["rank"], out["spherical_kmeans"]["rank"]) == (1, 2)
    assert all(out[m].excluded and out[m]["rank"] is None for m in ("other", "odd", "far"))
    low = rows.withColumn("davies_bouldin", F.when(F.col("method") == "other", 1.0).otherwise(2.0))
    assert p.rank_models(low, "davies_bouldin", "minimize").filter("rank = 1").first().method == "other"
    with pytest.raises(ValueError):
        p.rank_models(rows, direction="sideways")


def test_newest_finished_run_wins(spark):
    rows = spark.createDataFrame(
        [("c", 1, "r1", "FINISHED"), ("c", 3, "r3", "FAILED"), ("c", 2, "r2", "FINISHED"), ("c", 2, "r0", "FINISHED")],
        "logical_id string, started int, run_id string, status string")
    out = p.newest_run(rows, ["logical_id"], "started", "run_id", F.col("status") == "FINISHED").collect()
    assert [r.run_id for r in out] == ["r0"]


def test_compare_runs_needs_equal_identity(spark):
    schema = "key string, config string, n int, silhouette_cosine double"
    old = spark.createDataFrame([("a", "x", 1, 0.1), ("b", "x", 1, 0.1), ("c", "x", 1, None)], schema)
    new = spark.createDataFrame([("a", "x", 1, 0.3), ("b", "y", 1, 0.3), ("c", "x", 1, 0.3), ("d", "x", 1, 0.3)], schema)
    out = {r.key: r for r in p.compare_runs(old, new, "key", ["config", "n"]).collect()}
    assert {k: r.status for k, r in out.items()} == {"a": "available", "b": "incompatible", "c": "unavailable", "d": "unavailable"}
    assert out["a"].difference == pytest.approx(0.2) and out["c"].difference is None
