import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from clustrum.operators import drift
from clustrum.operators.profile import kendall_correlation, normality_summary, pearson_correlation, qq_points
from clustrum.functions.special import incomplete_beta


def histogram(spark, a, b, feature="f"):
    rows = [("r", feature, float(x)) for x in a] + [("p", feature, float(x)) for x in b]
    return drift.pooled_histogram(spark.createDataFrame(rows, "cohort string, feature string, value double"), "r", "p")


def ks(a, b):
    support = np.union1d(a, b)
    return max(abs(np.mean(np.array(a) <= v) - np.mean(np.array(b) <= v)) for v in support)


@pytest.mark.parametrize("a,b", [([2, 3, 3, 7], [3, 8, 9]), ([1, 1, 4], [4, 4, 6, 6, 9]), ([0.5], [0.25, 0.75, 2.0]), ([6, 6], [6, 6, 6])])
def test_permutation_p_of_small_samples_equals_the_count_of_all_splits(spark, a, b):
    pooled, observed = [*a, *b], ks(a, b)
    splits = list(itertools.combinations(range(len(pooled)), len(a)))
    hits = sum(ks([pooled[i] for i in s], [x for i, x in enumerate(pooled) if i not in s]) >= observed - 1e-12 for s in splits)
    exact, draws = hits / len(splits), 4000
    found = drift.permutation_ks(histogram(spark, a, b), draws).first()
    assert found.statistic == pytest.approx(observed)
    assert abs(found.p_value - (exact * draws + 1) / (draws + 1)) <= 4 * np.sqrt(exact * (1 - exact) / draws) + 1e-12


def test_distances_equal_definitions(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 30, 80), rng.integers(5, 40, 50)
    row = drift.distribution_distances(drift.with_running_counts(histogram(spark, a, b))).first()
    assert row.ks_statistic == pytest.approx(ks(a, b))
    grid = np.arange(0, 41)
    area = sum(abs(np.mean(a <= v) - np.mean(b <= v)) for v in grid)
    assert row.wasserstein == pytest.approx(area)
    zero = drift.distribution_distances(drift.with_running_counts(histogram(spark, a, a))).first()
    assert zero.ks_statistic == 0 and zero.wasserstein == 0


def test_permutation_matches_row_shuffling_in_one_and_many_blocks(spark):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 60, 120), rng.integers(4, 64, 90)
    pooled, observed = np.concatenate([a, b]), ks(a, b)
    hits = 0
    for _ in range(1500):
        rng.shuffle(pooled)
        hits += ks(pooled[:120], pooled[120:]) >= observed - 1e-12
    expected = (hits + 1) / 1501
    tolerance = 4 * np.sqrt(expected * (1 - expected) / 1500) + 0.005
    frame = drift.with_running_counts(histogram(spark, a, b))
    whole = drift.permutation_test(frame, drift.KOLMOGOROV_SMIRNOV, 1500, 7).first()
    split = drift.permutation_test(frame, drift.KOLMOGOROV_SMIRNOV, 1500, 7, cells_per_block=9).first()
    assert whole.statistic == pytest.approx(observed) == pytest.approx(split.statistic)
    assert abs(whole.p_value - expected) < tolerance and abs(split.p_value - expected) < tolerance


def test_permutation_p_is_repeatable_and_uniform_under_the_null(spark):
    rng = np.random.default_rng(9)
    rows = []
    for f in range(60):
        values = rng.normal(size=60).round(3)
        rows += [("r" if i < 30 else "p", f"f{f}", float(v)) for i, v in enumerate(values)]
    stacked = spark.createDataFrame(rows, "cohort string, feature string, value double")
    frame = drift.pooled_histogram(stacked, "r", "p").cache()
    first = {r.feature: r.p_value for r in drift.permutation_ks(frame, 199).collect()}
    assert first == {r.feature: r.p_value for r in drift.permutation_ks(frame, 199).collect()}
    assert 0.3 < np.mean(list(first.values())) < 0.75


def test_few_splits_are_enumerated(spark):
    row = drift.permutation_ks(histogram(spark, [1, 2], [3, 4]), 99).first()
    assert row.statistic == 1.0 and row.p_value == pytest.approx(2 / 6)


def moments(cells, take):
    """Means and covariance of a multivariate hypergeometric draw."""
    total = sum(cells)
    share = np.array(cells, float) / total
    return take * share, take * (np.diag(share) - np.outer(share, share)) * (total - take) / (total - 1)


@pytest.mark.parametrize("cells,take", [
    ([7 * 10**9, 2 * 10**9, 60, 3 * 10**6], 5 * 10**8), ([4 * 10**10, 10**5, 9 * 10**10], 10**11), ([30, 20, 50], 40), ([900, 50, 950], 1500),
])
def test_draws_have_the_exact_moments_at_any_size(cells, take):
    rng, n = np.random.default_rng(12), 4000
    (drawn,) = drift.draw_cells(rng, np.array(cells), np.full(n, take))
    assert (drawn.sum(axis=1) == take).all() and (drawn >= 0).all() and (drawn <= cells).all()
    mean, covariance = moments(cells, take)
    deviation = np.sqrt(np.diag(covariance))
    assert (np.abs(drawn.mean(axis=0) - mean) < 5 * deviation / np.sqrt(n) + 1e-9).all()
    assert np.allclose(np.cov(drawn.T), covariance, atol=0.1 * np.outer(deviation, deviation) + 1e-9)


def test_small_draws_follow_the_law():
    rng = np.random.default_rng(3)
    (drawn,) = drift.draw_cells(rng, np.array([3, 2, 1]), np.full(30_000, 2))
    seen, counts = np.unique(drawn, axis=0, return_counts=True)
    law = {(2, 0, 0): 3, (1, 1, 0): 6, (1, 0, 1): 3, (0, 2, 0): 1, (0, 1, 1): 2}
    assert {tuple(map(int, s)) for s in seen} == set(law)
    assert all(abs(c / 30_000 - law[tuple(map(int, s))] / 15) < 0.015 for s, c in zip(seen, counts))


def test_dealing_agrees_between_blocks():
    sizes, numbers = [5, 10**9, 3, 7 * 10**9, 40], np.arange(0, 60, 3)
    dealt = [drift._deal(sizes, b, 10**8, 9, numbers) for b in range(5)]
    takes = np.array([t for t, _ in dealt])
    assert (takes.sum(axis=0) == 10**8).all() and (takes >= 0).all() and (takes <= np.array(sizes)[:, None]).all()
    assert all((start == takes[:b].sum(axis=0)).all() for b, (_, start) in enumerate(dealt))


def test_cluster_tables_and_their_distances(spark):
    first, second = [5, 5, 5, 8, 2], [8, 8, 2]
    frame = histogram(spark, first, second, "cluster_id")
    shares = {v: (first.count(v) / 5, second.count(v) / 3) for v in (2, 5, 8)}
    assert drift.total_variation(frame).first().total_variation == pytest.approx(sum(abs(a - b) for a, b in shares.values()) / 2)
    expected = sum(
        (side.count(v) - len(side) * (first + second).count(v) / 8) ** 2 / (len(side) * (first + second).count(v) / 8)
        for side in (first, second) for v in (2, 5, 8))
    assert drift.pearson_homogeneity(frame).first().pearson_statistic == pytest.approx(expected)
    assert drift.permutation_homogeneity(frame, 199).first().statistic == pytest.approx(expected)
    rows = spark.createDataFrame([("x", v) for v in first] + [("y", v) for v in second], "cohort string, cluster_id int")
    table = {r.cluster_id: r for r in drift.cluster_drift(rows, "x", "y", 9).collect()}
    assert sorted(table) == list(range(9)) and (table[5].reference_count, table[5].production_count, table[0].reference_count) == (3, 0, 0)
    assert [table[v].proportion_delta for v in (2, 5, 8)] == pytest.approx([b - a for a, b in shares.values()])
    alone = {r.cluster_id: r for r in drift.cluster_drift(rows, "x", "nobody", 9).collect()}
    assert alone[5].reference_proportion == pytest.approx(0.6) and alone[5].production_proportion is None and alone[5].proportion_delta is None


def test_holm_steps_down(spark):
    p = {"q": 0.011, "r": 0.012, "s": 0.013, "t": 0.5, "u": 0.004}
    rows = spark.createDataFrame([(k, v, v, 0.012) for k, v in p.items()], "feature string, p_value double, effect_size double, practical_threshold double")
    out = {r.feature: r for r in drift.holm_adjust(rows).collect()}
    expected, highest = {}, 0.0
    for step, (name, value) in enumerate(sorted(p.items(), key=lambda x: x[1])):
        highest = max(highest, (5 - step) * value)
        expected[name] = min(1.0, highest)
    assert {k: out[k].adjusted_p_value for k in p} == pytest.approx(expected)
    assert {k for k in p if out[k].statistically_significant} == {k for k in p if expected[k] < 0.05} == {"u", "q", "r", "s"} - {k for k in p if expected[k] >= 0.05}
    assert {k for k in p if out[k].practically_important} == {"r", "s", "t"}


def test_report_flags_a_shift_and_refuses_shared_ids(spark):
    rows = [(f"r{i}", "court", "reference", 0) for i in range(30)] + [(f"p{i}", "x " * 100, "production", 1) for i in range(30)]
    frame = spark.createDataFrame(rows, "id string, text string, cohort string, cluster_id int")
    out = drift.drift_report(frame, "reference", "production", "id", label="cluster_id", n_clusters=2, resamples=199).collect()
    assert {r.feature for r in out} == {"character_length", "word_count", "cluster_id"}
    assert all(r.statistically_significant and r.practically_important and r.effect_size == 1 for r in out)
    length = next(r for r in out if r.feature == "character_length")
    assert (length.reference["median"], length.production["median"], length.wasserstein_raw_units) == (5, 199, 194)
    shared = frame.withColumn("id", F.lit("same"))
    with pytest.raises(ValueError, match="overlap"):
        drift.drift_report(shared, "reference", "production", "id")
    with pytest.raises(ValueError, match="configuration"):
        drift.drift_report(frame, "reference", "production", "id", resamples=98)


def kendall_by_pairs(x, y):
    c = d = 0
    for i in range(len(x)):
        for j in range(i):
            s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            c, d = c + (s > 0), d + (s < 0)
    return int(c), int(d)


@pytest.mark.parametrize("distinct,digits", [(2, 16), (5, 16), (40, 16), (40, 3)])
def test_kendall_equals_pair_counting(spark, distinct, digits):
    rng = np.random.default_rng(distinct)
    y = rng.integers(0, distinct, 150)
    x = y * 2 + rng.integers(0, 60, 150)
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    row = kendall_correlation(frame, "x", "y", digits).first()
    assert (row.concordant, row.discordant) == kendall_by_pairs(x, y)
    ties = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    n0 = 150 * 149 / 2
    assert row.tau_b == pytest.approx((row.concordant - row.discordant) / np.sqrt((n0 - ties(x)) * (n0 - ties(y))))
    assert 0 <= row.p_value <= 1


def test_p_values_against_known_ones(spark):
    # Two-sided t probabilities: t = 2.228139 with 10 degrees is the 0.05 point, t = 0 gives 1.
    assert incomplete_beta(5, 0.5, 10 / (10 + 2.2281388520**2)) == pytest.approx(0.05, abs=1e-9)
    rows = spark.createDataFrame([(i, i + (-1) ** i * 3) for i in range(12)], "x int, y int")
    row = pearson_correlation(rows, "x", "y").first()
    r = np.corrcoef([i for i in range(12)], [i + (-1) ** i * 3 for i in range(12)])[0, 1]
    assert row.r == pytest.approx(r) and row.t_statistic == pytest.approx(r * np.sqrt(10 / (1 - r * r)))
    assert 0 < row.p_value < 0.02


def test_normality_and_qq(spark):
    rng = np.random.default_rng(5)
    normal = spark.createDataFrame([(float(v),) for v in rng.normal(3, 2, 2000)], "v double")
    skewed = spark.createDataFrame([(float(v),) for v in rng.exponential(2, 2000)], "v double")
    assert normality_summary(normal, "v").first().p_value > 0.001 > normality_summary(skewed, "v").first().p_value
    points = qq_points(normal, "v", 9).orderBy("fraction").collect()
    assert [p.observed for p in points] == pytest.approx([np.quantile([r.v for r in normal.collect()], f / 10) for f in range(1, 10)])
    assert points[4].normal_quantile == pytest.approx(0, abs=1e-9)
    assert max(abs(p.observed - p.fitted) for p in points) < 0.3
