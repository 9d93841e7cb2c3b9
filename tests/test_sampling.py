import pytest
from pyspark.sql import functions as F

from clustrum.operators import sampling
from clustrum.operators.cohorts import (
    align_predictions, batch_plan, chronological_split, cohort_audit, coverage_gaps, join_text_to_predictions,
    prediction_violations, remaining_batches, source_row_index, table_fingerprint,
)

SCHEMA = "source_row_id string, cluster_id int, assigned_centroid_cosine_similarity double, assignment_margin double, review_text string"


def planted(spark, rows, n_clusters, seed=7):
    """Chosen (id, category, position) and the skip counts by (cluster, category)."""
    chosen, details = sampling.inspection_sample(spark.createDataFrame(rows, SCHEMA), n_clusters, seed)
    picked = sorted((r.sampling_category, r.position, r.source_row_id) for r in chosen.collect())
    return picked, {(r.cluster_id, r.sampling_category): (r.already_selected_id, r.duplicate_stripped_text) for r in details.collect()}


def ladder(cluster, n, prefix):
    """Similarity falls from 0.99 ever faster, the margin follows a permutation of the ranks, texts differ."""
    return [(f"{prefix}{i}", cluster, 0.99 - i * i / 3000, ((i * 7) % n) / 100, f"{prefix} text {i}") for i in range(n)]


def in_python(rows, quotas=sampling.QUOTAS):
    """The staged choice for one cluster without ties."""
    similarity = sorted(r[2] for r in rows)
    half = len(similarity) // 2
    median = similarity[half] if len(similarity) % 2 else (similarity[half - 1] + similarity[half]) / 2
    order = {
        "high_similarity": lambda r: -r[2], "intermediate_similarity": lambda r: abs(r[2] - median), "low_margin": lambda r: r[3]}
    used, texts, out = set(), set(), []
    for category, quota in quotas:
        place = 0
        for row in sorted(rows, key=order[category]):
            if place < quota and row[0] not in used and row[4].strip() not in texts:
                used.add(row[0])
                texts.add(row[4].strip())
                place += 1
                out.append((category, place, row[0]))
    return sorted(out)


def test_unequal_clusters_get_their_quotas(spark):
    small, large = ladder(0, 11, "s"), ladder(1, 29, "l")
    picked, _ = planted(spark, small + large, 2)
    assert [p for p in picked if p[2][0] == "s"] == in_python(small)
    assert [p for p in picked if p[2][0] == "l"] == in_python(large)


def test_copies_of_a_chosen_text_are_passed_over(spark):
    rows = ladder(0, 17, "c")
    # The two best texts again, with other blanks and just below the originals.
    rows += [("copy0", 0, 0.9898, 0.5, "  c text 0"), ("copy1", 0, 0.9895, 0.5, "c text 1 \n")]
    picked, skipped = planted(spark, rows, 1)
    assert picked == in_python(rows) and not {"copy0", "copy1"} & {p[2] for p in picked}
    assert skipped[0, "high_similarity"] == (0, 2)


def test_planted_ties_follow_the_seed_only(spark):
    rows = ladder(0, 12, "t")[:2] + [(f"tie{i}", 0, 0.5, 0.2, f"tie text {i}") for i in range(24)]
    first = planted(spark, rows, 1)[0]
    assert first == planted(spark, rows[::-1], 1)[0]
    assert {p[2] for p in first if p[0] == "high_similarity"} >= {"t0", "t1"}
    assert any(planted(spark, rows, 1, seed)[0] != first for seed in (8, 9, 10))


def test_too_few_distinct_reviews_are_refused(spark):
    nine = ladder(0, 9, "n")
    for rows, n_clusters in ((nine, 1), (ladder(0, 15, "a"), 3), ([r[:4] + ("one text",) for r in ladder(0, 15, "o")], 1)):
        with pytest.raises(ValueError, match="distinct eligible"):
            planted(spark, rows, n_clusters)
    loose, _ = sampling.inspection_sample(spark.createDataFrame(nine, SCHEMA), 1, strict=False)
    assert loose.count() == 9


def test_seeded_order_repeats_and_depends_on_the_seed(spark):
    ids = lambda seed, parts: [r.id for r in sampling.seeded_shuffle_limit(spark.range(200).repartition(parts), "id", seed, 20).orderBy("position").collect()]
    assert ids(1, 3) == ids(1, 7) != ids(2, 3)
    assert dict(sampling.seeded_shuffle_limit(spark.range(9), "id", 1, 20).dtypes)["position"] == "bigint"
    repeated = spark.range(30).selectExpr("id % 3 AS id")
    assert sorted(r.position for r in sampling.seeded_shuffle_limit(repeated, "id", 1, 7).collect()) == list(range(7))
    assert sampling.seeded_shuffle_limit(spark.range(9), "id", 1, 20).count() == 9
    assert sampling.fixed_sample(spark.range(200), "id", 1, 20).count() == 20
    assert sampling.fixed_sample(spark.range(5), "id", 1, 0).count() == 5


@pytest.mark.parametrize("fraction", [0.01, 0.5, 0.8, 1.0])
def test_fraction_subsets_are_exact_and_independent(spark, fraction):
    rows = spark.range(5000)
    pick = lambda repeat, side: {r.id for r in sampling.fraction_subset(rows, "id", fraction, 42, repeat, side).collect()}
    a, b = pick(0, "a"), pick(0, "b")
    assert len(a) == len(b) == int(5000 * fraction) and (a != b or fraction == 1.0)
    assert a == pick(0, "a")


def test_split_plan_and_resume(spark):
    rows = spark.range(5).select(F.col("id"), F.lit("d").alias("day"))
    plan = batch_plan(source_row_index(rows, ["id"]), 2)
    assert [r["count"] for r in plan.groupBy("request_id").count().orderBy("request_id").collect()] == [2, 2, 1]
    log = spark.createDataFrame([("batch-000000", "complete"), ("batch-000001", "pending")], "request_id string, state string")
    assert sorted(r.request_id for r in remaining_batches(plan, log).collect()) == ["batch-000001", "batch-000002"]
    with pytest.raises(ValueError):
        batch_plan(plan, 65)
    split = chronological_split(rows, "day", "id", {"training": 2, "reference": 1, "production": 9})
    assert [r.cohort for r in split.orderBy("id").collect()] == ["training"] * 2 + ["reference"] + ["production"] * 2


@pytest.mark.parametrize("sizes,expected", [
    ({"training": 0.5}, {"training": 10, "final": 10}), ({"training": 17, "reference": 2}, {"training": 17, "reference": 2, "final": 1}),
    ({"training": 30}, {"training": 20}),
])
def test_split_puts_unknown_dates_last(spark, sizes, expected):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"2020-01-{i + 1:02d}") for i in range(20)], "id int, day string")
    split = chronological_split(rows, "day", "id", sizes).collect()
    counted = {c: sum(r.cohort == c for r in split) for c in {r.cohort for r in split}}
    assert counted == expected
    dated, undated = ([r.cohort for r in sorted(split, key=lambda r: r.id) if (r.day is None) == null] for null in (False, True))
    order = [*expected]
    assert [order.index(c) for c in dated + undated] == sorted(order.index(c) for c in dated + undated)


def test_audit_counts_rows_and_reports_overlap(spark):
    final = spark.createDataFrame([("f1", "a "), ("f2", "a"), ("f3", "z"), ("t9", "q")], "id string, text string")
    others = spark.createDataFrame([("training", "t1", " a"), ("training", "t9", "a"), ("selection", "s1", "b")], "cohort string, id string, text string")
    out = {r.cohort: r for r in cohort_audit(final, others, "id").collect()}
    assert (out["training"].matching_text_rows, out["training"].overlapping_ids, out["training"].disjoint) == (2, 1, False)
    assert (out["selection"].matching_text_rows, out["selection"].disjoint) == (0, True)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(i, f"t{i}") for i in range(40)]
    digest = lambda r, n: table_fingerprint(spark.createDataFrame(r, "id int, text string").repartition(n)).first().fingerprint
    assert digest(rows, 1) == digest(rows[::-1], 5)
    assert digest(rows, 1) != digest(rows[:-1], 1) and digest(rows, 1) != digest(rows[:-1] + [(39, "T39")], 1)
    assert digest(rows, 1) != digest(rows + [rows[0]] * 2, 1)


RECORDS = "source_row_id string, source_row_index int, model_id string, success boolean, cluster_id int"


def records(n=4):
    return [[f"r{i}", i, "m", True, i % 3] for i in range(n)]


def align(spark, rows, **options):
    source = spark.createDataFrame([(f"r{i}", i) for i in range(4)], "source_row_id string, source_row_index int")
    frame = spark.createDataFrame([tuple(r) for r in rows], RECORDS)
    return align_predictions(source, frame, "m", 3, **options).first(), prediction_violations(source, frame, "m", 3).collect()


def test_alignment_accepts_and_counts(spark):
    row, bad = align(spark, records())
    assert row.accepted and not row.subset and not bad
    rows = records(3)
    rows[1][3:] = [False, None]
    assert not align(spark, rows)[0].accepted
    row, _ = align(spark, rows, allow_subset=True)
    assert row.accepted and (row.recorded_rows, row.successful_rows, row.failed_rows, row.missing_rows) == (3, 2, 1, 1)
    assert not align(spark, [], allow_subset=True)[0].accepted


@pytest.mark.parametrize("position,value,reason", [
    (0, "zz", "unknown_id"), (0, "r1", "duplicate_id"), (1, 3, "index_mismatch"), (2, "other", "wrong_model"), (2, None, "wrong_model"),
    (3, None, "invalid_flag"), (3, False, "failed_with_cluster"), (4, 3, "invalid_label"), (4, -1, "invalid_label"), (4, None, "invalid_label"),
])
def test_alignment_refuses(spark, position, value, reason):
    rows = records()
    rows[0][position] = value
    row, bad = align(spark, rows, allow_subset=True)
    assert not row.accepted and reason in {r.reason for r in bad}


def test_text_join_checks_ranges(spark):
    source = spark.createDataFrame([("a", "x")], "source_row_id string, review_text string")
    make = lambda c, s, m: spark.createDataFrame([("a", c, s, m)], "source_row_id string, cluster_id int, assigned_centroid_cosine_similarity double, assignment_margin double")
    assert join_text_to_predictions(source, make(0, 0.5, 0.1), 3).first().review_text == "x"
    for bad in ((3, 0.5, 0.1), (0, 1.5, 0.1), (0, 0.5, 2.5), (0, 0.5, float("nan")), (None, 0.5, 0.1)):
        with pytest.raises(Exception, match="invalid geometry"):
            join_text_to_predictions(source, make(*bad), 3).collect()
    gaps = coverage_gaps(source, make(0, 0.5, 0.1).withColumn("source_row_id", F.lit("b"))).collect()
    assert {r.source_row_id for r in gaps} == {"a", "b"}
