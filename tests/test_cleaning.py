import pytest
from pyspark.sql import functions as F

from clustrum.operators import cleaning


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_features_strip_unicode_space_and_count_words(spark):
    rows = frame(spark, [(1, "  un deux\n trois  "), (2, " été noël　"), (3, " \t"), (4, None), (5, "😀 a")], "id int, text string")
    out = {r.id: (r.character_length, r.word_count) for r in cleaning.text_features(rows).collect()}
    assert out == {1: (14, 3), 2: (8, 2), 3: (0, 0), 4: (0, 0), 5: (3, 2)}


@pytest.mark.parametrize("rows,expected", [
    ([("a", "x"), ("b", " ")], None), ([("a", "x"), ("a", "y")], None), ([("a", "x"), (None, "y")], None),
    ([], None), ([("a", "x")], 2), ([("a", "x"), (" ", "y")], None),
])
def test_contract_refuses(spark, rows, expected):
    with pytest.raises(cleaning.ContractError):
        cleaning.check_reviews(frame(spark, rows, "id string, text string"), "id", "text", expected)


def test_contract_accepts_and_cleans(spark):
    out = cleaning.check_reviews(frame(spark, [("a", " NA "), ("b", "y")], "id string, text string"), "id", "text", 2)
    assert sorted(r.text for r in out.collect()) == ["NA", "y"]


def test_limits_and_quarantine(spark):
    rows = frame(spark, [(1, "x" * 5000), (2, "x" * 5001), (3, " "), (4, None)], "id int, text string")
    valid, rest = cleaning.split_valid(cleaning.text_limits(rows))
    assert [r.id for r in valid.collect()] == [1]
    assert {r.id: r.limit_reason for r in rest.collect()} == {2: "too_long", 3: "blank", 4: "blank"}


def test_dates_strict_and_lenient(spark):
    rows = frame(spark, [("May 05, 2025",), ("December 1, 2024",), (None,), ("soon",)], "date_experience string")
    lenient = cleaning.parse_experience_date(rows, strict=False).collect()
    assert [str(r.date_to_sort) for r in lenient] == ["2025-05-05", "2024-12-01", "None", "None"]
    with pytest.raises(Exception, match="not a date"):
        cleaning.parse_experience_date(rows).collect()
    parts = cleaning.year_month_parts(cleaning.parse_experience_date(rows.limit(2))).collect()
    assert [(r.date_experience_year, r.date_experience_month) for r in parts] == [(2025, 5), (2024, 12)]


def test_dedupe_keeps_first_copy_and_treats_null_as_equal(spark):
    rows = frame(spark, [(3, "a", None), (1, "a", None), (2, "a", "x"), (4, None, None), (5, None, None), (6, "n", None)], "id int, t string, u string")
    assert sorted(r.id for r in cleaning.dedupe_reviews(rows, ["t", "u"], "id").collect()) == [1, 2, 4, 6]


def test_dedupe_limits_hot_keys_before_the_shuffle(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("t"))
    plan = cleaning.dedupe_reviews(rows, ["t"], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("row_number(), 1, Partial")


@pytest.mark.parametrize("bad", [[0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], []])
def test_normalize_refuses(spark, bad):
    with pytest.raises(Exception, match="finite and nonzero"):
        cleaning.l2_normalize(frame(spark, [(bad,)], "embedding array<float>")).collect()


def test_title_reply_language_rating_noise(spark):
    rows = frame(spark, [(None, "t", "r", "fr", 1), ("c", "t", None, "en", 5)], "commentaire string, titre string, dataServiceReply string, lang string, note int")
    filled = cleaning.fill_from_title(rows)
    assert [r.commentaire for r in filled.collect()] == ["t", "c"]
    assert [r.comm_reply for r in cleaning.concat_reply(filled).collect()] == ["tr", "c"]
    assert cleaning.language_filter(filled, "fr", text="commentaire").count() == 1
    assert cleaning.language_filter(rows, "fr", text="commentaire").count() == 0
    assert cleaning.filter_by_rating(rows).count() == 1
    assert cleaning.drop_noise(frame(spark, [(-1,), (0,)], "cluster_id int")).count() == 1
