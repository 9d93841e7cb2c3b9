import datetime
import time

import pytest
from pyspark.sql import functions as F

from clustrum.operators import drift
from clustrum.operators.cleaning import ContractError
from clustrum.operators.geometry import centroids_of
from clustrum.plans import streams
from clustrum.streaming import jobs, metrics


def requests(spark):
    start = datetime.datetime(2024, 1, 1, 10, 0, 0)
    rows = [
        (start, "POST", "/predict", "200", 0.004), (start + datetime.timedelta(seconds=30), "POST", "/predict", "422", 0.02),
        (start + datetime.timedelta(minutes=6), "GET", "/missing", "404", 400.0), (start + datetime.timedelta(minutes=6), "BREW", "/health", "500", 2.0),
    ]
    return spark.createDataFrame(rows, "ts timestamp, method string, route string, status_code string, duration double")


def test_labels_are_bounded(spark):
    out = metrics.bounded_labels(requests(spark), ["/predict", "/health"]).groupBy("method", "route").count().collect()
    assert {(r.method, r.route): r["count"] for r in out} == {("POST", "/predict"): 2, ("GET", "__unmatched__"): 1, ("OTHER", "/health"): 1}


def test_rates_errors_and_silent_windows(spark):
    errors = {r.window_start.minute: r for r in metrics.error_fraction(requests(spark)).collect()}
    assert set(errors) == {0, 5} and errors[0].error_fraction == 0.5 and errors[5].error_fraction == 1.0
    rates = metrics.request_rate(requests(spark), "5 minutes", ["route"]).filter("route = '/predict'").collect()
    assert [r.per_second for r in rates] == [2 / 300]
    good = metrics.error_fraction(requests(spark).filter("status_code = '200'")).collect()
    assert [r.error_fraction for r in good] == [0.0]


def test_buckets_and_quantiles(spark):
    counts = {(r.route, r.le): r.cumulative for r in metrics.duration_histogram(requests(spark), by=["route"]).collect()}
    assert counts["/predict", "0.005"] == 1 and counts["/predict", "0.025"] == 2 and counts["/missing", "300"] == 0 and counts["/missing", "+Inf"] == 1
    late = metrics.histogram_quantile(requests(spark).filter("route = '/missing'")).first()
    assert late.p50 == late.p99 == 300.0
    first = metrics.histogram_quantile(requests(spark).filter("route = '/predict'")).first()
    assert first.p50 == pytest.approx(0.005) and first.p95 == pytest.approx(0.01 + 0.015 * 0.9)


def test_in_progress_counts_overlaps(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start, "GET", 10.0), (start + datetime.timedelta(seconds=5), "GET", 10.0), (start + datetime.timedelta(seconds=10), "GET", 1.0)]
    frame = spark.createDataFrame(rows, "ts timestamp, method string, duration double")
    out = metrics.in_progress(frame).orderBy("at").collect()
    assert [(r["at"].second, r.in_progress) for r in out] == [(0, 1), (5, 2), (10, 2), (11, 1), (15, 0)]
    now = metrics.in_progress_now(metrics.in_progress_changes(frame)).first()
    assert now.in_progress == 0


def test_latest_state(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 0, 2), ("b", 1, 1)], "target string, up int, ts int").withColumn("event_id", F.col("ts"))
    out = {r.target: r.up for r in metrics.latest_state(rows, "target", "up").collect()}
    assert out == {"a": 0, "b": 1}


@pytest.fixture
def vectors(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    folder = str(tmp_path / "in")
    rows.filter("vec_id < 300").coalesce(1).write.parquet(folder)
    return rows, folder, centroids_of(rows.withColumnRenamed("label", "cluster_id"))


def score(spark, folder, centroids, tmp_path, plan):
    stream = jobs.read_table_stream(spark, folder, "*.parquet").select("vec_id", "embedding")
    jobs.score_stream(stream, centroids, str(tmp_path / "out"), str(tmp_path / "state"), plan).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_scoring_resumes_without_repeating(spark, vectors, tmp_path):
    rows, folder, centroids = vectors
    assert score(spark, folder, centroids, tmp_path, {"source": "s"}).count() == 300
    assert score(spark, folder, centroids, tmp_path, {"source": "s"}).count() == 300
    rows.filter("vec_id >= 300").coalesce(1).write.mode("append").parquet(folder)
    out = score(spark, folder, centroids, tmp_path, {"source": "s"})
    assert out.count() == out.select("vec_id").distinct().count() == 500


def test_resume_refuses_another_plan_or_model(spark, vectors, tmp_path):
    _, folder, centroids = vectors
    score(spark, folder, centroids, tmp_path, {"source": "s"})
    with pytest.raises(ContractError):
        score(spark, folder, centroids, tmp_path, {"source": "t"})
    with pytest.raises(ContractError):
        score(spark, folder, centroids.withColumn("centroid", F.reverse("centroid")), tmp_path, {"source": "s"})


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    for _ in range(2):
        jobs.write_batch(spark.range(5), str(tmp_path), 0)
    jobs.write_batch(spark.range(5, 8), str(tmp_path), 1)
    assert spark.read.parquet(str(tmp_path)).count() == 8


def test_stream_keeps_each_id_once(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i % 10, start + datetime.timedelta(seconds=i)) for i in range(100)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_table_stream(spark, str(tmp_path / "in"), "*.parquet")
    query = (
        metrics.dedupe_stream(stream, "event_id").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10))


def test_windowed_stream_equals_batch(spark, tmp_path):
    requests(spark).write.parquet(str(tmp_path / "in"))
    stream = metrics.with_event_time(jobs.read_table_stream(spark, str(tmp_path / "in"), "*.parquet"))
    jobs.collect_stream(metrics.histogram_quantile(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    expected = metrics.histogram_quantile(requests(spark))
    assert sorted(map(tuple, jobs.newest_result(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, expected.collect()))


def test_drift_stream_with_p_values(spark, tmp_path):
    short = spark.createDataFrame([("court",)] * 30, "text string")
    spark.createDataFrame([("un texte bien plus long " * 5,)] * 30, "text string").write.parquet(str(tmp_path / "in"))
    stream = jobs.read_table_stream(spark, str(tmp_path / "in"), "*.parquet")
    jobs.drift_stream(stream, jobs.reference_histogram(short), str(tmp_path / "out"), str(tmp_path / "state"), resamples=99).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 2 and all(r.ks_statistic == 1.0 and r.p_value == pytest.approx(0.01) for r in out)


def test_a_frozen_model_does_not_follow_its_table(spark, tmp_path):
    source, arriving, out, state = (str(tmp_path / n) for n in ("model", "in", "out", "state"))
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster_id int, centroid array<double>").write.parquet(source)
    for part in range(2):
        spark.createDataFrame([(part, [1.0, 0.0])], "id int, embedding array<double>").coalesce(1).write.mode("append").parquet(arriving)
    stream = jobs.read_table_stream(spark, arriving, "*.parquet", files_per_batch=1)
    centroids = spark.read.parquet(source)
    query = jobs.score_stream(stream, centroids, out, state, {"source": arriving})
    # The table grows while the stream runs.
    spark.createDataFrame([(2, [0.6, 0.8])], "cluster_id int, centroid array<double>").write.mode("append").parquet(source)
    query.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert {r.id for r in rows} == {0, 1} and {r.cluster_id for r in rows} == {0} and len({r.model_sha256 for r in rows}) == 1
    with pytest.raises(ContractError):
        jobs.score_stream(stream, spark.read.parquet(source), out, state, {"source": arriving})


def test_drift_of_all_batches_equals_the_batch_report(spark, tmp_path):
    arriving, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    texts = [[("un mot",), ("deux mots de plus",)], [("un texte assez long " * 4,)] * 3, [("x",)]]
    for part in texts:
        spark.createDataFrame(part, "text string").coalesce(1).write.mode("append").parquet(arriving)
    early = spark.createDataFrame([("un mot",), ("trois mots ici",)] * 4, "text string")
    stream = jobs.read_table_stream(spark, arriving, "*.parquet", files_per_batch=1)
    jobs.drift_stream(stream, jobs.reference_histogram(early), out, state, resamples=99).awaitTermination()
    last = {r.feature: r for r in jobs.newest_result(spark, out).collect()}
    both = early.withColumn("cohort", F.lit("reference")).unionByName(spark.read.parquet(arriving).withColumn("cohort", F.lit("production")))
    whole = drift.drift_report(both.withColumn("id", F.monotonically_increasing_id()), "reference", "production", "id", resamples=99).collect()
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3
    for row in whole:
        mine = last[row.feature]
        assert (mine.production_rows, mine.ks_statistic, mine.p_value, mine.adjusted_p_value, mine.statistically_significant) == (
            6, row.effect_size, row.p_value, row.adjusted_p_value, row.statistically_significant)
    with pytest.raises(ContractError, match="reference"):
        jobs.drift_stream(stream, jobs.reference_histogram(early.limit(3)), out, state, resamples=99)


def in_folders(spark, sf, tmp_path, name, files=3):
    """A copy of a table as a folder of files, beside another table's folder; returns the folder of both."""
    for table in (name, "labels"):
        spark.read.parquet(f"{sf}/{table}.parquet").repartition(files).write.parquet(str(tmp_path / "tables" / f"{table}.parquet"))
    return str(tmp_path / "tables")


def test_a_table_in_its_own_folder_arrives_whole(spark, sf, tmp_path):
    folder = in_folders(spark, sf, tmp_path, "documents")
    rows = {tuple(r) for r in streams.QUERIES["drift_stream"](spark, folder).collect()}
    assert rows == {tuple(r) for r in streams.QUERIES["drift_stream"](spark, sf).collect()} and len(rows) == 2


def test_centroids_summed_again_in_another_order_resume(spark, sf, tmp_path, monkeypatch):
    folder = in_folders(spark, sf, tmp_path, "embeddings")
    noise = F.udf(lambda: time.time_ns() % 1000 * 1e-15, "double").asNondeterministic()

    def shaken(df):
        return centroids_of(df).withColumn("_e", noise()).select("cluster_id", F.transform("centroid", lambda x: x + F.col("_e")).alias("centroid"))

    monkeypatch.setattr(streams, "centroids_of", shaken)
    assert streams.QUERIES["score_stream"](spark, folder).count() == spark.read.parquet(folder + "/embeddings.parquet").count()


def test_arriving_files_stay_small_in_four_batches(spark, sf, tmp_path, monkeypatch):
    folders = []
    monkeypatch.setattr(streams, "scratch_path", lambda spark, name: folders.append(str(tmp_path / name)) or folders[-1])
    monkeypatch.setattr(streams, "FILE_BYTES", 20_000, raising=False)
    rows = {tuple(r) for r in streams.QUERIES["drift_stream_files"](spark, sf).collect()}
    texts = spark.read.parquet(folders[0])
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    longest = texts.agg(F.max(F.octet_length("text"))).first()[0]
    largest = texts.groupBy(F.input_file_name()).agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0]
    assert size > 10 * 20_000 and largest < 3 * 20_000 + longest
    assert spark.read.parquet(folders[1]).select("batch_id").distinct().count() == 4
    monkeypatch.undo()
    assert rows == {tuple(r) for r in streams.QUERIES["drift_stream"](spark, sf).collect()}
