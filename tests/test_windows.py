"""Streams in several files: the gauge of requests in progress, finished windows, upserts, and the levelled store."""
import collections
import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from clustrum.streaming import gauge, jobs, metrics, windows
from clustrum.streaming.runs import RunStore

DAY = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)
ENDS = "request string, method string, at timestamp, kind string"


def at(seconds):
    return DAY + datetime.timedelta(seconds=seconds)


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run_gauge(spark, tmp_path, files, limit, lateness):
    """The changes after each file, the query being started anew for every one."""
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = []
    for rows in files:
        arrive(spark, folder, rows, ENDS)
        stream = jobs.read_table_stream(spark, folder, "*.parquet")
        gauge.collect_gauge(stream, limit, path, state, lateness=lateness, buckets=3).awaitTermination()
        out = spark.read.parquet(path).select("method", F.unix_seconds("at").alias("s"), "change", "outcome").collect()
        seen.append(collections.Counter((r.method, r.s - int(DAY.timestamp()), r.change, r.outcome) for r in out))
    return seen


def test_gauge_over_files_out_of_order(spark, tmp_path):
    files = [
        [("a", "GET", at(0), "start"), ("b", "GET", at(30), "finish"), ("never", "PUT", at(5), "start"), ("lost", "GET", at(8), "finish")],
        [("b", "GET", at(10), "start"), ("a", "GET", at(40), "finish"), ("a", "GET", at(41), "finish"), ("slow", "GET", at(20), "start")],
        [("slow", "GET", at(200), "finish"), ("z", "GET", at(400), "start"), (None, "GET", at(1), "start")],
    ]
    first, second, third = run_gauge(spark, tmp_path, files, 100, "60 seconds")
    assert first == collections.Counter({("GET", 0, 1, "started"): 1, ("PUT", 5, 1, "started"): 1})
    assert second - first == collections.Counter({
        ("GET", 10, 1, "started"): 1, ("GET", 30, -1, "finished"): 1, ("GET", 40, -1, "finished"): 1, ("GET", 20, 1, "started"): 1})
    # The watermark is 340 now: what began by 240 and did not finish within 100 seconds has been given up.
    assert third - second == collections.Counter({
        ("PUT", 105, -1, "abandoned"): 1, ("GET", 120, -1, "abandoned"): 1, ("GET", 8, 0, "unmatched"): 1, ("GET", 400, 1, "started"): 1})


def test_gauge_equals_the_batch_twin(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        begin = rng.randrange(0, 3000)
        method = rng.choice(["GET", "POST"])
        if rng.random() < 0.95:
            rows += [(f"r{i}", method, at(begin), "start")] * rng.choice([1, 1, 2])
        if rng.random() < 0.8:
            rows += [(f"r{i}", method, at(begin + rng.randrange(0, 400)), "finish")] * rng.choice([1, 1, 2])
    rows.sort(key=lambda r: r[2].timestamp() + rng.randrange(0, 240))
    thirds = [rows[:150], rows[150:260], rows[260:]]
    found = run_gauge(spark, tmp_path, thirds, 300, "5 minutes")[-1]
    watermark = max(r[2] for r in rows) - datetime.timedelta(minutes=5)
    batch = gauge.gauge_changes(spark.createDataFrame(rows, ENDS), 300, watermark).select(
        "method", F.unix_seconds("at").alias("s"), "change", "outcome").collect()
    assert found == collections.Counter((r.method, r.s - int(DAY.timestamp()), r.change, r.outcome) for r in batch)
    assert {"started", "finished", "abandoned", "unmatched"} == {k[3] for k in found}


def test_state_of_the_gauge_falls_after_the_watermark(spark, tmp_path):
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    kept = []
    for number in range(3):
        rows = [(f"{number}-{i}", "GET", at(1000 * number + i + e), k) for i in range(40) for e, k in ((0, "start"), (5, "finish"))]
        arrive(spark, folder, rows, ENDS)
        stream = jobs.read_table_stream(spark, folder, "*.parquet")
        query = gauge.collect_gauge(stream, 60, path, state, lateness="10 seconds", buckets=2)
        query.awaitTermination()
        kept.append([p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1])
    # Forty requests a file, of which the last seconds' are still open; the state does not add up over the files.
    assert max(kept) <= 40 and kept[2] <= kept[0] + 2
    assert spark.read.parquet(path).groupBy("outcome").count().orderBy("outcome").collect() == [("finished", 120), ("started", 120)]


def test_batch_gauge_without_a_horizon_closes_everything(spark):
    rows = [("a", "GET", at(0), "start"), ("b", "GET", at(0), "start"), ("b", "GET", at(9), "finish"), ("c", "GET", at(3), "finish")]
    out = gauge.gauge_changes(spark.createDataFrame(rows, ENDS), 50).collect()
    assert sorted((r.change, r.outcome) for r in out) == [(-1, "abandoned"), (-1, "finished"), (0, "unmatched"), (1, "started"), (1, "started")]


EVENTS = "ts timestamp, route string, status_code int, duration double"


def event(seconds, route="/a", status=200):
    return (at(seconds), route, status, 0.3)


def test_finished_windows_are_written_once_and_late_rows_are_counted(spark, tmp_path):
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    files = [[event(10), event(70), event(500)], [event(490), event(20), event(520, "/b")], [event(30), event(1500), event(515)]]
    finished = []
    for rows in files:
        arrive(spark, folder, rows, EVENTS)
        for _ in range(2):
            stream = metrics.with_event_time(jobs.read_table_stream(spark, folder, "*.parquet"), lateness="60 seconds")
            windows.collect_finished(metrics.request_rate(stream, "1 minute"), path, state).awaitTermination()
        done = windows.finished_windows(spark, path).select((F.unix_seconds("window_start") - int(DAY.timestamp())).alias("s"), "route", "requests").collect()
        finished.append(sorted(map(tuple, done)))
    assert finished[0] == finished[1] == [(0, "/a", 1), (60, "/a", 1)]
    assert finished[2] == [(0, "/a", 1), (60, "/a", 1), (480, "/a", 3), (480, "/b", 1)]
    still_open = windows.open_windows(spark, state)
    assert [(r.route, r["count"]) for r in still_open.collect()] == [("/a", 1)]
    received = metrics.request_rate(spark.createDataFrame(sum(files, []), EVENTS), "1 minute")
    late = windows.late_rows(
        received, windows.finished_windows(spark, path), still_open.withColumnRenamed("count", "requests"), ["window_start", "route"])
    assert sorted((r.received, r.counted, r.late) for r in late.collect()) == [(1, 1, 0), (1, 1, 0), (1, 1, 0), (3, 1, 2), (3, 3, 0)]


def test_upserts_keep_the_newest_value_of_a_key(spark, tmp_path):
    folder, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([event(10), event(20, status=500)], [event(30), event(130)], [event(40, status=404)]):
        arrive(spark, folder, rows, EVENTS)
        stream = metrics.with_event_time(jobs.read_table_stream(spark, folder, "*.parquet"))
        windows.upsert_stream(metrics.error_fraction(stream, "1 minute"), ["window_start"], path, state).awaitTermination()
    out = windows.current_rows(spark, path, ["window_start"]).orderBy("window_start").collect()
    assert [(r.requests, r.errors) for r in out] == [(4, 2), (1, 0)]


def sums(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def test_the_store_reads_few_runs_and_counts_a_batch_once(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), sums, fan_out=3)
    read = []
    for batch in range(30):
        rows = spark.createDataFrame([("all", 1), (f"b{batch}", 1)], "k string, n long").coalesce(1)
        store.add(rows, batch)
        if batch in (0, 7, 9):
            store.add(rows, batch)
        read.append(len(store.runs()))
    assert max(read) <= 8 and store.runs()[0] == (0, 26)
    out = {r.k: r.n for r in store.read().collect()}
    assert out == {"all": 30, **{f"b{i}": 1 for i in range(30)}}
    assert len(os.listdir(tmp_path / "runs")) <= 12


def test_a_run_that_was_not_finished_does_not_count(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), sums, fan_out=2)
    one = spark.createDataFrame([("a", 1)], "k string, n long").coalesce(1)
    store.add(one, 0)
    sums(one).write.parquet(str(tmp_path / "runs" / "run-1-1"))
    os.remove(tmp_path / "runs" / "run-1-1" / "_SUCCESS")
    assert store.read().first().n == 1
    store.add(one, 1)
    assert store.read().first().n == 2 and store.runs() == [(0, 1)]
    with pytest.raises(ValueError):
        RunStore(spark, "x", sums, fan_out=1)
