"""Queries of the streaming operators. `events` are requests: event_type is the route, 'error' a status
of 500, `value` the duration in seconds. The windowed metrics run as batch twins of the same functions;
names ending in `_stream` run a streaming query over the table to its end."""
from __future__ import annotations

from pyspark.sql import functions as F

from clustrum.operators.geometry import centroids_of
from clustrum.plans.common import SQL_CENTROIDS, labelled_embeddings, rounded, table
from clustrum.plans.drift import STACKED
from clustrum.operators.ordering import running_sums
from clustrum.session import materialize, scratch_path
from clustrum.streaming import gauge, jobs, metrics, windows


def shaped(events):
    failed = F.col("event_type") == "error"
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.when(F.col("event_type") == "click", "POST").when(F.col("event_type") == "signup", "BREW").otherwise("GET").alias("method"),
        F.col("event_type").alias("route"), F.when(failed, 500).otherwise(200).alias("status_code"), F.col("value").alias("duration"),
    )


def requests(spark, sf):
    return shaped(table(spark, sf, "events"))


def request_stream(spark, sf):
    return metrics.with_event_time(shaped(jobs.read_table_stream(spark, sf, "events.parquet")))


def naive(df, *columns):
    """Window starts without a zone, as the table has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def rate_query(spark, sf):
    return naive(metrics.request_rate(requests(spark, sf), "1 hour"), "window_start").withColumn("per_second", rounded("per_second"))


def sliding_query(spark, sf):
    out = metrics.request_rate(requests(spark, sf), "2 hours", ("status_code",), "1 hour")
    return naive(out, "window_start").withColumn("per_second", rounded("per_second"))


def rate_stream_query(spark, sf):
    path, state = scratch_path(spark, "rate"), scratch_path(spark, "rate-state")
    jobs.collect_stream(metrics.request_rate(request_stream(spark, sf), "1 hour"), path, state).awaitTermination()
    return naive(jobs.newest_result(spark, path), "window_start").withColumn("per_second", rounded("per_second"))


def error_query(spark, sf):
    return naive(metrics.error_fraction(requests(spark, sf), "6 hours"), "window_start").withColumn("error_fraction", rounded("error_fraction"))


def error_stream_query(spark, sf):
    path, state = scratch_path(spark, "errors"), scratch_path(spark, "errors-state")
    jobs.collect_stream(metrics.error_fraction(request_stream(spark, sf), "6 hours"), path, state).awaitTermination()
    return naive(jobs.newest_result(spark, path), "window_start").withColumn("error_fraction", rounded("error_fraction"))


def histogram_query(spark, sf):
    return metrics.duration_histogram(requests(spark, sf)).withColumn("duration_sum", rounded("duration_sum", places=3))


def windowed_histogram_query(spark, sf):
    out = metrics.duration_histogram(requests(spark, sf), "1 day", ["route"])
    return naive(out, "window_start").withColumn("duration_sum", rounded("duration_sum", places=3))


def quantile_query(spark, sf):
    out = metrics.histogram_quantile(requests(spark, sf), length="6 hours", by=["route"])
    return naive(out, "window_start").withColumns({c: rounded(F.col(c)) for c in ("p50", "p95", "p99")})


def totals_query(spark, sf):
    return metrics.lifetime_totals(requests(spark, sf))


def totals_stream_query(spark, sf):
    path, state = scratch_path(spark, "totals"), scratch_path(spark, "totals-state")
    jobs.collect_stream(metrics.lifetime_totals(request_stream(spark, sf)), path, state).awaitTermination()
    return jobs.newest_result(spark, path)


def progress_query(spark, sf):
    return naive(metrics.in_progress(requests(spark, sf)), "at")


def progress_stream_query(spark, sf):
    path, state = scratch_path(spark, "progress"), scratch_path(spark, "progress-state")
    changes = metrics.in_progress_changes(shaped(jobs.read_table_stream(spark, sf, "events.parquet")), ["route"])
    jobs.collect_stream(metrics.in_progress_now(changes.filter("change > 0"), ["route"]), path, state).awaitTermination()
    return jobs.newest_result(spark, path)


#: Requests whose number is divisible by it never finish; the others take less than the limit.
NEVER, LIMIT_SECONDS = 97, 600


def request_ends(spark, sf):
    """Starts and finishes of all requests, with an instant of arrival up to 50 minutes later."""
    events = requests(spark, sf).withColumn("duration", F.when(F.col("event_id") % NEVER != 0, F.col("duration")))
    ends = gauge.request_ends(events, "event_id", ["method"])
    late = F.pmod(F.col("request").cast("long") * 7919 + F.length("kind") * 104729, F.lit(3000))
    return ends.withColumn("arrival", F.unix_seconds("at") + late)


def as_three_files(rows, folder):
    """Writes rows in three files, one after the other, by thirds of their span of `arrival`; a stream meets them in that order."""
    first, last = rows.agg(F.min("arrival"), F.max("arrival")).first()
    third = F.floor((F.col("arrival") - first) * 3 / (last - first + 1))
    for number in range(3):
        rows.where(third == number).drop("arrival").coalesce(1).write.mode("append").parquet(folder)


def gauge_changes(spark, sf):
    folder, path, state = (scratch_path(spark, n) for n in ("request-ends", "gauge", "gauge-state"))
    as_three_files(request_ends(spark, sf), folder)
    stream = jobs.read_table_stream(spark, folder, "*.parquet", files_per_batch=1)
    for _ in range(2):  # the second start finds nothing left to do
        gauge.collect_gauge(stream, LIMIT_SECONDS, path, state, ["method"], lateness="1 hour", buckets=32).awaitTermination()
    return spark.read.parquet(path)


def gauge_stream_query(spark, sf):
    """The gauge after each instant, from three files whose rows are out of order."""
    changes = gauge_changes(spark, sf).groupBy("method", "at").agg(F.sum("change").alias("change"))
    running = running_sums(changes, ["at"], ["change"], ["method"]).select("method", "at", F.col("cum_change").alias("in_progress"))
    return naive(running, "at")


def gauge_outcome_query(spark, sf):
    """How requests ended, and how many are still in progress, at the last watermark."""
    return gauge_changes(spark, sf).groupBy("method", "outcome").agg(F.count(F.lit(1)).alias("n"))


def gauge_batch_query(spark, sf):
    """The same changes from the whole table at once."""
    ends = request_ends(spark, sf)
    watermark = ends.agg(F.date_trunc("millisecond", F.max("at")) - F.expr("INTERVAL 1 HOUR")).first()[0]
    return gauge.gauge_changes(ends, LIMIT_SECONDS, watermark).groupBy("method", "outcome").agg(F.count(F.lit(1)).alias("n"))


def late_events(spark, sf):
    """Requests in three files by time; every 41st arrives in the last file, mostly after its window has been finished."""
    events = requests(spark, sf)
    last = events.agg(F.max(F.unix_seconds("ts"))).first()[0]
    arrival = F.when(F.col("event_id") % 41 == 0, F.lit(last)).otherwise(F.unix_seconds("ts"))
    return events.withColumn("arrival", arrival)


WINDOW_KEYS = ("window_start", "route")


def finished_query(spark, sf):
    """Finished and open windows of a stream over three files, with the late rows of each."""
    folder, path, state = (scratch_path(spark, n) for n in ("late-events", "finished", "finished-state"))
    as_three_files(late_events(spark, sf), folder)
    stream = metrics.with_event_time(jobs.read_table_stream(spark, folder, "*.parquet", files_per_batch=1))
    for _ in range(2):  # a restart repeats nothing
        windows.collect_finished(metrics.request_rate(stream, "1 hour"), path, state).awaitTermination()
    finished = windows.finished_windows(spark, path)
    still_open = windows.open_windows(spark, state).withColumnRenamed("count", "requests")
    received = metrics.request_rate(requests(spark, sf), "1 hour")
    late = windows.late_rows(received, finished, still_open, WINDOW_KEYS)
    state_of = finished.select(*WINDOW_KEYS, F.lit("finished").alias("state")).unionByName(still_open.select(*WINDOW_KEYS, F.lit("open").alias("state")))
    return naive(late.join(state_of, list(WINDOW_KEYS), "left"), "window_start").withColumn("state", F.coalesce("state", F.lit("late")))


def upsert_query(spark, sf):
    """Errors per window while three files arrive: one row a window, its newest value; late rows leave finished windows alone."""
    folder, path, state = (scratch_path(spark, n) for n in ("late-events", "upserts", "upserts-state"))
    as_three_files(late_events(spark, sf), folder)
    stream = metrics.with_event_time(jobs.read_table_stream(spark, folder, "*.parquet", files_per_batch=1))
    windows.upsert_stream(metrics.error_fraction(stream, "6 hours"), ["window_start"], path, state).awaitTermination()
    return naive(windows.current_rows(spark, path, ["window_start"]), "window_start").withColumn("error_fraction", rounded("error_fraction"))


def quantile_stream_query(spark, sf):
    """Quantiles of the windows that a stream over three files has finished."""
    folder, path, state = (scratch_path(spark, n) for n in ("late-events", "quantiles", "quantiles-state"))
    as_three_files(late_events(spark, sf), folder)
    stream = metrics.with_event_time(jobs.read_table_stream(spark, folder, "*.parquet", files_per_batch=1))
    out = metrics.histogram_quantile(stream, length="6 hours", by=["route"])
    windows.collect_finished(out, path, state).awaitTermination()
    found = windows.finished_windows(spark, path)
    return naive(found, "window_start").withColumns({c: rounded(F.col(c)) for c in ("p50", "p95", "p99")})


def latest_query(spark, sf):
    return naive(metrics.latest_state(requests(spark, sf), "user_id", "status_code"), "last_seen")


def bounded_query(spark, sf):
    labelled = metrics.bounded_labels(requests(spark, sf), ["view", "click", "purchase"])
    return labelled.groupBy("method", "route").agg(F.count(F.lit(1)).alias("n"))


def dedupe_query(spark, sf):
    """Every event arrives twice; each id is kept once."""
    path, state = scratch_path(spark, "deduped"), scratch_path(spark, "deduped-state")
    twice = jobs.read_table_stream(spark, sf, "events.parquet").select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    once = metrics.dedupe_stream(twice, "event_id")
    query = (
        once.select("event_id").writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema("event_id bigint").parquet(path)


def dedupe_files_query(spark, sf):
    """Every event arrives three times, in three files: the state of the first file's ids drops the later copies."""
    folder, path, state = (scratch_path(spark, n) for n in ("copies", "deduped", "deduped-state"))
    events = table(spark, sf, "events").select("event_id", "ts", F.explode(F.array(*map(F.lit, range(3)))).alias("arrival"))
    as_three_files(events, folder)
    once = metrics.dedupe_stream(jobs.read_table_stream(spark, folder, "*.parquet", files_per_batch=1), "event_id", lateness="3650 days")
    jobs.collect_stream(once.select("event_id"), path, state, "append").awaitTermination()
    return spark.read.parquet(path).select("event_id")


def score_query(spark, sf):
    output, state = scratch_path(spark, "scored"), scratch_path(spark, "scored-state")
    # Written once: sums added up in another order would be another model at the second start.
    centroids = materialize(centroids_of(labelled_embeddings(spark, sf)), "centroids")
    for _ in range(2):  # the second start finds nothing left to do
        stream = jobs.read_table_stream(spark, sf, "embeddings.parquet").select("vec_id", "embedding")
        jobs.score_stream(stream, centroids, output, state, {"source": sf}).awaitTermination()
    return spark.read.parquet(output).select(
        "vec_id", "cluster_id", rounded("assigned_centroid_cosine_similarity", "similarity"), rounded("assignment_margin", "margin"))


def drift_query(spark, sf):
    """Drift of all texts, arriving as a stream, from the English ones."""
    output, state = scratch_path(spark, "drift"), scratch_path(spark, "drift-state")
    reference = jobs.reference_histogram(table(spark, sf, "documents").filter("lang = 'en'"))
    stream = jobs.read_table_stream(spark, sf, "documents.parquet").select("text")
    jobs.drift_stream(stream, reference, output, state).awaitTermination()
    return spark.read.parquet(output).select("feature", "reference_rows", "production_rows", rounded("ks_statistic"), rounded("wasserstein"))


#: Bytes of text in an arriving file: what one task writes.
FILE_BYTES = 64 << 20


def drift_files_query(spark, sf):
    """The same drift with the texts arriving as files in four batches, a file each unless they are large: the last result
    covers all of them."""
    folder, output, state = (scratch_path(spark, n) for n in ("drift-files", "drift", "drift-state"))
    documents = table(spark, sf, "documents")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = 1 + size // (4 * FILE_BYTES)
    documents.select("text").repartition(4 * files, F.xxhash64("doc_id", "text")).write.parquet(folder)
    stream = jobs.read_table_stream(spark, folder, "*.parquet", files_per_batch=files)
    reference = jobs.reference_histogram(documents.filter("lang = 'en'"))
    jobs.drift_stream(stream, reference, output, state).awaitTermination()
    return jobs.newest_result(spark, output).select(
        "feature", "reference_rows", "production_rows", rounded("ks_statistic"), rounded("wasserstein"))


QUERIES = {
    "drift_stream_files": drift_files_query,
    "request_rate": rate_query,
    "request_rate_sliding": sliding_query,
    "request_rate_stream": rate_stream_query,
    "error_fraction": error_query,
    "error_fraction_stream": error_stream_query,
    "duration_histogram": histogram_query,
    "duration_histogram_windowed": windowed_histogram_query,
    "histogram_quantile": quantile_query,
    "lifetime_totals": totals_query,
    "lifetime_totals_stream": totals_stream_query,
    "in_progress": progress_query,
    "requests_started_stream": progress_stream_query,
    "in_progress_stream": gauge_stream_query,
    "in_progress_outcomes_stream": gauge_outcome_query,
    "in_progress_outcomes": gauge_batch_query,
    "finished_windows_stream": finished_query,
    "error_fraction_upserts": upsert_query,
    "histogram_quantile_stream": quantile_stream_query,
    "latest_state": latest_query,
    "bounded_labels": bounded_query,
    "dedupe_stream": dedupe_query,
    "dedupe_stream_files": dedupe_files_query,
    "score_stream": score_query,
    "drift_stream": drift_query,
}

R = """
r AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 'POST' WHEN 'signup' THEN 'BREW' ELSE 'GET' END AS method, event_type AS route,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS duration FROM events)"""
BOUNDS = ", ".join(f"(CAST({b} AS DOUBLE), '{b:g}')" for b in metrics.DURATION_BOUNDS)
RATE = f"""
    WITH {R} SELECT date_trunc('hour', ts) AS window_start, route, count(*) AS requests, round(count(*) / CAST(3600 AS DOUBLE), 6) + 0.0 AS per_second FROM r GROUP BY 1, 2"""
ERRORS = f"""
    WITH {R} SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS requests, count(*) FILTER (WHERE status_code >= 400) AS errors,
      round(count(*) FILTER (WHERE status_code >= 400) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS error_fraction FROM r GROUP BY 1"""


def histogram_sql(keys: str) -> str:
    return f"""
        b AS (SELECT * FROM (VALUES {BOUNDS}, (CAST('inf' AS DOUBLE), '+Inf')) t(bound, le)),
        g AS (SELECT {keys}, count(*) AS count, sum(duration) AS total FROM r GROUP BY ALL),
        h AS (SELECT {keys}, le, count(*) FILTER (WHERE duration <= bound) AS cumulative FROM r, b GROUP BY ALL)"""


SIX_HOURS = ", time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,"
TOTALS = f"WITH {R} SELECT route, method, count(*) AS requests FROM r GROUP BY 1, 2"


def quantile_sql(fraction: float) -> str:
    return (
        f"round(coalesce(min(low + (high - low) * ({fraction} * total - before) / (c - before)) FILTER (WHERE c >= {fraction} * total AND before < {fraction} * total), 300.0), 6) + 0.0"
    )


# Starts, finishes and abandoned requests, up to the watermark one hour (in whole milliseconds) behind the last event.
ENDS = f"""
    {R},
    ends AS (SELECT event_id, method, epoch_us(ts) AS s, CASE WHEN event_id % 97 <> 0 THEN epoch_us(ts) + CAST(round(duration * 1000000) AS BIGINT) END AS f FROM r),
    mark AS (SELECT (greatest(max(s), max(f)) // 1000 - 3600000) * 1000 AS w FROM ends),
    changes AS (
      SELECT method, s AS us, 1 AS change, 'started' AS outcome FROM ends
      UNION ALL SELECT method, f, -1, 'finished' FROM ends WHERE f IS NOT NULL
      UNION ALL SELECT method, s + 600000000, -1, 'abandoned' FROM ends, mark WHERE f IS NULL AND s + 600000000 <= w)"""
OUTCOMES = f"WITH {ENDS} SELECT method, outcome, count(*) AS n FROM changes GROUP BY 1, 2"


def arrivals_sql(window: str) -> str:
    """Rows with their file, window (6 hours or 1) and whether it was closed to them: a batch drops rows by the watermark that the
    batch before it went by, which comes from the files up to the second last."""
    return f"""
        {R},
        span AS (SELECT min(epoch_us(ts) // 1000000) AS a, max(epoch_us(ts) // 1000000) AS b FROM r),
        came AS (SELECT r.*, CASE WHEN event_id % 41 = 0 THEN b ELSE epoch_us(ts) // 1000000 END AS arrival, a, b FROM r, span),
        first_ AS (SELECT *, min(arrival) OVER () AS earliest FROM came),
        filed AS (SELECT *, CAST(floor((arrival - earliest) * 3 / CAST(b - earliest + 1 AS DOUBLE)) AS INTEGER) AS file,
          time_bucket(INTERVAL {window}, ts, TIMESTAMP '1970-01-01') AS window_start FROM first_),
        marks AS (SELECT f.file, max(epoch_us(o.ts)) // 1000 - 600000 AS w FROM (SELECT DISTINCT file FROM filed) f JOIN filed o ON o.file + 1 < f.file GROUP BY f.file),
        judged AS (SELECT filed.*, epoch_ms(window_start + INTERVAL {window}) <= coalesce(w, 0) AS late FROM filed LEFT JOIN marks USING (file)),
        last_ AS (SELECT max(epoch_us(ts)) // 1000 - 600000 AS w FROM r)"""


ORACLES = {
    "in_progress_stream": f"""
        WITH {ENDS}, s AS (SELECT method, us, sum(change) AS d FROM changes GROUP BY 1, 2)
        SELECT method, make_timestamp(us) AS "at", CAST(sum(d) OVER (PARTITION BY method ORDER BY us) AS BIGINT) AS in_progress FROM s""",
    "in_progress_outcomes_stream": OUTCOMES,
    "in_progress_outcomes": OUTCOMES,
    "finished_windows_stream": f"""
        WITH {arrivals_sql('1 HOUR')}
        SELECT window_start, route, count(*) AS received, count(*) FILTER (WHERE NOT late) AS counted, count(*) FILTER (WHERE late) AS late,
          CASE WHEN count(*) FILTER (WHERE NOT late) = 0 THEN 'late' WHEN epoch_ms(window_start + INTERVAL 1 HOUR) <= max(w) THEN 'finished' ELSE 'open' END AS state
        FROM judged, last_ GROUP BY window_start, route""",
    "error_fraction_upserts": f"""
        WITH {arrivals_sql('6 HOUR')}
        SELECT window_start, count(*) AS requests, count(*) FILTER (WHERE status_code >= 400) AS errors,
          round(count(*) FILTER (WHERE status_code >= 400) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS error_fraction FROM judged WHERE NOT late GROUP BY 1""",
    "request_rate": RATE,
    "request_rate_stream": RATE,
    "request_rate_sliding": f"""
        WITH {R}, s AS (SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * o AS window_start, status_code FROM r, range(2) t(o))
        SELECT window_start, status_code, count(*) AS requests, round(count(*) / CAST(7200 AS DOUBLE), 6) + 0.0 AS per_second FROM s GROUP BY 1, 2""",
    "error_fraction": ERRORS,
    "error_fraction_stream": ERRORS,
    "duration_histogram": f"""
        WITH {R}, {histogram_sql('method, route, status_code')}
        SELECT method, route, status_code, count, round(total, 3) + 0.0 AS duration_sum, le, cumulative FROM g JOIN h USING (method, route, status_code)""",
    "duration_histogram_windowed": f"""
        WITH {R.replace(', ts,', ", date_trunc('day', ts) AS window_start,")}, {histogram_sql('window_start, route')}
        SELECT window_start, route, count, round(total, 3) + 0.0 AS duration_sum, le, cumulative FROM g JOIN h USING (window_start, route)""",
    "histogram_quantile": f"""
        WITH {R.replace(', ts,', SIX_HOURS)},
        b AS (SELECT bound AS high, coalesce(lag(bound) OVER (ORDER BY bound), 0) AS low FROM (VALUES {BOUNDS}) t(bound, le)),
        h AS (SELECT window_start, route, low, high, count(*) AS total, CAST(count(*) FILTER (WHERE duration <= high) AS DOUBLE) AS c,
          CAST(count(*) FILTER (WHERE duration <= low AND low > 0) AS DOUBLE) AS before FROM r, b GROUP BY 1, 2, 3, 4)
        SELECT window_start, route, max(total) AS requests, {quantile_sql(0.5)} AS p50, {quantile_sql(0.95)} AS p95, {quantile_sql(0.99)} AS p99 FROM h GROUP BY 1, 2""",
    "lifetime_totals": TOTALS,
    "lifetime_totals_stream": TOTALS,
    "in_progress": f"""
        WITH {R}, c AS (SELECT method, ts AS t, 1 AS d FROM r UNION ALL SELECT method, make_timestamp(epoch_us(ts) + CAST(round(duration * 1000000) AS BIGINT)), -1 FROM r),
        s AS (SELECT method, t, sum(d) AS d FROM c GROUP BY 1, 2)
        SELECT method, t AS "at", CAST(sum(d) OVER (PARTITION BY method ORDER BY t) AS BIGINT) AS in_progress FROM s""",
    "requests_started_stream": "SELECT event_type AS route, count(*) AS in_progress FROM events GROUP BY 1",
    "latest_state": f"""
        WITH {R} SELECT user_id, status_code, ts AS last_seen FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "bounded_labels": f"""
        WITH {R} SELECT CASE WHEN method = 'BREW' THEN 'OTHER' ELSE method END AS method, CASE WHEN route IN ('view', 'click', 'purchase') THEN route ELSE '__unmatched__' END AS route,
          count(*) AS n FROM r GROUP BY 1, 2""",
    "dedupe_stream": "SELECT event_id FROM events",
    "dedupe_stream_files": "SELECT event_id FROM events",
    "score_stream": f"""
        WITH {SQL_CENTROIDS} SELECT vec_id, cluster_id, round(similarity, 6) + 0.0 AS similarity, round(margin, 6) + 0.0 AS margin FROM geometry""",
    "drift_stream": f"""
        WITH {STACKED},
        pooled AS (SELECT 'all' AS cohort, feature, value FROM stacked UNION ALL SELECT 'ref', feature, value FROM stacked WHERE cohort = 'en'),
        hist AS (SELECT feature, value, count(*) FILTER (WHERE cohort = 'ref') AS a, count(*) FILTER (WHERE cohort = 'all') AS b FROM pooled GROUP BY 1, 2),
        cum AS (SELECT feature, value, lead(value) OVER w AS following, sum(a) OVER w / CAST(sum(a) OVER t AS DOUBLE) AS fa, sum(b) OVER w / CAST(sum(b) OVER t AS DOUBLE) AS fb,
          sum(a) OVER t AS na, sum(b) OVER t AS nb FROM hist WINDOW w AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature))
        SELECT feature, CAST(max(na) AS BIGINT) AS reference_rows, CAST(max(nb) AS BIGINT) AS production_rows, round(max(abs(fa - fb)), 6) + 0.0 AS ks_statistic,
          round(sum(abs(fa - fb) * (following - value)), 6) + 0.0 AS wasserstein FROM cum GROUP BY feature""",
}
ORACLES["drift_stream_files"] = ORACLES["drift_stream"]
ORACLES["histogram_quantile_stream"] = ORACLES["histogram_quantile"].replace(f"WITH {R.replace(', ts,', SIX_HOURS)}", f"""
        WITH {arrivals_sql('6 HOUR')}, kept AS (SELECT * FROM judged, last_ WHERE NOT late AND epoch_ms(window_start + INTERVAL 6 HOUR) <= w)""").replace("FROM r, b", "FROM kept, b")
