"""Queries over a replay log derived from `events`: 16 events make a batch, an error event fails."""
from __future__ import annotations

from pyspark.sql import functions as F

from clustrum.operators import requests
from clustrum.operators.cohorts import remaining_batches
from clustrum.plans.common import rounded, table

BATCH = 16


def request_log(spark, sf):
    """One row per batch of 16 consecutive events; a batch is the bounded unit of a request."""
    events = table(spark, sf, "events")
    failed = F.col("event_type") == "error"
    request_id = F.format_string("batch-%06d", F.floor(F.col("event_id") / BATCH))
    latency = F.col("value") / 1000
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    record = F.struct(
        F.lit("run-1").alias("run_id"), request_id.alias("request_id"), F.col("event_id").cast("string").alias("source_row_id"),
        F.col("event_id").alias("source_row_index"),
        F.when(~failed, F.pmod("user_id", F.lit(10)).cast("int")).alias("cluster_id"), F.lit("model-1").alias("model_id"),
        stamp.alias("request_timestamp"), latency.alias("request_latency_seconds"), (~failed).alias("success"),
        F.when(failed, 500).otherwise(200).alias("http_status"), F.when(failed, "http_error").alias("error_category"),
        F.lit(1).alias("attempt_count"),
    )
    rows = events.select(request_id.alias("request_id"), "event_id", stamp.alias("stamp"), latency.alias("latency"), failed.alias("failed"), record.alias("record"))
    return rows.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "record"))).alias("_r"),
        F.min("stamp").alias("stamp"), F.max("latency").alias("latency"), F.bool_or("failed").alias("failed"),
    ).select(
        "request_id", F.lit("run-1").alias("run_id"), F.lit("prediction").alias("kind"), F.lit("complete").alias("state"),
        F.transform("_r", lambda r: r["event_id"].cast("string")).alias("source_row_ids"),
        F.array(F.struct(
            F.col("stamp").alias("timestamp"), F.col("latency").alias("latency_seconds"),
            F.when(F.col("failed"), 500).otherwise(200).alias("http_status"),
            F.when(F.col("failed"), "http_error").alias("error_category"),
        )).alias("attempts"),
        F.transform("_r", lambda r: r["record"]).alias("records"),
    )


def partial_log(spark, sf):
    """The same log with the batches of slow requests still pending."""
    return request_log(spark, sf).withColumn("_slow", F.col("attempts")[0]["latency_seconds"] > 0.25).withColumns({
        "state": F.when(F.col("_slow"), "pending").otherwise(F.col("state")),
        "records": F.when(F.col("_slow"), F.slice("records", 1, 0)).otherwise(F.col("records")),
    }).drop("_slow")


def summary_query(spark, sf):
    selected = table(spark, sf, "events").count()
    return requests.replay_summary(partial_log(spark, sf), selected, 100.0).withColumn(
        "successful_reviews_per_second", rounded("successful_reviews_per_second"))


def latency_query(spark, sf):
    out = requests.latency_summary(request_log(spark, sf))
    return out.select("count", *(rounded(c) for c in ("mean", "p50", "p95", "max")))


def percentile_query(spark, sf):
    out = requests.nearest_rank_percentile(table(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_type", "count", *(rounded(c) for c in ("mean", "p50", "p95", "max")))


def distribution_query(spark, sf):
    return requests.cluster_distribution(request_log(spark, sf))


def records_query(spark, sf):
    return requests.logged_records(request_log(spark, sf)).select(
        "source_row_id", "request_id", "cluster_id", "success", "http_status", rounded("request_latency_seconds", "latency")
    )


def remaining_query(spark, sf):
    plan = table(spark, sf, "events").select(F.format_string("batch-%06d", F.floor(F.col("event_id") / BATCH)).alias("request_id"))
    return remaining_batches(plan, partial_log(spark, sf))


QUERIES = {
    "replay_summary": summary_query,
    "latency_summary": latency_query,
    "nearest_rank_percentile": percentile_query,
    "cluster_distribution": distribution_query,
    "logged_records": records_query,
    "remaining_batches": remaining_query,
}

BATCHES = """
batches AS (
  SELECT event_id // 16 AS b, max(value) / 1000 AS latency, max(value) / 1000 > 0.25 AS slow, count(*) AS n,
    count(*) FILTER (WHERE event_type <> 'error') AS good FROM events GROUP BY 1
)"""

ORACLES = {
    "replay_summary": f"""
        WITH {BATCHES}
        SELECT 'interrupted' AS state, CAST(sum(n) AS BIGINT) AS selected_reviews, CAST(sum(n) AS BIGINT) AS attempted_reviews,
          CAST(coalesce(sum(good) FILTER (WHERE NOT slow), 0) AS BIGINT) AS successful_reviews,
          CAST(coalesce(sum(n - good) FILTER (WHERE NOT slow), 0) AS BIGINT) AS failed_reviews,
          CAST(coalesce(sum(n) FILTER (WHERE slow), 0) AS BIGINT) AS pending_reviews, CAST(0 AS BIGINT) AS unattempted_reviews,
          count(*) AS http_requests, count(*) AS prediction_http_requests, CAST(0 AS BIGINT) AS health_http_requests,
          CAST(100 AS DOUBLE) AS total_elapsed_seconds,
          round(coalesce(sum(good) FILTER (WHERE NOT slow), 0) / CAST(100 AS DOUBLE), 6) + 0.0 AS successful_reviews_per_second
        FROM batches""",
    "latency_summary": f"""
        WITH {BATCHES}
        SELECT count(*) AS count, round(avg(latency), 6) + 0.0 AS mean, round(quantile_disc(latency, 0.5), 6) + 0.0 AS p50,
          round(quantile_disc(latency, 0.95), 6) + 0.0 AS p95, round(max(latency), 6) + 0.0 AS max FROM batches""",
    "nearest_rank_percentile": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, count(*) AS count, round(avg(value), 6) + 0.0 AS mean,
          round(max(value) FILTER (WHERE i = ceil(CAST(0.5 AS DOUBLE) * n)), 6) + 0.0 AS p50,
          round(max(value) FILTER (WHERE i = ceil(CAST(0.95 AS DOUBLE) * n)), 6) + 0.0 AS p95, round(max(value), 6) + 0.0 AS max
        FROM r GROUP BY event_type""",
    "cluster_distribution": """
        SELECT CAST(user_id % 10 AS INTEGER) AS cluster_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1""",
    "logged_records": """
        SELECT CAST(event_id AS VARCHAR) AS source_row_id, printf('batch-%06d', event_id // 16) AS request_id,
          CASE WHEN event_type <> 'error' THEN CAST(user_id % 10 AS INTEGER) END AS cluster_id, event_type <> 'error' AS success,
          CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status, round(value / 1000, 6) + 0.0 AS latency FROM events""",
    "remaining_batches": f"WITH {BATCHES} SELECT printf('batch-%06d', b) AS request_id FROM batches WHERE slow",
}
