"""Accounting over the log of replayed prediction requests."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.operators.ordering import describe

# Shape of one logged request.
REQUEST_SCHEMA = """
request_id string, run_id string, kind string, state string, source_row_ids array<string>,
attempts array<struct<timestamp: string, latency_seconds: double, http_status: int, error_category: string>>,
records array<struct<run_id: string, request_id: string, source_row_id: string, source_row_index: bigint,
  cluster_id: int, model_id: string, request_timestamp: string, request_latency_seconds: double,
  success: boolean, http_status: int, error_category: string, attempt_count: int>>
"""


def logged_records(log: DataFrame) -> DataFrame:
    return log.filter(F.col("kind") == "prediction").select(F.inline("records"))


def logged_attempts(log: DataFrame) -> DataFrame:
    return log.select("request_id", "kind", F.inline("attempts"))


def replay_summary(log: DataFrame, selected_reviews: int, elapsed_seconds: float | None = None) -> DataFrame:
    """One row of counts. A request is one log row, so no row has to be exploded for them."""
    prediction = F.col("kind") == "prediction"
    tried = prediction & (F.size("attempts") > 0)
    ids = log.filter(tried).select(F.explode("source_row_ids").alias("id")).distinct().agg(
        F.count(F.lit(1)).alias("attempted_reviews")
    )
    n_good = F.when(prediction, F.size(F.filter("records", lambda r: r["success"]))).otherwise(0)
    n_records = F.when(prediction, F.size("records")).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counted = log.agg(
        total(n_good).alias("successful_reviews"),
        total(n_records).alias("_records"),
        total(F.size("attempts")).alias("http_requests"),
        total(F.when(prediction, F.size("attempts"))).alias("prediction_http_requests"),
        total(F.when(F.col("kind") == "health", F.size("attempts"))).alias("health_http_requests"),
        F.bool_and(F.col("state") == "complete").alias("_complete"),
    )
    elapsed = F.lit(elapsed_seconds).cast("double")
    selected = F.lit(selected_reviews).cast("long")
    covered = (F.col("attempted_reviews") == selected) & F.col("_complete")
    state = (
        F.when(~covered, "interrupted")
        .when(F.col("_records") != F.col("successful_reviews"), "completed_with_errors")
        .otherwise("completed")
    )
    return counted.join(F.broadcast(ids)).select(
        state.alias("state"), selected.alias("selected_reviews"), "attempted_reviews", "successful_reviews",
        (F.col("_records") - F.col("successful_reviews")).alias("failed_reviews"),
        (F.col("attempted_reviews") - F.col("_records")).alias("pending_reviews"),
        (selected - F.col("attempted_reviews")).alias("unattempted_reviews"),
        "http_requests", "prediction_http_requests", "health_http_requests",
        elapsed.alias("total_elapsed_seconds"),
        F.when(elapsed > 0, F.col("successful_reviews") / elapsed).alias("successful_reviews_per_second"),
    )


def latency_summary(log: DataFrame) -> DataFrame:
    """Count, mean, nearest-rank p50 and p95 and maximum of prediction attempt latencies."""
    attempts = logged_attempts(log).filter(F.col("kind") == "prediction")
    return nearest_rank_percentile(attempts, "latency_seconds")


def nearest_rank_percentile(df: DataFrame, value: str, groups=()) -> DataFrame:
    return describe(df, value, groups, (0.5, 0.95, 1), ("p50", "p95", "max"), nearest_rank=True).select(
        *groups, "count", "mean", "p50", "p95", "max"
    )


def cluster_distribution(log: DataFrame) -> DataFrame:
    return logged_records(log).filter("success").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
