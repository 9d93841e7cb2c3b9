"""The replay log: one JSON document per request."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrum.operators.cleaning import ContractError
from clustrum.operators.requests import REQUEST_SCHEMA


def read_request_log(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Typed log rows; `multi_line` for pretty-printed single-request files."""
    return spark.read.schema(REQUEST_SCHEMA).json(path, multiLine=multi_line, mode="FAILFAST")


def write_request_log(log: DataFrame, path: str) -> None:
    log.write.json(path, mode="errorifexists", ignoreNullFields=False)


def log_violations(log: DataFrame, plan: DataFrame, run_id: str) -> DataFrame:
    """`request_id`, `reason` for every log row that contradicts the plan.

    `plan`: request_id, source_row_ids (in order). A plan row is one bounded batch.
    """
    wanted = plan.select("request_id", F.col("source_row_ids").alias("_planned"))
    rows = log.join(wanted, "request_id", "left")
    batch = F.col("kind") == "prediction"
    ids = F.transform("records", lambda r: r["source_row_id"])
    complete = F.col("state") == "complete"
    bad_record = F.exists(
        "records",
        lambda r: (r["run_id"] != run_id) | (r["request_id"] != F.col("request_id"))
        | (r["success"] & ~(r["http_status"].eqNullSafe(F.lit(200)) & r["error_category"].isNull())),
    )
    reasons = F.array(
        F.when(~F.col("kind").isin("prediction", "health"), "unknown_kind"),
        F.when(batch & ~F.col("request_id").rlike("^batch-[0-9]{6,}$"), "bad_batch_name"),
        F.when(batch & F.col("_planned").isNull(), "unplanned_batch"),
        F.when(batch & (F.col("_planned") != F.col("source_row_ids")), "plan_mismatch"),
        F.when(~F.coalesce(F.col("run_id") == run_id, F.lit(False)), "other_run"),
        F.when(~F.col("state").isin("pending", "complete"), "unknown_state"),
        F.when(batch & (F.col("state") == "pending") & (F.size("records") > 0), "pending_with_records"),
        F.when(batch & complete & (F.size("records") != F.size("source_row_ids")), "incomplete_batch"),
        F.when(batch & complete & (F.size("records") == F.size("source_row_ids")) & (ids != F.col("source_row_ids")), "record_order"),
        F.when(batch & bad_record, "inconsistent_record"),
    )
    found = rows.select("request_id", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))
    repeated = log.groupBy("request_id").count().filter("count > 1").select("request_id", F.lit("repeated_request").alias("reason"))
    return found.unionByName(repeated)


def check_request_log(log: DataFrame, plan: DataFrame, run_id: str) -> DataFrame:
    first = log_violations(log, plan, run_id).limit(1).collect()
    if first:
        raise ContractError(f"request log refused: {first[0].reason} in {first[0].request_id}")
    return log
