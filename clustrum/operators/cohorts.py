"""Cohorts: splits, batch plans, overlap audits and alignment of predictions with their source."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrum.functions.text import clean_text, text_digest
from clustrum.operators.ordering import global_index, rows_at_ranks


def chronological_split(
    df: DataFrame,
    date: str,
    id_column: str,
    sizes: Mapping[str, float],
    rest: str = "final",
    name: str = "cohort",
) -> DataFrame:
    """Cohorts in (date, id) order, null dates last. Sizes below 1 are shares of all rows, others row counts.

    Only the boundary rows are looked up; every row is then labelled by comparing with them, so
    the table itself is neither sorted nor shuffled.
    """
    total = df.count() if any(s < 1 for s in sizes.values()) else None
    ends, end = [], 0
    for cohort, size in sizes.items():
        end += int(total * size + 1e-9) if size < 1 else int(size)
        ends.append((cohort, end))
    found = rows_at_ranks(df, date, id_column, [e - 1 for _, e in ends if e > 0])
    label: Column | None = None
    types = (df.schema[date].dataType, df.schema[id_column].dataType)
    bounds = iter(found)
    for cohort, end in ends:
        if end <= 0:
            continue
        bound = next(bounds, None)
        if bound is None:  # the table ends before this cohort does
            condition = F.lit(True)
        else:
            last_date, last_id = F.lit(bound[0]).cast(types[0]), F.lit(bound[1]).cast(types[1])
            if bound[0] is None:
                condition = F.col(date).isNotNull() | (F.col(id_column) <= last_id)
            else:
                condition = (F.col(date) < last_date) | ((F.col(date) == last_date) & (F.col(id_column) <= last_id))
        label = F.when(condition, cohort) if label is None else label.when(condition, cohort)
    return df.withColumn(name, F.lit(rest) if label is None else label.otherwise(rest))


def source_row_index(df: DataFrame, order: Sequence[str], name: str = "source_row_index") -> DataFrame:
    return global_index(df, order, name)


def batch_plan(indexed: DataFrame, size: int, index: str = "source_row_index") -> DataFrame:
    """Adds `batch_index` and `request_id` (`batch-000000`, ...) from a 0-based row index."""
    if not 1 <= size <= 64:
        raise ValueError("batch size has to be 1 to 64")
    number = F.floor(F.col(index) / size)
    return indexed.withColumn("batch_index", number).withColumn(
        "request_id", F.format_string("batch-%06d", F.col("batch_index"))
    )


def remaining_batches(plan: DataFrame, log: DataFrame) -> DataFrame:
    """Planned batches that no completed request covers."""
    done = log.filter(F.col("state") == "complete").select("request_id").distinct()
    return plan.select("request_id").distinct().join(done, "request_id", "left_anti")


def shared_ids(left: DataFrame, right: DataFrame, id_column: str) -> DataFrame:
    """Ids present on both sides, once each."""
    return left.select(id_column).intersect(right.select(id_column))


def cohort_id_overlap(final: DataFrame, cohorts: DataFrame, id_column: str, cohort: str = "cohort") -> DataFrame:
    """Per cohort: how many distinct ids of `final` it shares (0 when none)."""
    ids = final.select(id_column).distinct()
    hits = cohorts.select(cohort, id_column).distinct().join(
        ids.withColumn("_hit", F.lit(1)), id_column, "left"
    )
    return hits.groupBy(cohort).agg(F.count("_hit").alias("overlapping_ids"))


def cohort_text_overlap(final: DataFrame, cohorts: DataFrame, text: str = "text", cohort: str = "cohort") -> DataFrame:
    """Per cohort: rows (not distinct texts) of `final` whose stripped text occurs in it.

    Both sides are reduced to one row per text before they meet, so a text copied into a third of
    all rows is one join row.
    """
    digest = text_digest(clean_text(text)).alias("_digest")
    rows = final.select(digest).groupBy("_digest").agg(F.count(F.lit(1)).alias("_rows"))
    known = cohorts.select(cohort, digest).distinct()
    return known.join(rows, "_digest", "left").groupBy(cohort).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("matching_text_rows")
    )


def cohort_audit(final: DataFrame, cohorts: DataFrame, id_column: str, text: str = "text", cohort: str = "cohort") -> DataFrame:
    """One row per cohort: rows, id overlap, text overlap and an order-free content fingerprint."""
    sizes = cohorts.groupBy(cohort).agg(F.count(F.lit(1)).alias("cohort_rows"), *fingerprint_columns([id_column, text]))
    return (
        sizes.join(cohort_id_overlap(final, cohorts, id_column, cohort), cohort)
        .join(cohort_text_overlap(final, cohorts, text, cohort), cohort)
        .withColumn("disjoint", F.col("overlapping_ids") == 0)
    )


def fingerprint_columns(columns: Sequence[str]) -> list[Column]:
    """Order-free digest: the 256-bit row hashes summed and xor-ed in eight 32-bit limbs."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    limb = lambda i: F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")
    total = F.concat_ws("-", *(F.sum(limb(i)).cast("string") for i in range(8)))
    mixed = F.concat_ws("-", *(F.bit_xor(limb(i).cast("long")).cast("string") for i in range(8)))
    return [F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total, mixed), 256).alias("fingerprint")]


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """Count and fingerprint of a table or of each group; equal whatever the row order or partitioning."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), *fingerprint_columns(columns or df.columns)
    )


def row_digests(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    return df.select(id_column, text_digest(clean_text(text)).alias("text_digest"))


def align_predictions(
    source: DataFrame, records: DataFrame, model_id: str, n_clusters: int, allow_subset: bool = False
) -> DataFrame:
    """One row of coverage counts and violation counts for recorded predictions of `source`.

    `source`: source_row_id, source_row_index. `records`: those and model_id, success, cluster_id.
    Records are first reduced to one row per id, so repeated ids cannot multiply rows or heat a task.
    """
    good = F.col("success")
    in_range = F.col("cluster_id").between(0, n_clusters - 1)
    per_id = records.groupBy("source_row_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("source_row_index").alias("low_index"),
        F.max("source_row_index").alias("high_index"),
        F.count_if(F.col("source_row_index").isNull()).alias("no_index"),
        F.count_if(~F.coalesce(F.col("model_id") == model_id, F.lit(False))).alias("wrong_model"),
        F.count_if(good.isNull()).alias("bad_flag"),
        F.count_if(good & ~F.coalesce(in_range, F.lit(False))).alias("bad_label"),
        F.count_if(~good & F.col("cluster_id").isNotNull()).alias("failed_with_cluster"),
        F.count_if(good).alias("succeeded"),
    )
    known = source.select("source_row_id", F.col("source_row_index").alias("expected_index"))
    joined = known.join(per_id, "source_row_id", "full_outer")
    recorded, matched = F.col("copies").isNotNull(), F.col("expected_index").isNotNull()
    off = (
        (F.col("low_index") != F.col("expected_index")) | (F.col("high_index") != F.col("expected_index"))
        | (F.col("no_index") > 0)
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = joined.agg(
        F.count_if(matched).alias("dataset_rows"),
        F.count_if(recorded).alias("recorded_rows"),
        F.count_if(F.col("succeeded") > 0).alias("successful_rows"),
        F.count_if(recorded & (F.col("succeeded") == 0)).alias("failed_rows"),
        F.count_if(matched & ~recorded).alias("missing_rows"),
        F.count_if(recorded & ~matched).alias("unknown_ids"),
        F.count_if(F.col("copies") > 1).alias("duplicate_ids"),
        F.count_if(matched & recorded & off).alias("index_mismatches"),
        total("wrong_model").alias("wrong_models"),
        total("bad_flag").alias("invalid_flags"),
        total("bad_label").alias("invalid_labels"),
        total("failed_with_cluster").alias("failed_with_cluster"),
    )
    subset = F.col("successful_rows") != F.col("dataset_rows")
    violations = sum(
        (F.col(c) for c in ("duplicate_ids", "index_mismatches", "wrong_models", "invalid_flags",
                            "invalid_labels", "failed_with_cluster")), F.col("unknown_ids"),
    )
    accepted = (violations == 0) & (F.col("successful_rows") > 0)
    return counts.withColumn("subset", subset).withColumn(
        "accepted", accepted if allow_subset else accepted & ~subset
    )


def prediction_violations(source: DataFrame, records: DataFrame, model_id: str, n_clusters: int) -> DataFrame:
    """The offending records themselves: `source_row_id`, `reason`, `n`."""
    good = F.col("success")
    known = source.select("source_row_id", F.col("source_row_index").alias("_expected"))
    # Sources are unique per id, so a repeated record id can only skew the record side, which the
    # join may split.
    checked = records.join(known, "source_row_id", "left").select(
        "source_row_id",
        F.filter(
            F.array(
                F.when(F.col("_expected").isNull(), "unknown_id"),
                F.when(F.col("source_row_index") != F.col("_expected"), "index_mismatch"),
                F.when(~F.coalesce(F.col("model_id") == model_id, F.lit(False)), "wrong_model"),
                F.when(good.isNull(), "invalid_flag"),
                F.when(good & ~F.coalesce(F.col("cluster_id").between(0, n_clusters - 1), F.lit(False)), "invalid_label"),
                F.when(~good & F.col("cluster_id").isNotNull(), "failed_with_cluster"),
            ),
            lambda r: r.isNotNull(),
        ).alias("reasons"),
    )
    listed = checked.select("source_row_id", F.explode("reasons").alias("reason"))
    repeated = records.groupBy("source_row_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        listed.groupBy("source_row_id", "reason").agg(F.count(F.lit(1)).alias("n"))
        .unionByName(repeated.select("source_row_id", F.lit("duplicate_id").alias("reason"), "n"))
    )


def join_text_to_predictions(source: DataFrame, predictions: DataFrame, n_clusters: int) -> DataFrame:
    """Predictions with their review text; stops on a cluster, similarity or margin out of range."""
    similarity, margin = F.col("assigned_centroid_cosine_similarity"), F.col("assignment_margin")
    valid = F.coalesce(
        F.col("cluster_id").between(0, n_clusters - 1) & similarity.between(-1, 1) & margin.between(0, 2),
        F.lit(False),
    )
    cluster = F.when(valid, F.col("cluster_id")).otherwise(
        F.raise_error(F.lit("invalid geometry or cluster")).cast("int")
    )
    return source.join(predictions.withColumn("cluster_id", cluster), "source_row_id").select(
        "source_row_id", "cluster_id", "assigned_centroid_cosine_similarity", "assignment_margin", "review_text"
    )


def coverage_gaps(source: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ids that are not on both sides exactly once; empty when coverage is 1:1."""
    sides = source.select("source_row_id", F.lit(1).alias("s"), F.lit(0).alias("p")).unionAll(
        predictions.select("source_row_id", F.lit(0).alias("s"), F.lit(1).alias("p"))
    )
    counted = sides.groupBy("source_row_id").agg(F.sum("s").alias("source_rows"), F.sum("p").alias("prediction_rows"))
    return counted.filter("source_rows != 1 or prediction_rows != 1")
