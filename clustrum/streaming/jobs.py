"""Long-running jobs: scoring arriving reviews and watching their drift."""
from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clustrum.functions.vectors import centroid_matrix
from clustrum.operators import drift
from clustrum.operators.cleaning import ContractError, text_features
from clustrum.operators.cohorts import table_fingerprint
from clustrum.operators.geometry import assignment_geometry
from clustrum.streaming.runs import RunStore


def read_table_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of one table in a folder of several, or below the table's own folder where it is one. The schema is the one of the
    files already there."""
    if _is_folder(spark, own := os.path.join(folder, pattern)):
        folder, pattern = own, "*"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def check_plan(spark: SparkSession, path: str, plan: dict) -> None:
    """Writes the plan of a new run; a resumed run has to bring the same one."""
    compact = json.dumps(plan, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    digest = hashlib.sha256(compact.encode()).hexdigest()
    known = spark.read.schema("digest string, plan string").json(path).first() if _exists(spark, path) else None
    if known is None:
        spark.createDataFrame([(digest, compact)], "digest string, plan string").coalesce(1).write.json(path, mode="errorifexists")
    elif known.digest != digest:
        raise ContractError("incompatible resume: input, model or plan changed")


def write_batch(rows: DataFrame, output: str, batch_id: int) -> None:
    """One folder per batch: a batch that is run again replaces itself and nothing else."""
    rows.write.mode("overwrite").parquet(os.path.join(output, f"batch_id={batch_id}"))


def score_stream(
    stream: DataFrame,
    centroids: DataFrame,
    output: str,
    state: str,
    plan: dict,
    vector: str = "embedding",
    columns: tuple[str, ...] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Assigns arriving rows to the frozen centroids; each input file is scored once.

    The centroids are read once, at the start; their digest is part of the checked plan. `plan` names what else must not
    change between starts (source, model id, options).
    """
    spark = stream.sparkSession
    matrix = centroid_matrix(centroids)
    model = hashlib.sha256(matrix.tobytes()).hexdigest()
    check_plan(spark, os.path.join(state, "plan"), {**plan, "centroids_sha256": model})

    def score(batch: DataFrame, batch_id: int) -> None:
        scored = assignment_geometry(batch, matrix, vector).withColumn("model_sha256", F.lit(model))
        write_batch(scored.select(
            *(columns or [c for c in batch.columns if c != vector]), "cluster_id",
            "assigned_centroid_cosine_similarity", "assigned_centroid_cosine_distance", "assignment_margin", "model_sha256",
        ), output, batch_id)

    return (
        stream.writeStream.foreachBatch(score)
        .option("checkpointLocation", os.path.join(state, "checkpoint"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drift_stream(
    stream: DataFrame,
    reference: DataFrame,
    output: str,
    state: str,
    text: str = "text",
    resamples: int = 0,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Per batch: distances of all text features that have arrived so far from a frozen reference, optionally tested.

    `reference`: feature, value, n. It is written under `state` at the first start and its digest is part of the checked plan;
    later starts have to bring the same one. Each batch adds its histogram to a levelled store under `state`, and all
    that the store holds is compared, so the last result covers the whole stream however its files fell into batches, and a batch
    reads a few merged runs instead of every earlier batch. With
    `resamples` come p-values with the Holm adjustment and both flags.
    """
    spark, kept = stream.sparkSession, os.path.join(state, "reference")
    if not _exists(spark, os.path.join(kept, "_SUCCESS")):
        reference.select("feature", "value", "n").write.mode("overwrite").parquet(kept)
    frozen = spark.read.parquet(kept)
    brought, digest = (table_fingerprint(r, ["feature", "value", "n"]).first().fingerprint for r in (reference, frozen))
    if brought != digest:
        raise ContractError("incompatible resume: the reference changed")
    check_plan(spark, os.path.join(state, "plan"), {"reference": digest, "text": text, "resamples": resamples})
    arrivals = RunStore(
        spark, os.path.join(state, "arrivals"), lambda runs: runs.groupBy("feature", "value").agg(F.sum("n").alias("n")))

    def compare(batch: DataFrame, batch_id: int) -> None:
        arrived = drift.stack_features(text_features(batch, text).withColumn("cohort", F.lit("production")))
        arrivals.add(arrived.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), batch_id)
        so_far = arrivals.read()
        zero = F.lit(0).cast("long")
        pooled = frozen.select("feature", "value", F.col("n").alias("a"), zero.alias("b")).unionByName(
            so_far.select("feature", "value", zero.alias("a"), F.col("n").alias("b"))
        ).groupBy("feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        running = drift.with_running_counts(pooled)
        rows = drift.distribution_distances(running)
        if resamples:
            tested = drift.permutation_test(running, drift.KOLMOGOROV_SMIRNOV, resamples)
            rows = rows.join(tested.select("feature", "p_value"), "feature").withColumns({
                "effect_size": F.col("ks_statistic"), "practical_threshold": F.lit(drift.PRACTICAL_THRESHOLD)})
            rows = drift.holm_adjust(rows)
        write_batch(rows, output, batch_id)

    return (
        stream.writeStream.foreachBatch(compare)
        .option("checkpointLocation", os.path.join(state, "checkpoint"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def reference_histogram(df: DataFrame, text: str = "text") -> DataFrame:
    stacked = drift.stack_features(text_features(df, text).withColumn("cohort", F.lit("reference")))
    return stacked.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def collect_stream(result: DataFrame, path: str, state: str, mode: str = "complete") -> StreamingQuery:
    """Runs an aggregating stream over what is there now. Each batch writes a version of the result, under `path`; a failed
    write leaves the earlier versions as they are. `newest_result` reads the last one."""
    def store(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return (
        result.writeStream.foreachBatch(store).outputMode(mode)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )


def newest_result(spark: SparkSession, path: str) -> DataFrame:
    """The result of the last finished batch of `collect_stream`."""
    versions = spark.read.parquet(path)
    last = versions.agg(F.max("batch_id")).first()[0]
    return versions.filter(F.col("batch_id") == last).drop("batch_id")
