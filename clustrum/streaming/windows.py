"""Windows of a stream: finished ones once, open ones as they change, and an account of late rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clustrum.streaming.jobs import collect_stream
from clustrum.streaming.runs import RunStore


def collect_finished(result: DataFrame, path: str, state: str) -> StreamingQuery:
    """Writes each window once, when the watermark has passed its end: append mode, one folder a batch. The state holds open
    windows only; a batch that is run again replaces its own folder."""
    return collect_stream(result, path, state, "append")


def finished_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch_id")


def open_windows(spark: SparkSession, state: str) -> DataFrame:
    """The windows that the state of a stopped query still holds: window_start, window_end, its other keys, and its values."""
    rows = spark.read.format("statestore").load(state)
    keys = [c for c in rows.schema["key"].dataType.names if c != "window"]
    return rows.select(
        F.col("key.window.start").alias("window_start"), F.col("key.window.end").alias("window_end"), *(F.col(f"key.{k}").alias(k) for k in keys), "value.*")


def newest_per_key(keys: Sequence[str]):
    """Merge rule of the upsert sink: of the rows of a key the one of the last batch."""
    def merge(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "written_by").alias("row")).select(*keys, "row.*")

    return merge


def upsert_stream(result: DataFrame, keys: Sequence[str], path: str, state: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the newest value of every key (window and labels) while windows change: update mode into a levelled store, in which
    a key's later row replaces its earlier one. `current_rows` reads it; no batch rewrites what did not change."""
    spark = result.sparkSession
    store = RunStore(spark, path, newest_per_key(keys))

    def put(batch: DataFrame, batch_id: int) -> None:
        store.add(batch.withColumn("written_by", F.lit(batch_id).cast("long")), batch_id)

    return (
        result.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", state)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return RunStore(spark, path, newest_per_key(keys)).read().drop("written_by")


def late_rows(received: DataFrame, finished: DataFrame, still_open: DataFrame, keys: Sequence[str], count: str = "requests") -> DataFrame:
    """(keys, received, counted, late) per window and label: rows that came after the watermark had passed their window.

    `received` counts all rows of the source by `keys`; `finished` and `still_open` those that the stream counted.
    """
    counted = finished.select(*keys, F.col(count).alias("counted")).unionByName(still_open.select(*keys, F.col(count).alias("counted")))
    counted = counted.groupBy(*keys).agg(F.sum("counted").alias("counted"))
    joined = received.select(*keys, F.col(count).alias("received")).join(counted, list(keys), "left")
    n = F.coalesce("counted", F.lit(0).cast("long"))
    return joined.select(*keys, "received", n.alias("counted"), (F.col("received") - n).alias("late"))
