"""Session settings and the shared folder in which long lineages are cut."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "clustrum", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; `conf` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir`, which all executors can reach.

    Only a local-mode session without that setting (tests) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="clustrum-")
    return _LOCAL_DIRS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path under the shared folder; never one that exists."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a scanned table over all cores when its files give fewer splits than there are cores.

    CPU-bound text work on one small or single-row-group file would otherwise run in one task. A large
    table has splits enough and is returned as it is. `key` should be unique, so that no task is hot.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def table_bytes(written: DataFrame) -> int:
    """Bytes of all rows as text, with 16 bytes a value on top; reads the table once."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in written.columns), F.lit(0))
    return written.agg(F.sum(width.cast("long"))).first()[0] or 0


def checked_broadcast(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """`df` written out, with a broadcast hint only when its rows turned out to fit into `max_bytes`; beyond that the planner
    joins it by shuffling."""
    table = materialize(df, "join-side")
    return F.broadcast(table) if table_bytes(table) <= max_bytes else table


def bounded_collect(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a model or report on the driver; refuses instead of pulling more than `max_rows`."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} {what}")
    return rows


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the written table.

    Lost executors then cost a re-read, not a recomputation, and values that depend on the
    partitioning (row positions) are fixed for good.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
