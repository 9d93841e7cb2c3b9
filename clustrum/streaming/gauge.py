"""Requests in progress, from a stream of starts and finishes that may come out of order, or never."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from clustrum.streaming.jobs import collect_stream

#: Groups of requests whose state is read and written together; many more than a cluster has cores.
BUCKETS = 256
STARTED, FINISHED, ABANDONED, UNMATCHED = "started", "finished", "abandoned", "unmatched"
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def request_ends(df: DataFrame, request: str = "request_id", by: Sequence[str] = ("method",), start: str = "ts", duration: str = "duration") -> DataFrame:
    """(request, by..., at, kind): a row when a request starts, and one when it finishes if its duration is known."""
    begun = F.col(start).cast("timestamp")
    end = F.timestamp_micros((F.unix_micros(begun) + F.round(F.col(duration) * 1_000_000)).cast("long"))
    ends = df.select(F.col(request).cast("string").alias("request"), *by, F.inline(F.array(
        F.struct(begun.alias("at"), F.lit("start").alias("kind")), F.struct(end.alias("at"), F.lit("finish").alias("kind")))))
    return ends.where("at IS NOT NULL")


def gauge_changes(ends: DataFrame, limit_seconds: float, watermark=None, by: Sequence[str] = ("method",)) -> DataFrame:
    """(by..., at, change, outcome) of a table of starts and finishes, as the stream gives them.

    A request counts from its first start to its first finish, or, where that does not come within the limit, until the limit
    has passed: then it is `abandoned`. A limit that lies after `watermark` (an instant; null: the end of time) has not passed
    yet. A finish without a start is `unmatched` once the limit has passed, and changes nothing.
    """
    limit, until = F.lit(round(limit_seconds * 1_000_000)), F.lit(None if watermark is None else watermark).cast("timestamp")
    micros = lambda kind: F.min(F.when(F.col("kind") == kind, F.unix_micros("at")))
    once = ends.groupBy("request").agg(*(F.first(c).alias(c) for c in by), micros("start").alias("s"), micros("finish").alias("f"))
    deadline = F.coalesce("s", "f") + limit
    in_time = F.coalesce(F.col("f") <= F.col("s") + limit, F.lit(False))
    passed = F.coalesce(deadline <= F.unix_micros(until), F.lit(watermark is None))
    change = lambda at, n, outcome: F.struct(at.alias("us"), F.lit(n).cast("long").alias("change"), F.lit(outcome).alias("outcome"))
    cells = F.array(
        F.when(F.col("s").isNotNull(), change(F.col("s"), 1, STARTED)),
        F.when(F.col("s").isNotNull() & in_time, change(F.col("f"), -1, FINISHED))
        .when(F.col("s").isNotNull() & (passed | F.col("f").isNotNull()), change(deadline, -1, ABANDONED))
        .when(F.col("s").isNull() & passed, change(F.col("f"), 0, UNMATCHED)),
    )
    return once.select(*by, F.inline(F.filter(cells, lambda c: c.isNotNull()))).select(*by, F.timestamp_micros("us").alias("at"), "change", "outcome")


def _processor(by: Sequence[str], limit: int) -> StatefulProcessor:
    names = ["request", *by, "s", "f", "opened", "closed"]

    class OpenRequests(StatefulProcessor):
        """Requests of a bucket, one state row each: kept from its first end until the watermark has passed its last."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            labels = ", ".join(f"`{c}` string" for c in by)
            self.rows = handle.getListState("requests", f"request string, {labels}, s long, f long, opened boolean, closed boolean")

        def close(self) -> None:
            pass

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            fresh = pd.concat(list(rows), ignore_index=True)
            for name, kind in (("s", "start"), ("f", "finish")):
                fresh[name] = fresh["us"].where(fresh["kind"] == kind).astype("Int64")
            fresh["opened"], fresh["closed"] = False, False
            yield from self._settle(pd.concat([self._known(), fresh[names]], ignore_index=True), timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield from self._settle(self._known(), timerValues)

        def _known(self) -> pd.DataFrame:
            known = pd.DataFrame(list(self.rows.get()) if self.rows.exists() else [], columns=names)
            return known.astype({"s": "Int64", "f": "Int64"})

        def _settle(self, seen: pd.DataFrame, timerValues) -> Iterator[pd.DataFrame]:
            """Changes that have become certain; the rest stays, with a timer for the next instant at which something does."""
            if seen.empty:
                return
            watermark = timerValues.getCurrentWatermarkInMs() * 1000
            rules = {**dict.fromkeys(by, "first"), "s": "min", "f": "min", "opened": "max", "closed": "max"}
            one = seen.groupby("request", sort=False, as_index=False).agg(rules).astype({"opened": bool, "closed": bool})
            # Missing times stand beyond all others.
            never = np.int64(1) << 62
            s, f = (one[c].fillna(never).to_numpy(np.int64) for c in ("s", "f"))
            begun, ended = s < never, f < never
            deadline = np.where(begun, np.minimum(s, never - limit), np.minimum(f, never - limit)) + limit
            in_time, passed = begun & ended & (f <= deadline), deadline <= watermark
            opened, closed = one["opened"].to_numpy(), one["closed"].to_numpy()
            finished = in_time & ~closed
            abandoned = begun & ~in_time & (passed | ended) & ~closed
            unmatched = ~begun & passed & ~closed
            for rows, at, change, outcome in (
                (begun & ~opened, s, 1, STARTED), (finished, f, -1, FINISHED), (abandoned, deadline, -1, ABANDONED), (unmatched, f, 0, UNMATCHED),
            ):
                if rows.any():
                    yield one.loc[rows, list(by)].assign(us=at[rows], change=np.int64(change), outcome=outcome)
            one["opened"], one["closed"] = opened | begun, closed | finished | abandoned | unmatched
            # A later copy of an end is late itself once the watermark has passed that end.
            last = np.where(in_time, np.maximum(s, f), np.where(ended & begun, np.maximum(deadline, f), deadline))
            open_ = last > watermark
            if open_.any():
                self.rows.put([tuple(None if pd.isna(x) else x for x in r) for r in one.loc[open_, names].astype(object).itertuples(index=False)])
                self.handle.registerTimer(int(last[open_].min() // 1000 + 1))
            else:
                self.rows.clear()

    return OpenRequests()


def in_progress_stream(ends: DataFrame, limit_seconds: float, by: Sequence[str] = ("method",), lateness: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(by..., at, change, outcome) as an append-only stream: see `gauge_changes`. `ends`: request, by..., at, kind.

    State: one row a request, from its first end until the watermark has passed its finish or its limit, so it does not grow
    with the stream. Ends that come later than the watermark are dropped. Labels are taken as text.
    """
    limit = round(limit_seconds * 1_000_000)
    # Event times of null cannot be ordered and are left out.
    timed = ends.where("at IS NOT NULL AND request IS NOT NULL").withWatermark("at", lateness).select(
        F.pmod(F.xxhash64("request"), F.lit(buckets)).alias("bucket"), "request", *(F.col(c).cast("string").alias(c) for c in by), "at",
        F.unix_micros("at").alias("us"), "kind")
    schema = ", ".join(f"`{c}` string" for c in by) + ", us long, change long, outcome string"
    changes = timed.groupBy("bucket").transformWithStateInPandas(_processor(by, limit), schema, "Append", "eventTime")
    return changes.select(*by, F.timestamp_micros("us").alias("at"), "change", "outcome")


def collect_gauge(ends: DataFrame, limit_seconds: float, path: str, state: str, by: Sequence[str] = ("method",), **options) -> StreamingQuery:
    """Runs `in_progress_stream` over what is there now; each batch leaves its changes under `path`, and a repeated batch
    replaces its own. The state store that timers and list state need is set for this query only."""
    spark = ends.sparkSession
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        return collect_stream(in_progress_stream(ends, limit_seconds, by, **options), path, state, "append")
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)
