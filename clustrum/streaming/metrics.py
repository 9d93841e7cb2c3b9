"""Request metrics per time window. Each function takes a batch or a streaming DataFrame of requests
(event time, method, route, status, duration); call `with_event_time` first on a stream."""
from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrum.operators.ordering import running_sums

# Known HTTP methods and the bucket bounds of the duration histogram, in seconds.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE", "CONNECT")
DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
OTHER_METHOD, UNMATCHED_ROUTE = "OTHER", "__unmatched__"


def with_event_time(df: DataFrame, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Event time as a zoned timestamp with a watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def bounded_labels(df: DataFrame, routes: Sequence[str], method: str = "method", route: str = "route") -> DataFrame:
    """Unknown methods and routes collapse, so that labels cannot grow with the traffic."""
    return df.withColumns({
        method: F.when(F.col(method).isin(*METHODS), F.col(method)).otherwise(OTHER_METHOD),
        route: F.when(F.col(route).isin(*routes), F.col(route)).otherwise(UNMATCHED_ROUTE),
    })


def _seconds(duration: str) -> int:
    number, unit = re.fullmatch(r"(\d+) (second|minute|hour|day)s?", duration).groups()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]


def _windowed(df: DataFrame, ts: str, length: str, slide: str | None, by: Sequence[str]):
    return df.groupBy(F.window(ts, length, slide), *by)


def _starts(*rest: Column | str) -> list:
    return [F.col("window.start").alias("window_start"), *rest]


def request_rate(df: DataFrame, length: str = "5 minutes", by: Sequence[str] = ("route",), slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Requests per second and window, tumbling or (with `slide`) sliding."""
    return _windowed(df, ts, length, slide, by).agg(F.count(F.lit(1)).alias("requests")).select(
        *_starts(*by, "requests", (F.col("requests") / _seconds(length)).alias("per_second"))
    )


def error_fraction(df: DataFrame, length: str = "5 minutes", by: Sequence[str] = (), slide: str | None = None, ts: str = "ts", status: str = "status_code") -> DataFrame:
    """Share of 4xx and 5xx; a window without traffic has no row."""
    failed = F.col(status).cast("string").rlike("^[45]..$")
    return _windowed(df, ts, length, slide, by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("errors")
    ).select(*_starts(*by, "requests", "errors", (F.col("errors") / F.col("requests")).alias("error_fraction")))


def _bucket_counts(duration: str) -> list[Column]:
    return [F.count_if(F.col(duration) <= b).alias(f"le{i}") for i, b in enumerate(DURATION_BOUNDS)] + [
        F.count(duration).alias("total"), F.sum(duration).alias("duration_sum"),
    ]


def duration_histogram(df: DataFrame, length: str | None = None, by: Sequence[str] = ("method", "route", "status_code"), duration: str = "duration", ts: str = "ts") -> DataFrame:
    """Cumulative bucket counts with sum: one row per label set and bound, `+Inf` last.

    All bounds are counted in one aggregate row; the rows per bound are made after the shuffle.
    """
    grouped = _windowed(df, ts, length, None, by) if length else df.groupBy(*by)
    counted = grouped.agg(*_bucket_counts(duration))
    bounds = [(f"{b:g}", f"le{i}") for i, b in enumerate(DURATION_BOUNDS)] + [("+Inf", "total")]
    cells = F.array(*(F.struct(F.lit(le).alias("le"), F.col(c).alias("cumulative")) for le, c in bounds))
    keys = _starts(*by) if length else list(by)
    return counted.select(*keys, F.col("total").alias("count"), "duration_sum", F.inline(cells))


def histogram_quantile(df: DataFrame, fractions: Sequence[float] = (0.5, 0.95, 0.99), length: str = "5 minutes", by: Sequence[str] = (), duration: str = "duration", ts: str = "ts") -> DataFrame:
    """Quantiles estimated from the buckets: linear inside a bucket, the highest finite bound beyond."""
    counted = _windowed(df, ts, length, None, by).agg(*_bucket_counts(duration))
    buckets = []
    for i, bound in enumerate(DURATION_BOUNDS):
        buckets.append(F.struct(
            F.lit(DURATION_BOUNDS[i - 1] if i else 0.0).alias("low"), F.lit(bound).alias("high"),
            (F.col(f"le{i - 1}") if i else F.lit(0).cast("long")).alias("before"), F.col(f"le{i}").alias("cumulative"),
        ))
    table = F.array(*buckets)

    def estimate(fraction: float) -> Column:
        rank = F.lit(float(fraction)) * F.col("total")
        hit = F.try_element_at(F.filter(table, lambda b: b["cumulative"] >= rank), F.lit(1))
        inside = hit["low"] + (hit["high"] - hit["low"]) * F.when(
            hit["cumulative"] > hit["before"], (rank - hit["before"]) / (hit["cumulative"] - hit["before"])
        ).otherwise(F.lit(0.0))
        value = F.when(hit.isNull(), F.lit(DURATION_BOUNDS[-1])).otherwise(inside)
        return F.when(F.col("total") > 0, value).alias(f"p{round(fraction * 100)}")

    return counted.select(*_starts(*by, F.col("total").alias("requests"), *map(estimate, fractions)))


def lifetime_totals(df: DataFrame, by: Sequence[str] = ("route", "method")) -> DataFrame:
    """Running totals; on a stream use complete or update mode."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"))


def in_progress_changes(df: DataFrame, by: Sequence[str] = ("method",), start: str = "ts", duration: str = "duration") -> DataFrame:
    """+1 when a request starts, -1 when it ends."""
    end = F.timestamp_micros((F.unix_micros(F.col(start).cast("timestamp")) + F.round(F.col(duration) * 1_000_000)).cast("long"))
    return df.select(*by, F.inline(F.array(
        F.struct(F.col(start).cast("timestamp").alias("at"), F.lit(1).cast("long").alias("change")),
        F.struct(end.alias("at"), F.lit(-1).cast("long").alias("change")),
    )))


def in_progress(df: DataFrame, by: Sequence[str] = ("method",), start: str = "ts", duration: str = "duration") -> DataFrame:
    """Requests in progress after each instant at which the number changed, per label."""
    changes = in_progress_changes(df, by, start, duration).groupBy(*by, "at").agg(F.sum("change").alias("change"))
    return running_sums(changes, ["at"], ["change"], by).select(*by, "at", F.col("cum_change").alias("in_progress"))


def in_progress_now(df: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Current gauge from a stream of started (+1) and finished (-1) changes."""
    return df.groupBy(*by).agg(F.sum("change").alias("in_progress"))


def latest_state(df: DataFrame, key: str, value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Last known value per key."""
    return df.groupBy(key).agg(
        F.max_by(value, F.struct(ts, tie)).alias(value), F.max(ts).alias("last_seen")
    )


def dedupe_stream(df: DataFrame, id_column: str, ts: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    """Each id once within the watermark.

    Copies inside one Arrow batch are dropped before the stateful shuffle, so an id repeated
    millions of times does not flood the task that holds its state.
    """
    def first_copies(batches):
        for batch in batches:
            ids = batch.column(id_column)
            numbered = pa.table({"id": ids, "row": pa.array(np.arange(batch.num_rows))})
            rows = numbered.group_by("id").aggregate([("row", "min")]).column("row_min")
            yield from pa.Table.from_batches([batch]).take(rows.combine_chunks().sort()).to_batches() if batch.num_rows else []

    typed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    thinned = typed.mapInArrow(first_copies, typed.schema)
    return thinned.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([id_column])
