"""Row numbers, running totals and exact quantiles over data of any size.

An un-partitioned window moves every row to one task, and a window per group moves a hot group to
one task. Here rows are range-partitioned on group and order together, so that a group holding a
third of all rows spreads over many tasks; each partition counts on its own and starts from the
total of the partitions before it. Only one summary row per partition reaches the driver.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clustrum.session import checked_broadcast, materialize


def global_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """0-based position of each row in `order`, which has to be unique to be repeatable."""
    order_columns = [F.col(c) for c in order]
    ordered = materialize(
        df.repartitionByRange(*order_columns)
        .sortWithinPartitions(*order_columns)
        .withColumn("_at", F.monotonically_increasing_id()),
        "row-index",
    )
    # monotonically_increasing_id holds the partition in the upper 31 bits, the row in the lower 33.
    indexed = ordered.withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted(tuple(r) for r in indexed.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return (
        indexed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .select(*df.columns, name)
    )


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str],
    group: Sequence[str] = (),
    previous: str | None = None,
) -> DataFrame:
    """Adds `cum_<c>` for each of `sums`: inclusive running totals in `order`, restarting per `group`.

    `previous` names a column whose value on the row before (in the same group) is added as
    `previous_<c>`; it is null on the first row of a group. `group` columns must not be null.
    """
    group, sums = list(group), list(sums)
    columns = df.columns
    keys = [F.col(c) for c in [*group, *order]]
    schema = T.StructType(
        df.schema.fields
        + [T.StructField(f"cum_{c}", df.schema[c].dataType) for c in sums]
        + ([T.StructField(f"previous_{previous}", df.schema[previous].dataType)] if previous else [])
        + [
            T.StructField("_part", T.IntegerType()),
            T.StructField("_row", T.LongType()),
            T.StructField("_head", T.BooleanType()),
        ]
    )
    ordered = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    )
    table = materialize(
        ordered.mapInArrow(_accumulator(columns, group, sums, previous), schema), "running-sums"
    )
    return _add_offsets(table, columns, group, sums, previous)


def _accumulator(columns, group, sums, previous):
    """Per-partition running totals over Arrow batches; what carries over is one row."""

    def accumulate(batches: Iterable[pa.RecordBatch]):
        carry = {c: 0 for c in sums}
        last_key = last_previous = None
        seen, head_open = 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in group]
            change = np.zeros(n, dtype=bool)
            for values in keys:
                change[1:] |= values[1:] != values[:-1]
            first_key = tuple(batch.column(c)[0].as_py() for c in group)
            change[0] = last_key is None or first_key != last_key
            starts = np.flatnonzero(change)
            segment = np.cumsum(change)
            out = [batch.column(c) for c in columns]
            for c in sums:
                values = batch.column(c).to_numpy(zero_copy_only=False)
                total = np.cumsum(values)
                bases = np.concatenate(([-carry[c]], total[starts] - values[starts]))
                running = total - bases[segment]
                carry[c] = running[-1].item()
                out.append(pa.array(running))
            if previous:
                column = batch.column(previous)
                shifted = pa.concat_arrays(
                    [pa.array([last_previous], type=column.type), column.slice(0, n - 1)]
                )
                mask = pa.array(~change)
                out.append(pa.compute.if_else(mask, shifted, pa.scalar(None, type=column.type)))
                last_previous = column[n - 1].as_py()
            # The head is the first group of the partition: it may have begun in an earlier one.
            breaks = starts if seen else starts[starts > 0]
            head = np.full(n, head_open)
            if head_open and len(breaks):
                head[breaks[0]:] = False
                head_open = False
            out.append(batch.column("_part"))
            out.append(pa.array(np.arange(seen, seen + n)))
            out.append(pa.array(head))
            seen += n
            last_key = tuple(batch.column(c)[n - 1].as_py() for c in group)
            names = [*columns, *(f"cum_{c}" for c in sums)]
            names += [f"previous_{previous}"] if previous else []
            yield pa.RecordBatch.from_arrays(out, names=[*names, "_part", "_row", "_head"])

    return accumulate


def _add_offsets(table, columns, group, sums, previous):
    summaries = (
        table.groupBy("_part")
        .agg(
            F.min_by(F.struct(F.lit(0), *group), "_row").alias("first_key"),
            F.max_by(F.struct(F.lit(0), *group), "_row").alias("last_key"),
            F.bool_and("_head").alias("single"),
            F.max_by(F.struct(*(f"cum_{c}" for c in sums)), "_row").alias("tail"),
            (F.max_by(previous, "_row") if previous else F.lit(None).cast("string")).alias("last_previous"),
        )
        .orderBy("_part")
        .collect()
    )
    offsets, carry, key, last = [], [0] * len(sums), None, None
    for s in summaries:
        first = tuple(s.first_key)
        start = carry if first == key else [0] * len(sums)
        offsets.append((s["_part"], *start, last if first == key else None))
        carry = [t + (o if s.single else 0) for t, o in zip(s.tail, start)]
        key, last = tuple(s.last_key), s.last_previous
    previous_type = table.schema[f"previous_{previous}"].dataType if previous else T.StringType()
    schema = T.StructType(
        [T.StructField("_part", T.IntegerType())]
        + [T.StructField(f"_from_{c}", table.schema[f"cum_{c}"].dataType) for c in sums]
        + [T.StructField("_before", previous_type)]
    )
    frame = table.sparkSession.createDataFrame(offsets, schema)
    joined = table.join(F.broadcast(frame), "_part", "left")
    result = [F.col(c) for c in columns]
    for c in sums:
        offset = F.when(F.col("_head"), F.coalesce(f"_from_{c}", F.lit(0))).otherwise(0)
        result.append((F.col(f"cum_{c}") + offset).alias(f"cum_{c}"))
    if previous:
        at_start = F.col("_head") & (F.col("_row") == 0)
        result.append(
            F.when(at_start, F.col("_before")).otherwise(F.col(f"previous_{previous}")).alias(f"previous_{previous}")
        )
    return joined.select(*result)


def histogram_of(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct non-null value (map-side combined, so a hot value costs nothing)."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantile_name(fraction: float) -> str:
    return {0: "min", 0.5: "median", 1: "max"}.get(fraction, f"p{round(fraction * 100):02d}")


def describe(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    fractions: Sequence[float] = (0, 0.25, 0.5, 0.75, 1),
    names: Sequence[str] | None = None,
    nearest_rank: bool = False,
) -> DataFrame:
    """Count, mean, population and sample standard deviation and exact quantiles per group.

    Quantiles interpolate linearly between order statistics, or take the nearest rank
    `sorted[ceil(f * n) - 1]`. All figures come from one histogram pass over the input.
    """
    return describe_counts(histogram_of(df, value, groups), groups, fractions, names, nearest_rank)


def describe_counts(
    counts: DataFrame,
    groups: Sequence[str] = (),
    fractions: Sequence[float] = (0, 0.25, 0.5, 0.75, 1),
    names: Sequence[str] | None = None,
    nearest_rank: bool = False,
) -> DataFrame:
    """`describe` of a table that already holds (groups, `value`, `n`); a null group is left out."""
    keyed = counts.dropna(subset=list(groups)) if groups else counts.withColumn("_all", F.lit(0))
    keys = list(groups) or ["_all"]
    counted = running_sums(keyed.withColumn("value", F.col("value").cast("double")), ["value"], ["n"], keys)
    return describe_running(counted, keys, fractions, names, nearest_rank).drop("_all")


def describe_running(
    counted: DataFrame,
    keys: Sequence[str],
    fractions: Sequence[float],
    names: Sequence[str] | None = None,
    nearest_rank: bool = False,
) -> DataFrame:
    """`describe` of a table that already holds (keys, `value`, `n`, `cum_n`)."""
    names = list(names or (quantile_name(f) for f in fractions))
    totals = counted.groupBy(*keys).agg(
        F.sum("n").alias("_count"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("_mean")
    )
    rows = counted.join(checked_broadcast(totals), keys)
    aggregates: list[Column] = [
        F.first("_count").alias("count"),
        F.first("_mean").alias("mean"),
        F.sum(F.col("n") * F.pow(F.col("value") - F.col("_mean"), 2)).alias("_ss"),
    ]
    final: list[Column] = []
    for name, fraction in zip(names, fractions):
        if nearest_rank:
            rank = F.greatest(F.ceil(F.lit(float(fraction)) * F.col("_count")) - 1, F.lit(0))
            aggregates.append(_value_at(rank).alias(name))
            final.append(F.col(name))
            continue
        position = (F.col("_count") - 1) * F.lit(float(fraction))
        low = F.floor(position)
        high = F.least(low + 1, F.col("_count") - 1)
        aggregates += [
            _value_at(low).alias(f"_low_{name}"),
            _value_at(high).alias(f"_high_{name}"),
            F.first(position - low).alias(f"_part_{name}"),
        ]
        final.append(
            (F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * F.col(f"_part_{name}")).alias(name)
        )
    return (
        rows.groupBy(*keys)
        .agg(*aggregates)
        .select(
            *keys, "count", "mean",
            F.sqrt(F.col("_ss") / F.col("count")).alias("std_population"),
            F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1))).alias("std_sample"),
            *final,
        )
    )


def quantile_grid(df: DataFrame, value: str, fractions: Sequence[float]) -> DataFrame:
    """(`fraction`, `observed`) for a long list of fractions: one row each instead of one column each."""
    counted = running_sums(
        histogram_of(df.withColumn("_all", F.lit(0)), value, ["_all"]), ["value"], ["n"], ["_all"]
    )
    total = counted.agg(F.sum("n").alias("_total"))
    grid = F.array(*(F.lit(float(f)) for f in fractions))
    low = lambda f: F.floor((F.col("_total") - 1) * f)
    high = lambda f: F.least(low(f) + 1, F.col("_total") - 1)
    inside = lambda rank: (F.col("cum_n") > rank) & (F.col("cum_n") - F.col("n") <= rank)
    hits = counted.join(F.broadcast(total)).select(
        F.col("value").cast("double").alias("value"), "n", "cum_n", "_total",
        F.explode(F.filter(grid, lambda f: inside(low(f)) | inside(high(f)))).alias("fraction"),
    )
    f = F.col("fraction")
    bounds = hits.groupBy("fraction").agg(
        F.max(F.when(inside(low(f)), F.col("value"))).alias("a"),
        F.max(F.when(inside(high(f)), F.col("value"))).alias("b"),
        F.first((F.col("_total") - 1) * f - low(f)).alias("part"),
    )
    return bounds.select("fraction", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("observed"))


def _value_at(rank: Column) -> Column:
    covered = (F.col("cum_n") > rank) & (F.col("cum_n") - F.col("n") <= rank)
    return F.max(F.when(covered, F.col("value")))


def rows_at_ranks(df: DataFrame, key: str, tie: str, ranks: Sequence[int]) -> list[tuple]:
    """(key, tie) of the rows at the given 0-based ranks in (key, tie) order, nulls last, without sorting all rows.

    Counts per key find the keys the ranks fall in; only the rows of those keys are ranked. Ranks beyond the table are left out.
    """
    known, unknown = df.filter(F.col(key).isNotNull()), df.filter(F.col(key).isNull())
    counts = known.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    filled = counts.agg(F.sum("n")).first()[0] or 0
    tail = [r for r in ranks if r >= filled]
    if tail:
        late = global_index(unknown.select(tie), [tie], "_rank").filter(F.col("_rank").isin(*(r - filled for r in tail)))
        at = {r["_rank"] + filled: (None, r[tie]) for r in late.collect()}
        return rows_at_ranks(known, key, tie, [r for r in ranks if r < filled]) + [at[r] for r in tail if r in at]
    counted = running_sums(counts, [key], ["n"])
    hits = counted.filter(reduce(
        lambda a, b: a | b,
        [(F.col("cum_n") > r) & (F.col("cum_n") - F.col("n") <= r) for r in ranks] or [F.lit(False)],
    ))
    spans = {r[key]: (r.cum_n - r.n, r.cum_n) for r in hits.collect()}
    if not spans:
        return []
    inside = global_index(
        df.filter(F.col(key).isin(*spans)).select(key, tie), [key, tie], "_rank"
    )
    # Positions inside the filtered rows: the spans laid end to end in key order.
    wanted, start = {}, 0
    for value in sorted(spans):
        low, high = spans[value]
        for r in ranks:
            if low <= r < high:
                wanted[r] = start + r - low
        start += high - low
    found = {r["_rank"]: (r[key], r[tie]) for r in inside.filter(F.col("_rank").isin(*wanted.values())).collect()}
    return [found[wanted[r]] for r in ranks if r in wanted]
