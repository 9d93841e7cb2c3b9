"""Exploration: null, value and length profiles, correlations and normality."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrum.functions.special import normal_p_value, normal_quantile, t_p_value
from clustrum.operators.ordering import describe, histogram_of, quantile_grid, running_sums
from clustrum.session import checked_broadcast, materialize


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and percentage per column, in one pass; the percentage of no rows is null."""
    counted = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in columns))
    return counted.select("n", F.inline(pairs)).select(
        "column_name", "null_count", F.try_divide(F.col("null_count") * 100.0, F.col("n")).alias("null_percent")
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))
    return counted.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_total")).alias("share"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per column; without values the count is 0 and the rest null."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns))
    melted = df.select(F.inline(pairs))
    found = describe(melted, "v", ["column_name"], (0, 0.25, 0.5, 0.75, 1))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return every.join(F.broadcast(found), "column_name", "left").select(
        "column_name", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "mean", F.col("std_sample").alias("std"),
        "min", "p25", "median", "p75", "max",
    )


def histogram(df: DataFrame, value: str, low: float | None = None, high: float | None = None, bins: int = 40) -> DataFrame:
    """Counts per equal-width bin between the given edges, or without them over the range of the values.

    The last bin is closed on the right; values outside given edges are left out. Without values and edges there are no
    bins; a single value lies in bins of width zero, all in the last one.
    """
    v = F.col(value).cast("double")
    if low is None or high is None:
        least, most = df.agg(F.min(v), F.max(v)).first()
        low, high = least if low is None else low, most if high is None else high
    if low is None or high is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    low, high = float(low), float(high)
    width = (high - low) / bins
    number = F.when(v == high, F.lit(bins - 1)).otherwise(F.floor(F.try_divide(v - low, F.lit(width))))
    counted = (
        df.filter((v >= low) & (v <= high))
        .groupBy(F.least(number, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def median_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    return describe(df, value, [group], (0.5,)).select(group, "median")


def _correlation(x: str, y: str) -> Column:
    """Pearson's r over rows with both values; null where a column does not vary."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)).cast("double"), F.when(F.col(x).isNotNull(), F.col(y)).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, r, t statistic and two-sided p-value over rows with both values.

    A constant column has no r. At r = 1 and -1 the statistic is without bound: null, with p = 0.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fitted = both.agg(F.count(F.lit(1)).alias("n"), _correlation(x, y).alias("r"))
    degrees = F.col("n") - 2
    perfect = F.abs("r") >= 1 - 1e-12
    t = F.when(~perfect & (degrees > 0), F.col("r") * F.sqrt(F.try_divide(degrees.cast("double"), 1 - F.col("r") * F.col("r"))))
    tested = fitted.withColumn("t_statistic", t)
    return tested.withColumn(
        "p_value", F.when(perfect & (degrees > 0), 0.0).otherwise(t_p_value(F.col("t_statistic"), degrees.cast("double")))
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for a in columns for b in columns]
    corr = df.agg(*(_correlation(a, b).alias(f"{a}|{b}") for a, b in pairs))
    cells = F.array(*(
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs
    ))
    return corr.select(F.inline(cells))


def kendall_correlation(df: DataFrame, x: str, y: str, digits: int = 16) -> DataFrame:
    """Kendall tau-b, its tie counts and the asymptotic two-sided p-value, without forming pairs.

    Rows shrink to the contingency table. The rank of `y` is read digit by digit: two cells whose
    ranks first differ at a digit are compared at that level only, by running totals per digit in
    `x` order. A rating needs one level; m distinct values need log(m) levels.
    """
    cells = materialize(
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")),
        "kendall-cells",
    )
    ranked_y = running_sums(
        cells.groupBy("y").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1).cast("long")), ["y"], ["one"]
    ).select("y", "n", (F.col("cum_one") - 1).alias("rank_y"))
    size = ranked_y.agg(F.max("rank_y").alias("top"), F.sum("n").alias("n")).first()
    spark = df.sparkSession
    if not size.n:
        return spark.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in _KENDALL))
    ranked = materialize(cells.join(checked_broadcast(ranked_y.select("y", "rank_y")), "y"), "kendall-ranks")
    digits = min(digits, max(2, size.top + 1))
    levels, span = [], 1
    while not levels or span <= size.top:
        levels.append(_digit_level(ranked, span, digits))
        span *= digits
    counted = levels[0]
    for level in levels[1:]:
        counted = counted.unionAll(level)
    order = counted.agg(F.sum("concordant").alias("concordant"), F.sum("discordant").alias("discordant"))
    ties = _tie_sums(cells, "x").join(F.broadcast(_tie_sums(cells, "y")))
    n = F.lit(size.n).cast("double")
    pairs = n * (n - 1) / 2
    s = F.col("concordant") - F.col("discordant")
    tied_x, tied_y = F.col("pairs_x"), F.col("pairs_y")
    m = n * (n - 1)
    variance = (
        (m * (2 * n + 5) - F.col("cubic_x") - F.col("cubic_y")) / 18
        + F.coalesce(F.try_divide(2 * tied_x * tied_y, m), F.lit(0.0))
        + F.coalesce(F.try_divide(F.col("triple_x") * F.col("triple_y"), 9 * m * (n - 2)), F.lit(0.0))
    )
    return order.join(F.broadcast(ties)).select(
        F.lit(size.n).cast("long").alias("n"),
        F.col("concordant").cast("long").alias("concordant"),
        F.col("discordant").cast("long").alias("discordant"),
        F.try_divide(F.try_divide(s, F.sqrt(pairs - tied_x)), F.sqrt(pairs - tied_y)).alias("tau_b"),
        normal_p_value(F.try_divide(s, F.sqrt(variance))).alias("p_value"),
    )


_KENDALL = [("n", "long"), ("concordant", "long"), ("discordant", "long"), ("tau_b", "double"), ("p_value", "double")]


def _digit_level(ranked: DataFrame, span: int, digits: int) -> DataFrame:
    digit = F.floor(F.col("rank_y") / span) % digits
    names = [f"d{i}" for i in range(digits)]
    rows = ranked.groupBy(F.floor(F.col("rank_y") / (span * digits)).alias("prefix"), "x").agg(
        *(F.coalesce(F.sum(F.when(digit == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(names))
    )
    summed = running_sums(rows, ["x"], names, ["prefix"])
    before = [(F.col(f"cum_{c}") - F.col(c)).cast("double") for c in names]
    lower, higher, running = [], [], F.lit(0).cast("double")
    for i in range(digits):
        lower.append(running)
        running = running + before[i]
    running = F.lit(0).cast("double")
    for i in reversed(range(digits)):
        higher.append(running)
        running = running + before[i]
    higher.reverse()
    concordant = sum((F.col(c) * lower[i] for i, c in enumerate(names)), F.lit(0.0))
    discordant = sum((F.col(c) * higher[i] for i, c in enumerate(names)), F.lit(0.0))
    return summed.agg(F.sum(concordant).alias("concordant"), F.sum(discordant).alias("discordant"))


def _tie_sums(cells: DataFrame, key: str) -> DataFrame:
    t = F.col("t").cast("double")
    return cells.groupBy(key).agg(F.sum("n").alias("t")).agg(
        F.sum(t * (t - 1) / 2).alias(f"pairs_{key}"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"cubic_{key}"),
        F.sum(t * (t - 1) * (t - 2)).alias(f"triple_{key}"),
    )


def normality_summary(df: DataFrame, value: str) -> DataFrame:
    """Skewness, excess kurtosis and Jarque-Bera statistic of all rows (p from chi-square, 2 degrees)."""
    v = F.col(value).cast("double")
    fitted = df.agg(F.count(value).alias("n"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    statistic = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    return fitted.withColumn("jarque_bera", statistic).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))


def qq_points(df: DataFrame, value: str, points: int = 99) -> DataFrame:
    """Exact quantiles on an even grid against normal quantiles, with the fitted normal value."""
    fractions = [i / (points + 1) for i in range(1, points + 1)]
    fitted = df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    return quantile_grid(df, value, fractions).join(F.broadcast(fitted)).select(
        "fraction", normal_quantile("fraction").alias("normal_quantile"), "observed",
        (F.col("_mean") + F.col("_std") * normal_quantile("fraction")).alias("fitted"),
    )


def ecdf(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Right-continuous cumulative share per distinct value; a null group is a group of its own."""
    groups = list(groups)
    # One key per group that is never null.
    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")
    counted = running_sums(histogram_of(df.withColumn("_key", key), value, ["_key", *groups]), ["value"], ["n"], ["_key"])
    totals = counted.groupBy("_key").agg(F.sum("n").alias("_total"))
    return counted.join(checked_broadcast(totals), "_key").select(
        *groups, "value", "n", "cum_n", (F.col("cum_n") / F.col("_total")).alias("cumulative_share")
    )


def top_shares(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values (a report: ties go to the lower value)."""
    order = [F.col("n").desc(), F.col("value")]
    # The limit keeps n rows per task before they meet; only n rows are numbered.
    top = value_distribution(df, column).orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
