"""Drift between two cohorts: distances, permutation tests and multiple-testing adjustment.

The rows are read once and reduced to a pooled histogram (feature, value, count a, count b). All
statistics, descriptions and resamples start from that written table.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustrum.operators.cleaning import text_features
from clustrum.operators.cohorts import shared_ids
from clustrum.operators.geometry import cluster_counts
from clustrum.operators.ordering import describe, describe_running, running_sums
from clustrum.session import materialize

# Fixed values of the drift protocol.
FEATURES = ("character_length", "word_count")
DRIFT_FRACTIONS = (0, 0.25, 0.5, 0.75, 0.95, 1)
RESAMPLES, SEED, ALPHA, PRACTICAL_THRESHOLD = 1999, 42, 0.05, 0.1
REPORT_THRESHOLD = 0.1
# Histogram cells one resampling task may hold; more cells are cut into value ranges of this size.
CELLS_PER_BLOCK = 50_000


def stack_features(df: DataFrame, features: Sequence[str] = FEATURES, cohort: str = "cohort") -> DataFrame:
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    return df.select(cohort, F.inline(cells))


def pooled_histogram(stacked: DataFrame, reference: str, production: str, cohort: str = "cohort") -> DataFrame:
    """`feature`, `value`, `a` (reference rows), `b` (production rows)."""
    return (
        stacked.filter(F.col(cohort).isin(reference, production) & F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count_if(F.col(cohort) == reference).alias("a"), F.count_if(F.col(cohort) == production).alias("b"))
    )


def with_running_counts(histogram: DataFrame) -> DataFrame:
    """Adds running totals of both cohorts, of the pooled rows and of the cells, and the value before."""
    cells = histogram.withColumn("pooled", F.col("a") + F.col("b")).withColumn("cell", F.lit(1).cast("long"))
    return running_sums(cells, ["value"], ["a", "b", "pooled", "cell"], ["feature"], previous="value")


def distribution_distances(counted: DataFrame) -> DataFrame:
    """KS statistic and raw-unit Wasserstein distance per feature, from running counts; null if a cohort is empty."""
    totals = counted.groupBy("feature").agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    rows = counted.join(F.broadcast(totals), "feature")
    gap = F.abs(F.try_divide("cum_a", "_na") - F.try_divide("cum_b", "_nb"))
    before = F.abs(F.try_divide(F.col("cum_a") - F.col("a"), "_na") - F.try_divide(F.col("cum_b") - F.col("b"), "_nb"))
    return rows.groupBy("feature").agg(
        F.first("_na").alias("reference_rows"),
        F.first("_nb").alias("production_rows"),
        F.max(gap).alias("ks_statistic"),
        F.when((F.first("_na") > 0) & (F.first("_nb") > 0),
               F.coalesce(F.sum(before * (F.col("value") - F.col("previous_value"))), F.lit(0.0))).alias("wasserstein"),
    )


def ks_statistic(df: DataFrame, value: str, reference: str, production: str, cohort: str = "cohort") -> DataFrame:
    return distribution_distances(
        with_running_counts(pooled_histogram(stack_features(df, [value], cohort), reference, production, cohort))
    )


def describe_drift(stacked: DataFrame, cohort: str = "cohort") -> DataFrame:
    """Count, mean, population deviation, min, quartiles, p95 and max per feature and cohort."""
    return describe(stacked, "value", ["feature", cohort], DRIFT_FRACTIONS).drop("std_sample")


@dataclass(frozen=True)
class CellStatistic:
    """A two-sample statistic that is built up over histogram cells.

    `term(drawn, pooled, cum_drawn, cum_pooled, n_a, n_b)` gives the contributions of an array of cells
    (last axis); contributions are combined by `max` or `sum`.
    """

    term: Callable
    combine: str

    def over_cells(self, drawn, pooled, cum_drawn, cum_pooled, n_a: int, n_b: int) -> np.ndarray:
        terms = self.term(drawn, pooled, cum_drawn, cum_pooled, n_a, n_b)
        return terms.max(axis=-1) if self.combine == "max" else terms.sum(axis=-1)


def _ks_term(drawn, pooled, cum_drawn, cum_pooled, n_a, n_b):
    return np.abs(cum_drawn / n_a - (cum_pooled - cum_drawn) / n_b)


def _pearson_term(drawn, pooled, cum_drawn, cum_pooled, n_a, n_b):
    share = np.maximum(pooled, 1) / (n_a + n_b)
    terms = (drawn - n_a * share) ** 2 / (n_a * share) + (pooled - drawn - n_b * share) ** 2 / (n_b * share)
    return np.where(pooled > 0, terms, 0.0)


KOLMOGOROV_SMIRNOV = CellStatistic(_ks_term, "max")
PEARSON = CellStatistic(_pearson_term, "sum")


def draw_subsets(rng: np.random.Generator, cells: np.ndarray, takes: np.ndarray) -> np.ndarray:
    """Rows that fall in each cell when `takes[i]` of the rows of `cells[i]` are drawn without replacement.

    Exact for populations of any size. Taking every row with the same probability gives a binomial number per cell and, whatever its
    size, a uniformly random subset. What it lacks is thinned out of the rest in the same way, what it has too much is
    thinned out of it; each round leaves about the square root of the difference, and a short rest is drawn row by row.
    """
    cells = np.array(cells, np.int64)
    drawn, need = np.zeros_like(cells), np.array(takes, np.int64)
    few = max(64, cells.shape[1])
    while True:
        far = np.abs(need) > few
        if not far.any():
            break
        # From the rest into the subset, or back.
        source = np.where((need > 0)[:, None], cells - drawn, drawn)[far]
        chance = np.abs(need[far]) / source.sum(axis=1)
        moved = rng.binomial(source, np.minimum(chance, 1.0)[:, None]) * np.sign(need[far])[:, None]
        drawn[far] += moved
        need[far] -= moved.sum(axis=1)
    for row in np.flatnonzero(need):
        source = cells[row] - drawn[row] if need[row] > 0 else drawn[row]
        edges = np.cumsum(source)
        places = np.empty(0, np.int64)
        while len(places) < abs(need[row]):
            # Distinct rows in order of drawing.
            more = np.concatenate([places, rng.integers(0, edges[-1], 2 * abs(need[row]) + 8)])
            places = more[np.sort(np.unique(more, return_index=True)[1])][:abs(need[row])]
        hits = np.bincount(np.searchsorted(edges, places, side="right"), minlength=len(source))
        drawn[row] += hits * np.sign(need[row])
    return drawn


def draw_cells(rng: np.random.Generator, pooled: np.ndarray, takes: np.ndarray):
    """For each resample, how many of its rows fall in each cell; yields blocks of resamples of bounded size."""
    step = max(1, 5_000_000 // max(1, len(pooled)))
    for start in range(0, len(takes), step):
        part = takes[start:start + step]
        yield draw_subsets(rng, np.broadcast_to(pooled, (len(part), len(pooled))), part)


def permutation_test(
    counted: DataFrame,
    statistic: CellStatistic,
    resamples: int = RESAMPLES,
    seed: int = SEED,
    cells_per_block: int = CELLS_PER_BLOCK,
) -> DataFrame:
    """One-sided permutation p-value per feature: `feature`, `statistic`, `p_value`.

    `counted` is a pooled histogram `with_running_counts`.

    Shuffling rows between the cohorts only changes how many rows of each value fall in the first
    one, so the resamples are drawn on the histogram: per resample the rows are dealt to value
    ranges first and inside each range then, both without replacement. Work is spread over
    (feature, range, chunk of resamples); a task holds one range of bounded size. When there are no
    more distinct splits than resamples, all of them are enumerated instead.
    """
    cells = counted.select("feature", "value", "a", "b", "pooled", "cum_pooled", "cum_a", F.col("cum_cell").alias("cell"))
    sizes = cells.groupBy("feature").agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.count(F.lit(1)).alias("cells")
    ).collect()  # one row per feature
    plans = {s.feature: (int(s.n_a), int(s.n_b)) for s in sizes}
    blocked = cells.withColumn("block", F.floor((F.col("cell") - 1) / cells_per_block))
    block_rows = blocked.groupBy("feature", "block").agg(F.sum("pooled").alias("n")).collect()
    blocks: dict[str, list[int]] = {}
    for r in sorted(block_rows, key=lambda r: (r.feature, r.block)):
        blocks.setdefault(r.feature, []).append(int(r.n))
    chunks = max(1, min(64, resamples // 125))
    work = blocked.withColumn("chunk", F.explode(F.sequence(F.lit(-1), F.lit(chunks - 1))))

    def resample(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        feature, block, chunk = key
        n_a, n_b = plans[feature]
        pdf = pdf.sort_values("cell")
        pooled, totals = pdf.pooled.to_numpy(), pdf.cum_pooled.to_numpy()
        if chunk < 0:  # the observed split, through the same arithmetic
            numbers = np.array([-1])
            values = [statistic.over_cells(pdf.a.to_numpy(), pooled, pdf.cum_a.to_numpy(), totals, n_a, n_b)]
        else:
            numbers = np.arange(chunk, resamples, chunks)
            takes, start = _deal(blocks[feature], int(block), n_a, seed, numbers)
            rng = np.random.default_rng([seed, int(chunk), int(block), 1])
            values, done = [], 0
            for drawn in draw_cells(rng, pooled, takes):
                cum = drawn.cumsum(axis=1) + start[done:done + len(drawn), None]
                values.extend(statistic.over_cells(drawn, pooled, cum, totals, n_a, n_b))
                done += len(drawn)
        return pd.DataFrame({"feature": feature, "resample": numbers, "value": values})

    # A fixed number of partitions: the rows are few but each costs many draws, so they must not be
    # coalesced by size.
    units = len(block_rows) * (chunks + 1)
    context = counted.sparkSession.sparkContext
    spread_work = work.repartition(max(1, min(units, 8 * context.defaultParallelism)), "feature", "block", "chunk")
    parts = spread_work.groupBy("feature", "block", "chunk").applyInPandas(
        resample, "feature string, resample long, value double"
    )
    combined = parts.groupBy("feature", "resample").agg(
        (F.max if statistic.combine == "max" else F.sum)("value").alias("value")
    )
    observed = F.max(F.when(F.col("resample") < 0, F.col("value"))).over(Window.partitionBy("feature"))
    # A feature has resamples + 1 rows here.
    compared = combined.withColumn("_observed", observed).filter("resample >= 0")
    # Equal up to rounding counts as at least as large.
    tolerance = F.abs("_observed") * (100 * float(np.finfo(float).eps))
    counted = compared.groupBy("feature").agg(
        F.first("_observed").alias("statistic"),
        ((F.count_if(F.col("value") >= F.col("_observed") - tolerance) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )
    exact = [f for f, (n_a, n_b) in plans.items() if _splits(n_a, n_b, resamples) <= resamples]
    if not exact:
        return counted
    few = cells.filter(F.col("feature").isin(exact)).groupBy("feature").applyInPandas(
        _enumerate(statistic), "feature string, statistic double, p_value double"
    )
    return counted.filter(~F.col("feature").isin(exact)).unionByName(few)


def _deal(sizes: list[int], block: int, n_a: int, seed: int, numbers: np.ndarray):
    """Rows each resample draws from `block`, and from the blocks before it.

    Blocks are halved until one is left. The dealing at a halving is a function of the seed, the resample numbers and the halves
    alone, so that every block's task finds the same one after log(blocks) draws.
    """
    low, high = 0, len(sizes)
    take, start = np.full(len(numbers), n_a, dtype=np.int64), np.zeros(len(numbers), dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, int(numbers[0]), low, high])
        halves = np.array([sum(sizes[low:middle]), sum(sizes[middle:high])])
        left = draw_subsets(rng, np.broadcast_to(halves, (len(take), 2)), take)[:, 0]
        if block < middle:
            high, take = middle, left
        else:
            low, take, start = middle, take - left, start + left
    return take, start


def _splits(n_a: int, n_b: int, limit: int) -> float:
    """Number of ways to deal the rows, or more than `limit`."""
    if min(n_a, n_b) > 64 or n_a + n_b > limit:
        return math.inf
    return math.comb(n_a + n_b, n_a)


def _enumerate(statistic: CellStatistic):
    def every(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        pooled = pdf.pooled.to_numpy()
        n_a, n_b = int(pdf.a.sum()), int(pdf.b.sum())
        cell = np.repeat(np.arange(len(pooled)), pooled)
        chosen = [np.bincount(cell[list(c)], minlength=len(pooled)) for c in combinations(range(len(cell)), n_a)]
        drawn = np.array([pdf.a.to_numpy(), *chosen])
        values = statistic.over_cells(drawn, pooled, drawn.cumsum(axis=1), pooled.cumsum(), n_a, n_b)
        at_least = values[1:] >= values[0] - abs(values[0]) * 100 * np.finfo(float).eps
        return pd.DataFrame({"feature": [pdf.feature.iloc[0]], "statistic": [values[0]], "p_value": [at_least.mean()]})

    return every


def permutation_ks(histogram: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    return permutation_test(with_running_counts(histogram), KOLMOGOROV_SMIRNOV, resamples, seed)


def label_histogram(df: DataFrame, reference: str, production: str, label: str = "cluster_id", cohort: str = "cohort") -> DataFrame:
    stacked = df.select(cohort, F.lit("cluster_id").alias("feature"), F.col(label).cast("double").alias("value"))
    return pooled_histogram(stacked, reference, production, cohort)


def pearson_homogeneity(histogram: DataFrame) -> DataFrame:
    """2 x k chi-square statistic per feature; cells empty in both cohorts do not count."""
    totals = histogram.groupBy("feature").agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    pooled = F.col("a") + F.col("b")
    share = pooled / (F.col("_na") + F.col("_nb"))
    part = lambda seen, n: F.try_divide(F.pow(F.col(seen) - share * F.col(n), F.lit(2)), share * F.col(n))
    return (
        histogram.filter(pooled > 0).join(F.broadcast(totals), "feature")
        .groupBy("feature").agg(F.sum(part("a", "_na") + part("b", "_nb")).alias("pearson_statistic"))
    )


def permutation_homogeneity(histogram: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    return permutation_test(with_running_counts(histogram), PEARSON, resamples, seed)


def total_variation(histogram: DataFrame) -> DataFrame:
    """Half the summed absolute share differences, per feature; null if a cohort is empty."""
    totals = histogram.groupBy("feature").agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    return histogram.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        (F.sum(F.abs(F.try_divide("a", "_na") - F.try_divide("b", "_nb"))) / 2).alias("total_variation")
    )


def jensen_shannon(histogram: DataFrame) -> DataFrame:
    """Jensen-Shannon distance (square root of the divergence, base 2) of the cell shares."""
    totals = histogram.groupBy("feature").agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    p, q = F.try_divide("a", "_na"), F.try_divide("b", "_nb")
    middle = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)
    return histogram.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.when((F.first("_na") > 0) & (F.first("_nb") > 0), F.sqrt(F.greatest(F.sum(part(p) + part(q)) / 2, F.lit(0.0)))).alias("jensen_shannon")
    )


def holm_adjust(tests: DataFrame, alpha: float = ALPHA, name: str = "feature") -> DataFrame:
    """Step-down adjusted p-values with the two flags. One row per test goes in: a report-sized table."""
    order = Window.orderBy("p_value", name)
    steps = F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(order) + 1
    raised = tests.withColumn("_step", steps * F.col("p_value"))
    adjusted = F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return raised.withColumn("adjusted_p_value", adjusted).drop("_step").withColumns({
        "statistically_significant": F.col("adjusted_p_value") < alpha,
        "practically_important": F.col("effect_size") >= F.col("practical_threshold"),
    })


def report_distances(df: DataFrame, reference: str, production: str, features: Sequence[str] = FEATURES, label: str | None = None, cohort: str = "cohort") -> DataFrame:
    """Distances shown next to the tests: Wasserstein over the reference deviation for numeric
    features, Jensen-Shannon for the label; `drifted` at the report threshold."""
    stacked = stack_features(df, features, cohort)
    distances = distribution_distances(with_running_counts(pooled_histogram(stacked, reference, production, cohort)))
    spread = stacked.filter(F.col(cohort) == reference).groupBy("feature").agg(F.stddev_pop("value").alias("_std"))
    numeric = distances.join(F.broadcast(spread), "feature").select(
        "feature", F.lit("wasserstein").alias("method"),
        (F.col("wasserstein") / F.greatest("_std", F.lit(0.001))).alias("distance"),
    )
    if label:
        categorical = jensen_shannon(label_histogram(df, reference, production, label, cohort)).select(
            "feature", F.lit("jensenshannon").alias("method"), F.col("jensen_shannon").alias("distance")
        )
        numeric = numeric.unionByName(categorical)
    return numeric.withColumn("drifted", F.col("distance") >= REPORT_THRESHOLD)


def drift_report(
    df: DataFrame,
    reference: str,
    production: str,
    id_column: str,
    text: str = "text",
    label: str | None = None,
    n_clusters: int | None = None,
    cohort: str = "cohort",
    resamples: int = RESAMPLES,
    seed: int = SEED,
    alpha: float = ALPHA,
    threshold: float = PRACTICAL_THRESHOLD,
) -> DataFrame:
    """One row per feature: test, statistic, p and adjusted p, effect, flags and both descriptions."""
    if not 0 < alpha < 1 or not 0 < threshold <= 1 or resamples < 99:
        raise ValueError(f"configuration: alpha {alpha} and threshold {threshold} have to be shares, with 99 resamples or more, not {resamples}")
    both = df.filter(F.col(cohort).isin(reference, production))
    if shared_ids(both.filter(F.col(cohort) == reference), both.filter(F.col(cohort) == production), id_column).limit(1).count():
        raise ValueError(f"ids overlap: some {id_column} is in both {reference} and {production}")
    # One scan of the texts; everything below starts from the written running counts.
    counted = with_running_counts(
        pooled_histogram(stack_features(text_features(both, text), FEATURES, cohort), reference, production, cohort)
    )
    distances = distribution_distances(counted)
    tests = permutation_test(counted, KOLMOGOROV_SMIRNOV, resamples, seed)
    described = describe_sides(counted)
    rows = distances.join(tests, "feature").select(
        "feature", F.lit("permutation_two_sample_KS").alias("test"), "statistic", "p_value",
        F.lit("KS_D").alias("effect_name"), F.col("ks_statistic").alias("effect_size"),
        F.col("wasserstein").alias("wasserstein_raw_units"), "reference_rows", "production_rows",
    ).join(F.broadcast(described), "feature", "left")
    if label:
        labels = materialize(label_histogram(both, reference, production, label, cohort), "drift-labels")
        cluster = (
            total_variation(labels).join(permutation_homogeneity(labels, resamples, seed), "feature")
            .join(labels.groupBy("feature").agg(F.sum("a").alias("reference_rows"), F.sum("b").alias("production_rows")), "feature")
            .select("feature", F.lit("permutation_Pearson_homogeneity").alias("test"), "statistic", "p_value",
                    F.lit("total_variation").alias("effect_name"), F.col("total_variation").alias("effect_size"),
                    "reference_rows", "production_rows")
        )
        rows = rows.unionByName(cluster, allowMissingColumns=True)
    return holm_adjust(rows.withColumn("practical_threshold", F.lit(threshold)), alpha)


def describe_sides(counted: DataFrame) -> DataFrame:
    """`reference` and `production` structs of describe figures per feature, from the running counts."""
    sides = F.array(
        F.struct(F.lit("reference").alias("side"), F.col("a").alias("n"), F.col("cum_a").alias("cum_n")),
        F.struct(F.lit("production").alias("side"), F.col("b").alias("n"), F.col("cum_b").alias("cum_n")),
    )
    long = counted.select("feature", "value", F.inline(sides)).filter("n > 0")
    figures = describe_running(long, ["feature", "side"], DRIFT_FRACTIONS).drop("std_sample")
    packed = F.struct(*(c for c in figures.columns if c not in ("feature", "side")))
    return figures.groupBy("feature").agg(
        F.max(F.when(F.col("side") == "reference", packed)).alias("reference"),
        F.max(F.when(F.col("side") == "production", packed)).alias("production"),
    )


def cluster_drift(df: DataFrame, reference: str, production: str, n_clusters: int, label: str = "cluster_id", cohort: str = "cohort") -> DataFrame:
    """Zero-filled per-cluster counts, proportions and deltas of the two cohorts."""
    return cluster_counts(df, n_clusters, (reference, production), label, cohort)
