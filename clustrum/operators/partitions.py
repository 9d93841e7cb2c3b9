"""Comparing partitions, checking a sweep for completeness and choosing a model from it."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrum.operators.ordering import global_index


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand_index(cells: DataFrame, groups: Sequence[str] = (), a: str = "a", b: str = "b", n: str = "n") -> DataFrame:
    """ARI per group from contingency cells; null under two rows, 1 when both sides are trivial alike."""
    groups = list(groups)
    count = F.col(n).cast("double")
    within = cells.groupBy(*groups).agg(F.sum(_pairs(count)).alias("_ab"), F.sum(count).alias("_n"))
    sides = within
    for side, name in ((a, "_a"), (b, "_b")):
        sizes = cells.groupBy(*groups, side).agg(F.sum(count).alias("_m"))
        total = sizes.groupBy(*groups).agg(F.sum(_pairs(F.col("_m"))).alias(name))
        sides = sides.join(total, groups) if groups else sides.join(F.broadcast(total))
    every = _pairs(F.col("_n"))
    expected = F.col("_a") * F.col("_b") / every
    top = (F.col("_a") + F.col("_b")) / 2
    same = (F.col("_ab") == F.col("_a")) & (F.col("_ab") == F.col("_b"))
    score = F.when(F.col("_n") < 2, None).when(same, 1.0).otherwise((F.col("_ab") - expected) / (top - expected))
    return sides.select(*groups, score.alias("ari"), F.col("_n").cast("long").alias("n"))


def compare_partitions(df: DataFrame, a: str, b: str, groups: Sequence[str] = ()) -> DataFrame:
    """ARI with noise (-1) as a cluster, ARI of rows assigned on both sides, and the two row counts."""
    keys = list(groups) or ["_all"]
    base = df if groups else df.withColumn("_all", F.lit(0))
    cells = base.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    kept = (F.col("a") >= 0) & (F.col("b") >= 0)
    # One stack of cells, scored twice: all of them, and those assigned on both sides.
    stacked = cells.withColumn("scope", F.explode(F.when(kept, F.array(F.lit("all"), F.lit("assigned"))).otherwise(F.array(F.lit("all")))))
    scores = adjusted_rand_index(stacked, [*keys, "scope"])
    pick = lambda scope, c: F.max(F.when(F.col("scope") == scope, F.col(c)))
    return scores.groupBy(*keys).agg(
        pick("all", "ari").alias("ari"),
        pick("assigned", "ari").alias("ari_assigned_only"),
        pick("all", "n").alias("n_common"),
        F.coalesce(pick("assigned", "n"), F.lit(0)).alias("n_common_assigned"),
    ).select(*groups, "ari", "ari_assigned_only", "n_common", "n_common_assigned")


def partition_overlap(left: DataFrame, right: DataFrame, id_column: str, label: str = "cluster_id") -> DataFrame:
    """Rows common to two subsets with both labels."""
    return left.select(id_column, F.col(label).alias("a")).join(right.select(id_column, F.col(label).alias("b")), id_column)


def pairwise_runs(runs: DataFrame, groups: Sequence[str], seed: str = "seed") -> DataFrame:
    """Every pair of runs of a group; a group is the handful of seeds of one configuration."""
    seeds = runs.groupBy(*groups).agg(F.array_sort(F.collect_set(seed)).alias("_s"))
    return seeds.select(
        *groups, F.posexplode("_s").alias("_i", "seed_a"), "_s"
    ).select(*groups, "seed_a", F.explode(F.expr("slice(_s, _i + 2, size(_s))")).alias("seed_b"))


def pairwise_ari(labels: DataFrame, groups: Sequence[str], id_column: str, seed: str = "seed", label: str = "label") -> DataFrame:
    """ARI of every two runs of a group, from one row per (run, observation).

    Observations meet once: each collects its few (seed, label) values and yields one row per pair
    of seeds, which is counted into contingency cells before the next shuffle.
    """
    groups = list(groups)
    per_id = labels.groupBy(*groups, id_column).agg(F.array_sort(F.collect_list(F.struct(seed, label))).alias("_r"))
    paired = per_id.select(*groups, F.posexplode("_r").alias("_i", "_x"), "_r").select(
        *groups, "_x", F.explode(F.expr("slice(_r, _i + 2, size(_r))")).alias("_y")
    )
    cells = paired.groupBy(
        *groups, F.col(f"_x.{seed}").alias("seed_a"), F.col(f"_y.{seed}").alias("seed_b"),
        F.col(f"_x.{label}").alias("a"), F.col(f"_y.{label}").alias("b"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return adjusted_rand_index(cells, [*groups, "seed_a", "seed_b"])


def sweep_grid(runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All combinations of the distinct values of the configuration columns."""
    values = runs.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))
    for c in columns:
        values = values.withColumn(c, F.explode(c))
    return values


def grid_of(spark, options: Mapping[str, Sequence]) -> DataFrame:
    """Declared grid, such as encoders x methods x seeds."""
    grid = spark.range(1).select(*(F.lit(list(v)).alias(k) for k, v in options.items()))
    for k in options:
        grid = grid.withColumn(k, F.explode(k))
    return grid


def missing_configurations(expected: DataFrame, found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Configurations that are `missing` from, or `unexpected` in, the finished runs."""
    columns = list(columns)
    a, b = expected.select(*columns).distinct(), found.select(*columns).distinct()
    return a.join(b, columns, "left_anti").withColumn("problem", F.lit("missing")).unionByName(
        b.join(a, columns, "left_anti").withColumn("problem", F.lit("unexpected"))
    )


def newest_run(runs: DataFrame, configuration: Sequence[str], started: str, run_id: str, finished: Column) -> DataFrame:
    """The newest finished run per configuration; ties go to the lower run id."""
    window = Window.partitionBy(*configuration).orderBy(F.col(started).desc(), F.col(run_id))
    return (
        runs.filter(finished).withColumn("_n", F.row_number().over(window)).filter(F.col("_n") == 1).drop("_n")
    )


def link_train_eval(
    evaluations: DataFrame, trainings: DataFrame, link: str, identity: Sequence[str]
) -> DataFrame:
    """Evaluation rows whose training run exists, is finished and has the same identity columns."""
    return evaluations.join(trainings.select(link, *identity), [link, *identity])


def sweep_aggregate(runs: DataFrame, pairs: DataFrame, groups: Sequence[str], score: str = "silhouette", n_seeds: int = 5) -> DataFrame:
    """Per configuration: seeds, valid scores, eligibility, mean and sample deviation of score and ARI."""
    groups = list(groups)
    valid = F.when(~F.isnan(score) & (F.abs(score) < F.lit(float("inf"))), F.col(score))
    scored = runs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.count(valid).alias("valid_silhouettes"),
        F.avg(valid).alias("_mean"),
        F.stddev_samp(valid).alias("_std"),
    )
    compared = pairs.groupBy(*groups).agg(
        F.avg("ari").alias("ari_mean"), F.stddev_samp("ari").alias("ari_std"), F.count("ari").alias("ari_pairs")
    )
    eligible = (F.col("valid_silhouettes") == n_seeds) & (F.col("n_seeds") == n_seeds)
    return scored.withColumn("eligible", eligible).join(compared, groups).select(
        *groups, "n_seeds", "valid_silhouettes", "eligible",
        F.when(F.col("eligible"), F.col("_mean")).alias("silhouette_mean"),
        F.when(F.col("eligible"), F.col("_std")).alias("silhouette_std"),
        "ari_mean", "ari_std", "ari_pairs",
    )


def check_same_sample(runs: DataFrame, columns: Sequence[str] = ("observation_ids", "sample_hash")) -> DataFrame:
    """Raises unless all runs used the same observations and the same score sample."""
    found = runs.agg(*(F.count_distinct(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns)).first()
    if any(found[c] > 1 for c in columns):
        raise ValueError(f"runs differ in {', '.join(c for c in columns if found[c] > 1)}")
    return runs


def peer_ari(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per run: mean and sample deviation of its ARI against the other seeds of its configuration."""
    both = pairs.withColumn("seed", F.explode(F.array("seed_a", "seed_b")))
    return both.groupBy(*groups, "seed").agg(
        F.avg("ari").alias("ari_mean"), F.stddev_samp("ari").alias("ari_std"), F.count("ari").alias("ari_pairs")
    )


def rank_models(metrics: DataFrame, metric: str = "silhouette_cosine", direction: str = "maximize", name: str = "method") -> DataFrame:
    """Finite scores ranked, ties by name; the others are kept with a null rank and `excluded`."""
    if direction not in ("maximize", "minimize"):
        raise ValueError("direction must be maximize or minimize")
    score = F.col(metric).cast("double")
    finite = F.coalesce(~F.isnan(score) & (F.abs(score) < F.lit(float("inf"))), F.lit(False))
    scored = metrics.select(name, F.when(finite, score).alias("score"), (~finite).alias("excluded"))
    falling = -F.col("score") if direction == "maximize" else F.col("score")
    ranked = global_index(scored.filter("NOT excluded").withColumn("_order", falling), ["_order", name], "rank")
    return ranked.select(name, "score", "excluded", (F.col("rank") + 1).cast("int").alias("rank")).unionByName(
        scored.filter("excluded").withColumn("rank", F.lit(None).cast("int")))


def select_winner(aggregated: DataFrame, runs: DataFrame, final_seed: int, encoder: str = "encoder", method: str = "method") -> DataFrame:
    """The run with the agreed seed of the best eligible configuration."""
    best = aggregated.filter("eligible").orderBy(
        F.col("silhouette_mean").desc(), F.col("ari_mean").desc(), encoder, method
    ).limit(1)
    return runs.filter(F.col("seed") == final_seed).join(
        F.broadcast(best.select(encoder, method, "silhouette_mean", "ari_mean")), [encoder, method]
    )


def compare_runs(
    previous: DataFrame, current: DataFrame, key: str, identity: Sequence[str], score: str = "silhouette_cosine"
) -> DataFrame:
    """Score difference of an earlier and a later run when all identity columns agree."""
    before = previous.select(key, *(F.col(c).alias(f"_old_{c}") for c in identity), F.col(score).alias("previous_score"), F.lit(True).alias("_found"))
    agree = F.lit(True)
    for c in identity:
        agree = agree & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    joined = current.withColumnRenamed(score, "final_score").join(before, key, "left")
    known = F.coalesce(F.col("_found"), F.lit(False))
    defined = F.col("previous_score").isNotNull() & F.col("final_score").isNotNull()
    status = (
        F.when(~known, "unavailable").when(~agree, "incompatible").when(defined, "available").otherwise("unavailable")
    )
    return joined.withColumn("status", status).select(
        key, "status",
        F.when(known & agree, F.col("previous_score")).alias("previous_score"),
        F.when(known & agree, F.col("final_score")).alias("final_score"),
        F.when(F.col("status") == "available", F.col("final_score") - F.col("previous_score")).alias("difference"),
    )
