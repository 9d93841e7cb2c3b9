"""Seeded, repeatable samples. Order comes from a hash of seed and id, so it does not depend on
partitioning, and a rerun after a lost executor picks the same rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrum.functions.text import clean_text, text_digest
from clustrum.operators.ordering import describe, global_index, running_sums
from clustrum.session import materialize

# Quotas per cluster, in the order they are filled, and the columns people fill in.
QUOTAS = (("high_similarity", 4), ("intermediate_similarity", 3), ("low_margin", 3))
ANNOTATIONS = ("proposed_theme", "thematic_consistency", "ambiguity", "comments")


def seeded_order(seed: int | str, id_column: str | Column) -> Column:
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), column.cast("string")), 256)


def seeded_shuffle_limit(df: DataFrame, id_column: str, seed: int, limit: int) -> DataFrame:
    """First `limit` rows of a seeded shuffle, with `position` from 0: cut at the hash value of the last row and
    numbered over range partitions, whatever the size."""
    kept = _below_cut(df, id_column, seed, limit)
    numbered = global_index(kept, ["_order", id_column], "position")
    return numbered.filter(F.col("position") < limit).drop("_order")


def _below_cut(df: DataFrame, id_column: str, seed: int, size: int) -> DataFrame:
    ordered = df.withColumn("_order", seeded_order(seed, id_column))
    cut = hash_at_rank(ordered, "_order", size)
    return ordered if cut is None else ordered.filter(F.col("_order") <= cut)


def fixed_sample(df: DataFrame, id_column: str, seed: int, size: int) -> DataFrame:
    """The same rows for every configuration; all rows when `size` is 0 or too large. Ids have to be unique: the cut is the hash
    of the last id, and no row is moved."""
    return _below_cut(df, id_column, seed, size).drop("_order") if size else df


#: Rows under one node of a digest tree.
DIGEST_FAN = 1024


def ordered_digest(df: DataFrame, id_column: str, fan: int = DIGEST_FAN) -> DataFrame:
    """(n, ids_sha256): row count and digest of the sorted ids, for any number of rows and whatever their partitions.

    A leaf is the SHA-256 of the ids of `fan` consecutive rows, joined by commas; a node that of `fan` digests below it, up
    to one root. Up to `fan` ids that is the plain digest of the list; of no rows it is that of the empty text. Null ids
    come first and are left out of the text.
    """
    level = global_index(df.select(F.col(id_column).alias("id")), ["id"], "at").select("at", F.col("id").cast("string").alias("entry"))
    rows = level.count()
    size = rows
    while True:
        below = F.array_sort(F.collect_list(F.struct("at", "entry")))
        level = level.groupBy(F.floor(F.col("at") / fan).alias("at")).agg(
            F.sha2(F.array_join(F.transform(below, lambda e: e["entry"]), ","), 256).alias("entry"))
        size = -(-size // fan)
        if size <= 1:
            break
        level = materialize(level, "digests")
    digest = F.coalesce(F.max("entry"), F.sha2(F.lit(""), 256))
    return level.agg(F.lit(rows).cast("long").alias("n"), digest.alias("ids_sha256"))


def sample_digest(sample: DataFrame, id_column: str) -> DataFrame:
    """Row count and digest of the sorted ids."""
    return ordered_digest(sample, id_column)


def fraction_subset(df: DataFrame, id_column: str, fraction: float, seed: int, repeat: int, side: str) -> DataFrame:
    """Exactly floor(n * fraction) rows without replacement, independent per repeat and side.

    The cut is the hash value at that rank: two narrow scans, no sort of the table.
    """
    if not 0 < fraction <= 1:
        raise ValueError("0 < fraction <= 1")
    size = int(df.count() * fraction)
    if size < 2:
        raise ValueError(f"a share of {fraction} leaves fewer than two rows")
    ordered = df.withColumn("_order", seeded_order(f"{seed}/{repeat}/{side}", id_column))
    cut = hash_at_rank(ordered, "_order", size)
    return (ordered if cut is None else ordered.filter(F.col("_order") <= cut)).drop("_order")


def hash_at_rank(df: DataFrame, order: str, size: int) -> str | None:
    """The hash of row number `size` in hash order; None when there are no more rows than that.

    Rows are counted per hash prefix; only those under the prefix that holds the rank are ranked.
    """
    prefix = F.substring(order, 1, 3)
    before = 0
    for p, n in sorted(tuple(r) for r in df.groupBy(prefix.alias("p")).count().collect()):  # 4,096 prefixes
        if before + n >= size:
            break
        before += n
    else:
        return None
    inside = df.filter(prefix == p).groupBy(order).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(inside, [order], ["n"])
    return ranked.filter(F.col("cum_n") >= size - before).agg(F.min(order)).first()[0]


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def inspection_sample(
    records: DataFrame, n_clusters: int, seed: int = 42, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rows to annotate and, per cluster and category, how many candidates were skipped and why.

    Per cluster: 4 highest similarity, then 3 nearest the cluster median, then 3 lowest margin, no id
    and no stripped text twice, ties in seeded order. Each pass keeps the best row per (cluster, text)
    by a partial aggregate and then the quota by a rank limit that is applied per task first, so a
    cluster holding a third of all rows never meets in one task.

    `records`: source_row_id, cluster_id, assigned_centroid_cosine_similarity, assignment_margin,
    review_text.
    """
    medians = describe(records, "assigned_centroid_cosine_similarity", ["cluster_id"], (0.5,)).select("cluster_id", "median")
    similarity = F.col("assigned_centroid_cosine_similarity")
    # Ranking columns only; the text is fetched for the chosen rows at the end.
    base = materialize(
        records.join(F.broadcast(medians), "cluster_id").select(
            "cluster_id", "source_row_id",
            text_digest(clean_text("review_text")).alias("_text"),
            (-similarity).alias("high_similarity"),
            F.abs(similarity - F.col("median")).alias("intermediate_similarity"),
            F.col("assignment_margin").alias("low_margin"),
            seeded_order(seed, "source_row_id").alias("_tie"),
        ),
        "inspection-candidates",
    )
    chosen: DataFrame | None = None
    skipped: DataFrame | None = None
    for category, quota in QUOTAS:
        ranked = base.withColumn("_rank", F.struct(F.col(category).alias("key"), "_tie", "source_row_id"))
        if chosen is None:
            open_rows = ranked
        else:
            used_texts = F.broadcast(chosen.select("cluster_id", "_text"))
            open_rows = ranked.join(used_texts, ["cluster_id", "_text"], "left_anti")
        firsts = open_rows.groupBy("cluster_id", "_text").agg(F.min("_rank").alias("_rank"))
        window = Window.partitionBy("cluster_id").orderBy("_rank")
        taken = materialize(
            firsts.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= quota)
            .select("cluster_id", "_text", "_rank", F.col("_rank.source_row_id").alias("source_row_id"),
                    "position", F.lit(category).alias("sampling_category")),
            "inspection-taken",
        )  # quota rows per cluster
        last = taken.groupBy("cluster_id").agg(F.max("_rank").alias("_last"))
        earlier = taken.select("source_row_id", F.lit(2).alias("_used"))
        if chosen is not None:
            earlier = earlier.unionAll(chosen.select("source_row_id", F.lit(1).alias("_used")))
        passed = ranked.join(F.broadcast(last), "cluster_id").filter(F.col("_rank") < F.col("_last"))
        counted = passed.join(F.broadcast(earlier), "source_row_id", "left").groupBy("cluster_id").agg(
            F.count_if(F.col("_used") == 1).alias("already_selected_id"),
            F.count_if(F.col("_used").isNull()).alias("duplicate_stripped_text"),
        ).withColumn("sampling_category", F.lit(category))
        chosen = taken if chosen is None else chosen.unionByName(taken)
        skipped = counted if skipped is None else skipped.unionByName(counted)
    if strict:
        found = {r.cluster_id: r.n for r in chosen.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        wanted = sum(q for _, q in QUOTAS)
        short = [k for k in range(n_clusters) if found.get(k, 0) != wanted]
        if short or set(found) - set(range(n_clusters)):
            raise ValueError(f"clusters without {wanted} distinct eligible reviews: {short}")
    picked = F.broadcast(chosen.select("source_row_id", "cluster_id", "sampling_category", "position"))
    sample = records.join(picked, ["source_row_id", "cluster_id"]).select(
        "source_row_id", "cluster_id", "assigned_centroid_cosine_similarity", "assignment_margin",
        "sampling_category", "position", "review_text", *(F.lit("").alias(a) for a in ANNOTATIONS),
    )
    every = chosen.sparkSession.range(n_clusters).select(
        F.col("id").cast("int").alias("cluster_id"),
        F.explode(F.array(*(F.lit(c) for c, _ in QUOTAS))).alias("sampling_category"),
    )
    details = every.join(skipped, ["cluster_id", "sampling_category"], "left").select(
        "cluster_id", "sampling_category",
        F.coalesce("already_selected_id", F.lit(0)).alias("already_selected_id"),
        F.coalesce("duplicate_stripped_text", F.lit(0)).alias("duplicate_stripped_text"),
    )
    return sample, details
