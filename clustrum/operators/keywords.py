"""Naming clusters: class TF-IDF keywords and plain term frequencies."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustrum.functions.text import FRENCH_STOP_WORDS, SEPARATOR, clean_text, stop_tokens, tokens
from clustrum.session import checked_broadcast, materialize

# Verbs left out of word clouds.
CLOUD_STOP_WORDS = ("être", "avoir", "faire", "dire", "aller", "voir", "pouvoir")


#: Characters of texts whose terms a task counts at a time.
BLOCK_CHARS = 1 << 24



def _folded_terms(clusters: pa.Array, texts: pa.Array, stop: Iterable[str]) -> pa.RecordBatch:
    """(cluster, term, tf) of the words and neighbouring pairs of lower-case texts, one row per cluster and term."""
    pieces = pc.split_pattern_regex(texts.cast(pa.string()), SEPARATOR)
    coded_words = pieces.flatten().dictionary_encode()
    words, ids = coded_words.dictionary, coded_words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(pieces.offsets.to_numpy()))
    wanted = pc.and_(pc.greater_equal(pc.utf8_length(words), 2), pc.invert(pc.is_in(words, value_set=pa.array(sorted(stop), pa.string()))))
    kept = wanted.to_numpy(zero_copy_only=False)[ids]
    ids, row = ids[kept], row[kept]
    # Clusters by number; the first row of each stands for its value.
    coded = clusters.dictionary_encode()
    code, width = coded.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64), np.int64(max(1, len(words)))
    pair = np.flatnonzero(row[1:] == row[:-1])
    keys, counts = np.unique(code * width + ids, return_counts=True)
    pairs, pair_counts = np.unique((code[pair] * width + ids[pair]) * width + ids[pair + 1], return_counts=True)
    second, first, owner = pairs % width, pairs // width % width, pairs // width // width
    terms = [words.take(pa.array(keys % width)), pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), " ")]
    owners = np.concatenate([keys // width, owner])
    return pa.record_batch(
        [coded.dictionary.take(pa.array(owners)), pa.concat_arrays(terms), pa.array(np.concatenate([counts, pair_counts]))], ["cluster", "term", "tf"])


def term_counts(
    df: DataFrame, text: str = "text", label: str = "cluster_id", stop_words: Iterable[str] = FRENCH_STOP_WORDS
) -> DataFrame:
    """Counts of words and word pairs per cluster; noise and blank texts are left out.

    Pairs are neighbours among the words that are no stop words. Each task counts its terms as numbers of words, block by
    block, and sends one row per cluster and term.
    """
    kept = df.filter(F.col(label) >= 0).select(F.col(label).alias("cluster"), F.lower(clean_text(text)).alias("_t")).filter("_t <> ''")
    stop = stop_tokens(stop_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // BLOCK_CHARS)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for start, end in zip(cuts, cuts[1:]):
                part = batch.slice(start, end - start)
                yield _folded_terms(part.column(0), part.column(1), stop)

    folded = kept.mapInArrow(count, f"cluster {dict(kept.dtypes)['cluster']}, term string, tf long")
    # Dealt out before they are added up: the blocks are folded already, and a second fold in the task would save few rows.
    return folded.repartition("cluster", "term").groupBy("cluster", "term").agg(F.sum("tf").alias("tf"))


def ctfidf_keywords(
    df: DataFrame,
    text: str = "text",
    label: str = "cluster_id",
    stop_words: Iterable[str] = FRENCH_STOP_WORDS,
    top_n: int = 10,
) -> DataFrame:
    """The `top_n` terms per cluster by class TF-IDF; equal scores go to the lower term.

    Only (cluster, term) counts are shuffled; a term has at most one row per cluster by then, and
    the ranking keeps `top_n` rows per cluster and task before it shuffles.
    """
    counts = materialize(term_counts(df, text, label, stop_words), "term-counts")
    # Hash-partitioning on the term serves its total; a window saves the join back.
    with_total = counts.withColumn("_f", F.sum("tf").over(Window.partitionBy("term")))
    classes = counts.groupBy("cluster").agg(F.sum("tf").alias("_words"))
    mean = classes.agg(F.floor(F.avg("_words")).alias("_average"))
    scored = with_total.join(checked_broadcast(classes.join(F.broadcast(mean))), "cluster").select(
        "cluster", "term",
        (F.col("tf") / F.col("_words") * F.log(1 + F.col("_average") / F.col("_f"))).alias("score_ctfidf"),
    )
    return top_terms(scored, top_n)


def top_terms(scored: DataFrame, top_n: int = 10, score: str = "score_ctfidf") -> DataFrame:
    window = Window.partitionBy("cluster").orderBy(F.col(score).desc(), F.col("term"))
    return (
        scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top_n)
        .select("cluster", "rank", "term", score)
    )


def term_frequency(
    df: DataFrame,
    text: str = "text",
    stop_words: Iterable[str] = (*FRENCH_STOP_WORDS, *CLOUD_STOP_WORDS),
    top_n: int = 100,
) -> DataFrame:
    """The most frequent alphabetic words of three letters or more, without addresses."""
    plain = F.regexp_replace(F.lower(clean_text(text)), r"(https?://|www\.)[^ \t\r\n]+|[^ \t\r\n]+@[^ \t\r\n]+", " ")
    words = df.select(F.explode(tokens(plain, stop_tokens(stop_words))).alias("term"))
    counted = words.filter(F.col("term").rlike(r"^[\p{L}]{3,}$")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), F.col("term")).limit(top_n)
