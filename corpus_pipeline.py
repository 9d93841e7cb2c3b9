"""A corpus pipeline over `documents`: each stage works on all that its predecessor kept.

Stages drop documents of low quality, all but one document of each group of near copies, and documents that hold passages of
the benchmark; then documents are repeated or left out by the rates that bring the domains to their targets, and dealt
into shards. All stages but the last return the columns of their input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clustrum.llm import decontaminate, jaccard, mixing, quality, shards
from clustrum.llm.common import table
from clustrum.llm.queries import DOMAIN_TARGETS, label_domains
from clustrum.session import materialize

N_SHARDS = 16


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled documents of `documents`."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), "doc_id", "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 percent of common five-word shingles, and all others."""
    return jaccard.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture's rates say."""
    return mixing.mixed_rows(docs, label_domains(table(spark, sf_dir, "labels")), DOMAIN_TARGETS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return shards.assign_shards(docs, N_SHARDS)


STAGES = [
    ("quality classifier", good_documents), ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark), ("mixing sources to target weights", mixed_to_targets), ("sharding", sharded),
]
#: The classifiers and the least-squares fit cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written out before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{position}")
    return docs
