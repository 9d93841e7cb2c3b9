"""Embedding tables: contract check on read, one write per encoder."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrum.functions.vectors import is_finite, is_unit
from clustrum.operators.cleaning import ContractError


def embedding_contract(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: count, dimensions, and rows that are missing, not finite or not of unit length."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size(vector)).cast("long").alias("min_dimension"),
        F.max(F.size(vector)).cast("long").alias("max_dimension"),
        F.count_if(F.col(vector).isNull()).alias("missing"),
        F.count_if(~is_finite(vector)).alias("not_finite"),
        F.count_if(~is_unit(vector)).alias("not_unit"),
    )


def check_embeddings(df: DataFrame, vector: str = "embedding", dimension: int | None = None) -> DataFrame:
    found = embedding_contract(df, vector).first()
    if not found.n_rows or found.missing or found.not_finite or found.not_unit:
        raise ContractError(f"embeddings must be finite unit rows: {found.asDict()}")
    if found.min_dimension != found.max_dimension or (dimension or found.max_dimension) != found.max_dimension:
        raise ContractError(f"embedding dimension mismatch: {found.asDict()}")
    return df


def check_alignment(embeddings: DataFrame, reviews: DataFrame, embedding_id: str, review_id: str) -> None:
    """Both tables have to hold the same ids; counted with one row per id and side."""
    both = (
        embeddings.select(F.col(embedding_id).cast("string").alias("id"), F.lit(1).alias("e"), F.lit(0).alias("r"))
        .unionAll(reviews.select(F.col(review_id).cast("string").alias("id"), F.lit(0).alias("e"), F.lit(1).alias("r")))
        .groupBy("id").agg(F.sum("e").alias("e"), F.sum("r").alias("r"))
    )
    wrong = both.filter("e != 1 or r != 1").limit(1).count()
    if wrong:
        raise ContractError("embedding and review ids do not match one to one")


def read_embeddings(spark: SparkSession, path: str, vector: str = "embedding", dimension: int | None = None) -> DataFrame:
    return check_embeddings(spark.read.parquet(path), vector, dimension)


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.parquet(path, mode="errorifexists")
