"""Table access and SQL fragments shared by the registered queries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrum.functions.text import WHITESPACE
from clustrum.session import spread

N_CLUSTERS = 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows, "doc_id") if name == "documents" else rows


def rounded(column: str | Column, name: str | None = None, places: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    expr = F.col(column) if isinstance(column, str) else column
    out = F.round(expr, places) + F.lit(0.0)
    return out.alias(name or column) if (name or isinstance(column, str)) else out


def labelled_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").withColumnRenamed("label", "cluster_id")


def noisy_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label 0 plays the noise: labels -1..8."""
    return table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") - 1).alias("cluster_id"))


def cohort_column(id_column: str) -> Column:
    """Hash split of all rows into four development cohorts and the final one."""
    digit = F.substring(F.sha2(F.col(id_column).cast("string"), 256), 1, 1)
    return (
        F.when(digit.isin(*"01234567"), "training").when(digit.isin(*"89"), "selection")
        .when(digit.isin(*"ab"), "reference").when(digit.isin(*"cd"), "production").otherwise("final")
    )


def sql_cohort(id_column: str) -> str:
    digit = f"substr(sha256(CAST({id_column} AS VARCHAR)), 1, 1)"
    return (
        f"CASE WHEN {digit} IN ('0','1','2','3','4','5','6','7') THEN 'training' WHEN {digit} IN ('8','9') THEN 'selection' "
        f"WHEN {digit} IN ('a','b') THEN 'reference' WHEN {digit} IN ('c','d') THEN 'production' ELSE 'final' END"
    )


def sql_clean(text: str = "text") -> str:
    return f"trim(coalesce({text}, ''), '{WHITESPACE}')"


def sql_words(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '[^{WHITESPACE}]+')) AS INTEGER)"


def sql_round(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0"


# Unit label means of `embeddings`, as (cluster_id, centroid): the fixed centroids of the geometry queries.
SQL_SUMS = """
sums AS (
  SELECT label AS cluster_id, i, sum(CAST(embedding[i] AS DOUBLE)) AS s, count(*) AS n
  FROM embeddings, range(1, 65) t(i) GROUP BY label, i
)"""
SQL_CENTROIDS = SQL_SUMS + """,
centroids AS (
  SELECT cluster_id, list(s / norm ORDER BY i) AS centroid
  FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY cluster_id)) AS norm FROM sums) GROUP BY cluster_id
),
vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
products AS (
  SELECT vec_id, label, cluster_id, list_dot_product(v, centroid) AS similarity FROM vectors, centroids
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, cluster_id) AS rk FROM products
),
geometry AS (
  SELECT a.vec_id, a.label, a.cluster_id, least(1.0, greatest(-1.0, a.similarity)) AS similarity,
    1 - least(1.0, greatest(-1.0, a.similarity)) AS distance, a.similarity - b.similarity AS margin
  FROM ranked a JOIN ranked b ON a.vec_id = b.vec_id AND a.rk = 1 AND b.rk = 2
)"""
