"""Queries of the readers and writers: driver tables are written in the reviewed formats and read back."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from clustrum.functions.text import text_digest
from clustrum.operators.cleaning import reject_invalid, text_features
from clustrum.operators.cohorts import batch_plan, chronological_split, source_row_index
from clustrum.operators.models import encode_texts
from clustrum.operators.profile import null_profile
from clustrum.plans.common import rounded, sql_clean, sql_words, table
from clustrum.plans.requests import request_log
from clustrum.session import scratch_path
from clustrum.sources import embeddings as embedding_source
from clustrum.sources import requests as request_source
from clustrum.sources import reviews

CLEAN = sql_clean()


def strict_query(spark, sf):
    path = scratch_path(spark, "cohort-csv")
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("commentaire"), "doc_id")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").drop("doc_id")
    reviews.write_reviews(ordered, path)
    read = reviews.read_reviews_strict(spark, path, "commentaire", "key", max_characters=1_000_000)
    return read.select("source_row_id", "source_row_index", F.sha2("text", 256).alias("text_digest"))


def write_once_query(spark, sf):
    """A second write to the same place is refused and leaves the first one as it is."""
    path = scratch_path(spark, "once")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("observation_id"), F.col("label").alias("cluster_id"))
    reviews.write_assignments(rows, path)
    refused = False
    try:
        reviews.write_assignments(rows.limit(1), path)
    except AnalysisException:
        refused = True
    kept = spark.read.csv(path, header=True).agg(F.count(F.lit(1)).alias("kept"))
    return kept.select("kept", F.lit(refused).alias("refused"))


def raw_query(spark, sf):
    path = scratch_path(spark, "raw-csv")
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    raw = documents.join(labels, "doc_id", "left").select(
        F.when(F.col("lang") != "es", F.col("text")).alias("commentaire"), F.col("source").alias("titre"),
        F.col("lang").alias("auteur"), F.lit("January 2, 2025").alias("date_avis"),
        F.lit("May 05, 2025").alias("date_experience"), F.col("quality").alias("note"),
        F.lit(None).cast("string").alias("texteServiceReply"), F.col("doc_id").cast("string").alias("url"),
        F.lit(None).cast("string").alias("dateServiceReply"), F.lit(None).cast("string").alias("dataServiceReply"),
    )
    reviews.write_reviews(raw, path, sep=";")
    return reviews.read_raw_reviews(spark, path).select(
        F.col("url").cast("long").alias("doc_id"), "titre", "auteur", "note", text_digest(F.col("commentaire")).alias("text_digest")
    )


def contract_query(spark, sf):
    path = scratch_path(spark, "contract-csv")
    documents = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    reviews.write_reviews(documents, path)
    checked = reviews.read_reviews_contract(spark, path, "doc_id", "text", documents.count())
    return text_features(checked).select("doc_id", "character_length", "word_count")


def embedding_query(spark, sf):
    path = scratch_path(spark, "embeddings")
    embedding_source.write_embeddings(table(spark, sf, "embeddings").select("vec_id", "embedding"), path)
    read = embedding_source.read_embeddings(spark, path, dimension=64)
    embedding_source.check_alignment(read, table(spark, sf, "embeddings"), "vec_id", "vec_id")
    return embedding_source.embedding_contract(read)


def assignment_query(spark, sf):
    path = scratch_path(spark, "assignments")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("observation_id"), F.lit("run").alias("logical_id"), F.col("label").alias("cluster_id"))
    reviews.write_assignments(rows, path)
    return reviews.read_assignments(spark, path)


def split_query(spark, sf):
    path = scratch_path(spark, "splits")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    reviews.write_splits(chronological_split(orders, "o_orderdate", "o_orderkey", {"training": 0.6, "reference": 0.1, "production": 0.2}), path)
    return spark.read.parquet(path).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date")
    )


def report_query(spark, sf):
    path = scratch_path(spark, "report")
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    profile = null_profile(joined, ["quality", "toxic", "lang"]).withColumn(
        "ratio", F.when(F.col("null_count") == 0, F.lit(float("nan"))).otherwise(F.col("null_percent"))
    )
    reviews.write_report(profile, path)
    read = spark.read.schema("column_name string, null_count bigint, ratio double").json(path)
    return read.select("column_name", "null_count", rounded("ratio"))


def request_query(spark, sf):
    path = scratch_path(spark, "request-log")
    request_source.write_request_log(request_log(spark, sf), path)
    log = request_source.read_request_log(spark, path)
    return log.select(
        "request_id", "state", F.size("attempts").alias("attempts"), F.size("records").alias("records"),
        rounded(F.col("attempts")[0]["latency_seconds"], "first_latency"),
    )


def log_check_query(spark, sf):
    """Checks the log against a plan that lacks the last event of every batch with an error."""
    log = request_log(spark, sf)
    plan = log.select("request_id", F.when(
        F.exists("records", lambda r: ~r["success"]), F.slice("source_row_ids", 1, F.size("source_row_ids") - 1)
    ).otherwise(F.col("source_row_ids")).alias("source_row_ids"))
    return request_source.log_violations(log, plan, "run-1").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def encoded_query(spark, sf):
    path = scratch_path(spark, "encoded")
    embedding_source.write_embeddings(encode_texts(table(spark, sf, "documents").select("doc_id", "text")).drop("text"), path)
    return embedding_source.embedding_contract(embedding_source.read_embeddings(spark, path, dimension=64))


def plan_query(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    return batch_plan(source_row_index(documents, ["doc_id"]), 16).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("source_row_index").alias("last_index")
    )


def review_contract_counts(spark, sf):
    return reject_invalid(table(spark, sf, "documents"), "doc_id")


QUERIES = {
    "read_reviews_strict": strict_query,
    "read_raw_reviews": raw_query,
    "read_reviews_contract": contract_query,
    "review_contract_counts": review_contract_counts,
    "read_embeddings": embedding_query,
    "write_once": write_once_query,
    "read_assignments": assignment_query,
    "write_splits": split_query,
    "write_report": report_query,
    "write_embeddings": encoded_query,
    "read_request_log": request_query,
    "request_log_violations": log_check_query,
    "batch_plan": plan_query,
}

ORACLES = {
    "read_reviews_strict": """
        SELECT CAST(doc_id AS VARCHAR) AS source_row_id, row_number() OVER (ORDER BY doc_id) - 1 AS source_row_index,
          sha256(text) AS text_digest FROM documents""",
    "read_raw_reviews": """
        SELECT d.doc_id, d.source AS titre, d.lang AS auteur, l.quality AS note,
          sha256(CASE WHEN lang <> 'es' THEN text END) AS text_digest
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "read_reviews_contract": f"""
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(length({CLEAN}) AS INTEGER) AS character_length,
          {sql_words(CLEAN)} AS word_count FROM documents""",
    "review_contract_counts": f"""
        SELECT count(*) AS n_rows, count(*) FILTER (WHERE {CLEAN} = '') AS blank_texts,
          count(*) FILTER (WHERE doc_id IS NULL) AS missing_ids, count(doc_id) - count(DISTINCT doc_id) AS surplus_ids FROM documents""",
    "read_embeddings": """
        SELECT count(*) AS n_rows, CAST(min(len(embedding)) AS BIGINT) AS min_dimension,
          CAST(max(len(embedding)) AS BIGINT) AS max_dimension,
          count(*) FILTER (WHERE embedding IS NULL) AS missing,
          count(*) FILTER (WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite,
          count(*) FILTER (WHERE abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-5) AS not_unit
        FROM embeddings""",
    "write_once": "SELECT count(*) AS kept, true AS refused FROM embeddings",
    "read_assignments": "SELECT CAST(vec_id AS VARCHAR) AS observation_id, 'run' AS logical_id, label AS cluster_id FROM embeddings",
    "write_splits": """
        WITH ranked AS (SELECT CAST(o_orderdate AS DATE) AS d, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
        SELECT CASE WHEN r <= floor(n * 0.6 + 1e-9) THEN 'training'
            WHEN r <= floor(n * 0.6 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'reference'
            WHEN r <= floor(n * 0.6 + 1e-9) + floor(n * 0.1 + 1e-9) + floor(n * 0.2 + 1e-9) THEN 'production' ELSE 'final' END AS cohort,
          count(*) AS n, min(d) AS first_date, max(d) AS last_date FROM ranked GROUP BY 1""",
    "write_report": """
        SELECT c AS column_name, nulls AS null_count, CASE WHEN nulls > 0 THEN round(nulls * 100.0 / n, 6) + 0.0 END AS ratio
        FROM (SELECT count(*) AS n, count(*) - count(quality) AS quality, count(*) - count(toxic) AS toxic, count(*) - count(lang) AS lang
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) UNPIVOT (nulls FOR c IN (quality, toxic, lang))""",
    "write_embeddings": """
        SELECT count(*) AS n_rows, CAST(64 AS BIGINT) AS min_dimension, CAST(64 AS BIGINT) AS max_dimension,
          CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS not_unit FROM documents""",
    "read_request_log": """
        SELECT printf('batch-%06d', event_id // 16) AS request_id, 'complete' AS state, CAST(1 AS INTEGER) AS attempts,
          CAST(count(*) AS INTEGER) AS records, round(max(value) / 1000, 6) + 0.0 AS first_latency
        FROM events GROUP BY event_id // 16""",
    "request_log_violations": """
        WITH batches AS (SELECT event_id // 16 AS b, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1)
        SELECT 'plan_mismatch' AS reason, count(*) AS n FROM batches WHERE failed HAVING count(*) > 0""",
    "batch_plan": """
        WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x FROM documents)
        SELECT printf('batch-%06d', x // 16) AS request_id, count(*) AS n, min(doc_id) AS first_id, max(x) AS last_index
        FROM i GROUP BY x // 16""",
}
