"""Queries of the cohort operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from clustrum.operators import cohorts, sampling
from clustrum.operators.geometry import assignment_geometry, centroids_of
from clustrum.plans.common import (
    N_CLUSTERS, SQL_CENTROIDS, cohort_column, labelled_embeddings, rounded, sql_clean, sql_cohort, table,
)

CLEAN = sql_clean()
COHORTS = {"training": 0.6, "reference": 0.1, "production": 0.2}


def split_documents(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text").withColumn("cohort", cohort_column("doc_id"))
    return documents.filter(F.col("cohort") == "final").drop("cohort"), documents.filter(F.col("cohort") != "final")


def chronological_query(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return cohorts.chronological_split(orders, "o_orderdate", "o_orderkey", COHORTS)


def undated_split_query(spark, sf):
    """Every third order without a date: the last boundary lies among them."""
    date = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("date"))
    orders = table(spark, sf, "orders").select("o_orderkey", date.alias("day"))
    return cohorts.chronological_split(orders, "day", "o_orderkey", COHORTS)


def counted_split_query(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return cohorts.chronological_split(events, "event_type", "event_id", {"training": 300, "reference": 50, "production": 10**9}).groupBy(
        "cohort", "event_type").agg(F.count(F.lit(1)).alias("n"))


def index_query(spark, sf):
    return cohorts.source_row_index(table(spark, sf, "documents").select("lang", "doc_id"), ["lang", "doc_id"])


def id_overlap_query(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("cohort"))
    return cohorts.cohort_id_overlap(table(spark, sf, "labels").select("doc_id"), documents, "doc_id")


def text_overlap_query(spark, sf):
    return cohorts.cohort_text_overlap(*split_documents(spark, sf))


def benchmark_overlap_query(spark, sf):
    known = table(spark, sf, "benchmark").select("text", F.lit("benchmark").alias("cohort"))
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    return cohorts.cohort_text_overlap(lines, known)


def audit_query(spark, sf):
    return cohorts.cohort_audit(*split_documents(spark, sf), "doc_id").drop("fingerprint")


def fingerprint_query(spark, sf):
    return cohorts.table_fingerprint(table(spark, sf, "documents"), ["doc_id", "lang"], ["lang"])


def records(spark, sf):
    """Predictions with faults: label 9 failed, label 3 shifted by one row, label 7 by another model,
    label 8 out of range, label 5 missing, label 1 recorded twice."""
    rows = table(spark, sf, "embeddings").filter("label != 5").withColumn(
        "copy", F.explode(F.when(F.col("label") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    label = F.col("label")
    return rows.select(
        F.col("vec_id").cast("string").alias("source_row_id"),
        (F.col("vec_id") + F.when(label == 3, 1).otherwise(0)).alias("source_row_index"),
        F.when(label == 7, "other").otherwise("model-1").alias("model_id"),
        (label != 9).alias("success"),
        F.when(label == 8, 42).when(label != 9, label).alias("cluster_id"),
    )


def source(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("source_row_id"), F.col("vec_id").alias("source_row_index"))


def align_query(spark, sf):
    return cohorts.align_predictions(source(spark, sf), records(spark, sf), "model-1", N_CLUSTERS, allow_subset=True)


def violations_query(spark, sf):
    return cohorts.prediction_violations(source(spark, sf), records(spark, sf), "model-1", N_CLUSTERS)


def geometry(spark, sf):
    rows = labelled_embeddings(spark, sf)
    return assignment_geometry(rows.select("vec_id", "embedding"), centroids_of(rows))


def joined_query(spark, sf):
    predictions = geometry(spark, sf).select(
        F.col("vec_id").cast("string").alias("source_row_id"), "cluster_id", "assigned_centroid_cosine_similarity", "assignment_margin"
    )
    texts = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_row_id"), F.col("text").alias("review_text"))
    return cohorts.join_text_to_predictions(texts, predictions, N_CLUSTERS).select(
        "source_row_id", "cluster_id", rounded("assigned_centroid_cosine_similarity", "similarity"),
        rounded("assignment_margin", "margin"), F.length("review_text").alias("n_chars"),
    )


def gaps_query(spark, sf):
    side = lambda name: table(spark, sf, name).select(F.col("doc_id").alias("source_row_id"))
    return cohorts.coverage_gaps(side("documents"), side("labels"))


def sampled(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("review_text"))
    return geometry(spark, sf).join(texts, "vec_id").select(
        F.col("vec_id").cast("string").alias("source_row_id"), "cluster_id",
        rounded("assigned_centroid_cosine_similarity"), rounded("assignment_margin"), "review_text",
    )


def inspection_query(spark, sf):
    sample, _ = sampling.inspection_sample(sampled(spark, sf), N_CLUSTERS, strict=False)
    return sample.select(
        "source_row_id", "cluster_id", "sampling_category", "position", F.sha2("review_text", 256).alias("text_digest"), *sampling.ANNOTATIONS
    )


def skipped_query(spark, sf):
    _, details = sampling.inspection_sample(sampled(spark, sf), N_CLUSTERS, strict=False)
    return details


def shuffle_query(spark, sf):
    return sampling.seeded_shuffle_limit(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 42, 100)


def fixed_query(spark, sf):
    return sampling.fixed_sample(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 42, 200)


def digest_query(spark, sf):
    return sampling.sample_digest(sampling.fixed_sample(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 42, 200), "vec_id")


def fraction_query(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    a = sampling.fraction_subset(documents, "doc_id", 0.8, 42, 0, "a").withColumn("side", F.lit("a"))
    return a.unionByName(sampling.fraction_subset(documents, "doc_id", 0.8, 42, 0, "b").withColumn("side", F.lit("b")))


def top_query(spark, sf):
    return sampling.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25)


def ordered_query(spark, sf):
    """Digest of all event ids in order: more than one leaf of the tree."""
    return sampling.ordered_digest(table(spark, sf, "events"), "event_id")


QUERIES = {
    "chronological_split": chronological_query,
    "chronological_split_nulls": undated_split_query,
    "chronological_split_by_count": counted_split_query,
    "source_row_index": index_query,
    "cohort_id_overlap": id_overlap_query,
    "cohort_text_overlap": text_overlap_query,
    "benchmark_line_overlap": benchmark_overlap_query,
    "cohort_audit": audit_query,
    "table_fingerprint": fingerprint_query,
    "align_predictions": align_query,
    "prediction_violations": violations_query,
    "join_text_to_predictions": joined_query,
    "coverage_gaps": gaps_query,
    "inspection_sample": inspection_query,
    "inspection_skipped": skipped_query,
    "seeded_shuffle_limit": shuffle_query,
    "fixed_sample": fixed_query,
    "fixed_sample_digest": digest_query,
    "ordered_digest": ordered_query,
    "fraction_subset": fraction_query,
    "top_k": top_query,
}

SQL_RECORDS = """
records AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, vec_id + CASE WHEN label = 3 THEN 1 ELSE 0 END AS idx, label,
    CASE WHEN label = 7 THEN 'other' ELSE 'model-1' END AS model, label <> 9 AS success, vec_id
  FROM embeddings, range(0, 2) c(copy) WHERE label <> 5 AND (label = 1 OR copy = 0)
)"""
SQL_SAMPLE = SQL_CENTROIDS + """,
records AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, cluster_id, round(similarity, 6) + 0.0 AS sim, round(margin, 6) + 0.0 AS margin,
    text AS review_text, sha256('42|' || vec_id) AS tie
  FROM geometry JOIN documents ON doc_id = vec_id
),
base AS (
  SELECT *, CLEAN AS t, abs(sim - median(sim) OVER (PARTITION BY cluster_id)) AS mid FROM records
),
r1 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY -sim, tie, id) AS rk FROM base),
f1 AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY cluster_id, t ORDER BY rk) = 1),
s1 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rk) AS position FROM f1 QUALIFY position <= 4),
r2 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY mid, tie, id) AS rk FROM base),
f2 AS (SELECT * FROM r2 WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.cluster_id = r2.cluster_id AND s1.t = r2.t)
  QUALIFY row_number() OVER (PARTITION BY cluster_id, t ORDER BY rk) = 1),
s2 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rk) AS position FROM f2 QUALIFY position <= 3),
u2 AS (SELECT cluster_id, id, t FROM s1 UNION ALL SELECT cluster_id, id, t FROM s2),
r3 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY margin, tie, id) AS rk FROM base),
f3 AS (SELECT * FROM r3 WHERE NOT EXISTS (SELECT 1 FROM u2 WHERE u2.cluster_id = r3.cluster_id AND u2.t = r3.t)
  QUALIFY row_number() OVER (PARTITION BY cluster_id, t ORDER BY rk) = 1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rk) AS position FROM f3 QUALIFY position <= 3),
chosen AS (
  SELECT cluster_id, id, 'high_similarity' AS category, position, rk, review_text FROM s1
  UNION ALL SELECT cluster_id, id, 'intermediate_similarity', position, rk, review_text FROM s2
  UNION ALL SELECT cluster_id, id, 'low_margin', position, rk, review_text FROM s3
)""".replace("CLEAN", sql_clean("review_text"))


def skipped_sql(rank: str, category: str, earlier: str) -> str:
    return f"""
        SELECT k.cluster_id, '{category}' AS sampling_category,
          count(*) FILTER (WHERE r.rk < l.last AND r.id IN (SELECT id FROM {earlier})) AS already_selected_id,
          count(*) FILTER (WHERE r.rk < l.last AND r.id NOT IN (SELECT id FROM {earlier})
            AND r.id NOT IN (SELECT id FROM chosen WHERE category = '{category}')) AS duplicate_stripped_text
        FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS cluster_id) k LEFT JOIN {rank} r ON r.cluster_id = k.cluster_id
        LEFT JOIN (SELECT cluster_id, max(rk) AS last FROM chosen WHERE category = '{category}' GROUP BY 1) l ON l.cluster_id = k.cluster_id
        GROUP BY k.cluster_id"""


def fraction_sql(side: str) -> str:
    return f"""
        SELECT doc_id, lang, '{side}' AS side FROM documents
        QUALIFY row_number() OVER (ORDER BY sha256('42/0/{side}|' || doc_id)) <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER ())"""


ORACLES = {
    "chronological_split": """
        WITH ranked AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, o_orderdate, CASE WHEN r <= floor(n * 0.6 + 1e-9) THEN 'training'
            WHEN r <= floor(n * 0.6 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'reference'
            WHEN r <= floor(n * 0.6 + 1e-9) + floor(n * 0.1 + 1e-9) + floor(n * 0.2 + 1e-9) THEN 'production' ELSE 'final' END AS cohort FROM ranked""",
    "chronological_split_nulls": """
        WITH dated AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
        ranked AS (SELECT *, row_number() OVER (ORDER BY day NULLS LAST, o_orderkey) AS r, count(*) OVER () AS n FROM dated)
        SELECT o_orderkey, day, CASE WHEN r <= floor(n * 0.6 + 1e-9) THEN 'training'
            WHEN r <= floor(n * 0.6 + 1e-9) + floor(n * 0.1 + 1e-9) THEN 'reference'
            WHEN r <= floor(n * 0.6 + 1e-9) + floor(n * 0.1 + 1e-9) + floor(n * 0.2 + 1e-9) THEN 'production' ELSE 'final' END AS cohort FROM ranked""",
    "chronological_split_by_count": """
        WITH ranked AS (SELECT event_type, row_number() OVER (ORDER BY event_type, event_id) AS r FROM events)
        SELECT CASE WHEN r <= 300 THEN 'training' WHEN r <= 350 THEN 'reference' ELSE 'production' END AS cohort, event_type, count(*) AS n
        FROM ranked GROUP BY 1, 2""",
    "source_row_index": "SELECT lang, doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS source_row_index FROM documents",
    "cohort_id_overlap": """
        SELECT lang AS cohort, count(DISTINCT l.doc_id) AS overlapping_ids FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""",
    "cohort_text_overlap": f"""
        WITH d AS (SELECT {CLEAN} AS t, {sql_cohort('doc_id')} AS cohort FROM documents),
        known AS (SELECT DISTINCT cohort, t FROM d WHERE cohort <> 'final')
        SELECT k.cohort, CAST(count(f.t) AS BIGINT) AS matching_text_rows FROM known k LEFT JOIN (SELECT t FROM d WHERE cohort = 'final') f ON f.t = k.t GROUP BY k.cohort""",
    "benchmark_line_overlap": f"""
        WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS text FROM documents)
        SELECT 'benchmark' AS cohort, count(*) FILTER (WHERE {CLEAN} IN (SELECT {CLEAN} FROM benchmark)) AS matching_text_rows FROM lines""",
    "cohort_audit": f"""
        WITH d AS (SELECT doc_id, {CLEAN} AS t, {sql_cohort('doc_id')} AS cohort FROM documents),
        f AS (SELECT t, count(*) AS n FROM d WHERE cohort = 'final' GROUP BY t),
        known AS (SELECT DISTINCT cohort, t FROM d WHERE cohort <> 'final')
        SELECT c.cohort, c.cohort_rows, CAST(0 AS BIGINT) AS overlapping_ids, CAST(coalesce(m.n, 0) AS BIGINT) AS matching_text_rows, true AS disjoint
        FROM (SELECT cohort, count(*) AS cohort_rows FROM d WHERE cohort <> 'final' GROUP BY 1) c
        LEFT JOIN (SELECT cohort, sum(f.n) AS n FROM known JOIN f ON f.t = known.t GROUP BY 1) m ON m.cohort = c.cohort""",
    "table_fingerprint": """
        WITH h AS (SELECT lang, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') AS x FROM documents),
        l AS (SELECT lang, i, CAST('0x' || substr(x, 1 + 8 * i, 8) AS UBIGINT) AS v FROM h, range(8) t(i)),
        s AS (SELECT lang, i, CAST(sum(CAST(v AS HUGEINT)) AS VARCHAR) AS total, CAST(bit_xor(v) AS VARCHAR) AS mixed, count(*) AS n FROM l GROUP BY 1, 2)
        SELECT lang, max(n) AS n_rows, sha256(max(n) || ':' || string_agg(total, '-' ORDER BY i) || ':' || string_agg(mixed, '-' ORDER BY i)) AS fingerprint
        FROM s GROUP BY lang""",
    "align_predictions": f"""
        WITH {SQL_RECORDS},
        per AS (SELECT id, count(*) AS copies, bool_or(success) AS ok FROM records GROUP BY id)
        SELECT (SELECT count(*) FROM embeddings) AS dataset_rows, (SELECT count(*) FROM per) AS recorded_rows,
          (SELECT count(*) FROM per WHERE ok) AS successful_rows, (SELECT count(*) FROM per WHERE NOT ok) AS failed_rows,
          (SELECT count(*) FROM embeddings WHERE label = 5) AS missing_rows, CAST(0 AS BIGINT) AS unknown_ids,
          (SELECT count(*) FROM per WHERE copies > 1) AS duplicate_ids,
          (SELECT count(*) FROM records WHERE label = 3) AS index_mismatches, (SELECT count(*) FROM records WHERE label = 7) AS wrong_models,
          CAST(0 AS BIGINT) AS invalid_flags, (SELECT count(*) FROM records WHERE label = 8) AS invalid_labels,
          CAST(0 AS BIGINT) AS failed_with_cluster, true AS subset, false AS accepted""",
    "prediction_violations": f"""
        WITH {SQL_RECORDS}
        SELECT id AS source_row_id, 'index_mismatch' AS reason, count(*) AS n FROM records WHERE label = 3 GROUP BY id
        UNION ALL SELECT id, 'wrong_model', count(*) FROM records WHERE label = 7 GROUP BY id
        UNION ALL SELECT id, 'invalid_label', count(*) FROM records WHERE label = 8 GROUP BY id
        UNION ALL SELECT id, 'duplicate_id', count(*) FROM records GROUP BY id HAVING count(*) > 1""",
    "join_text_to_predictions": f"""
        WITH {SQL_CENTROIDS}
        SELECT CAST(vec_id AS VARCHAR) AS source_row_id, cluster_id, round(similarity, 6) + 0.0 AS similarity, round(margin, 6) + 0.0 AS margin,
          CAST(length(text) AS INTEGER) AS n_chars FROM geometry JOIN documents ON doc_id = vec_id""",
    "coverage_gaps": """
        SELECT doc_id AS source_row_id, CAST(1 AS BIGINT) AS source_rows, CAST(0 AS BIGINT) AS prediction_rows
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "inspection_sample": f"""
        WITH {SQL_SAMPLE}
        SELECT id AS source_row_id, cluster_id, category AS sampling_category, CAST(position AS INTEGER) AS position, sha256(review_text) AS text_digest,
          '' AS proposed_theme, '' AS thematic_consistency, '' AS ambiguity, '' AS comments FROM chosen""",
    "inspection_skipped": f"WITH {SQL_SAMPLE}" + " UNION ALL ".join((
        skipped_sql("r1", "high_similarity", "(SELECT id FROM s1 WHERE false)"),
        skipped_sql("r2", "intermediate_similarity", "s1"),
        skipped_sql("r3", "low_margin", "u2"),
    )),
    "seeded_shuffle_limit": """
        SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('42|' || doc_id)) - 1 AS position FROM documents QUALIFY position < 100""",
    "fixed_sample": "SELECT vec_id, label FROM embeddings ORDER BY sha256('42|' || vec_id) LIMIT 200",
    "fixed_sample_digest": """
        SELECT count(*) AS n, sha256(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id)) AS ids_sha256
        FROM (SELECT vec_id FROM embeddings ORDER BY sha256('42|' || vec_id) LIMIT 200)""",
    "ordered_digest": """
        WITH leaves AS (
          SELECT "at" // 1024 AS leaf, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id)) AS d, count(*) AS n
          FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS "at" FROM events) GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN max(d) ELSE sha256(string_agg(d, ',' ORDER BY leaf)) END AS ids_sha256 FROM leaves""",
    "fraction_subset": fraction_sql("a") + " UNION ALL " + fraction_sql("b"),
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
}
