"""Queries of the drift operators. English texts are the reference cohort, French ones production."""
from __future__ import annotations

from pyspark.sql import functions as F

from clustrum.operators import drift
from clustrum.operators.cleaning import text_features
from clustrum.plans.common import cohort_column, rounded, sql_clean, sql_cohort, sql_round, sql_words, table

REFERENCE, PRODUCTION = "en", "fr"
CLEAN = sql_clean()


def featured(spark, sf):
    return text_features(table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("cohort"))).drop("text")


def histogram(spark, sf):
    return drift.pooled_histogram(drift.stack_features(featured(spark, sf)), REFERENCE, PRODUCTION)


def labels(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"), cohort_column("vec_id").alias("cohort"))
    return drift.label_histogram(rows, "training", "production")


def describe_query(spark, sf):
    out = drift.describe_drift(drift.stack_features(featured(spark, sf)))
    return out.select("feature", "cohort", "count", *(rounded(c) for c in ("mean", "std_population", "min", "p25", "median", "p75", "p95", "max")))


def ks_query(spark, sf):
    out = drift.distribution_distances(drift.with_running_counts(histogram(spark, sf)))
    return out.select("feature", "reference_rows", "production_rows", rounded("ks_statistic"))


def wasserstein_query(spark, sf):
    return drift.distribution_distances(drift.with_running_counts(histogram(spark, sf))).select("feature", rounded("wasserstein"))


def value_ks_query(spark, sf):
    events = table(spark, sf, "events").select("value", F.col("event_type").alias("cohort"))
    out = drift.ks_statistic(events, "value", "click", "purchase")
    return out.select("feature", rounded("ks_statistic"), rounded("wasserstein"))


def permutation_query(spark, sf):
    return drift.permutation_ks(histogram(spark, sf)).select("feature", rounded("statistic"), rounded("p_value"))


def homogeneity_query(spark, sf):
    return drift.pearson_homogeneity(labels(spark, sf)).withColumn("pearson_statistic", rounded("pearson_statistic"))


def permutation_homogeneity_query(spark, sf):
    return drift.permutation_homogeneity(labels(spark, sf)).select("feature", rounded("statistic"), rounded("p_value"))


def variation_query(spark, sf):
    return drift.total_variation(labels(spark, sf)).withColumn("total_variation", rounded("total_variation"))


def jensen_query(spark, sf):
    return drift.jensen_shannon(labels(spark, sf)).withColumn("jensen_shannon", rounded("jensen_shannon"))


def holm_query(spark, sf):
    tests = table(spark, sf, "documents").groupBy(F.col("source").alias("feature")).agg(
        F.round(1 / (F.count(F.lit(1)) * F.count(F.lit(1))), 6).alias("p_value"),
        F.round(F.count_if(F.col("lang") == "en") / F.count(F.lit(1)), 6).alias("effect_size"),
    ).withColumn("practical_threshold", F.lit(0.6))
    return drift.holm_adjust(tests).withColumn("adjusted_p_value", rounded("adjusted_p_value"))


def distances_query(spark, sf):
    rows = featured(spark, sf).withColumn("cluster_id", F.col("doc_id") % 7)
    return drift.report_distances(rows, REFERENCE, PRODUCTION, label="cluster_id").withColumn("distance", rounded("distance"))


def report(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("cohort"), (F.col("doc_id") % 7).alias("cluster_id"))
    return drift.drift_report(rows, REFERENCE, PRODUCTION, "doc_id", label="cluster_id", n_clusters=7)


def report_query(spark, sf):
    """The parts that do not depend on the random generator."""
    return report(spark, sf).select(
        "feature", "test", "effect_name", rounded("statistic"), rounded("effect_size"), rounded("wasserstein_raw_units"),
        "reference_rows", "production_rows", "practically_important",
        F.col("reference.count").alias("reference_count"), rounded("production.median", "production_median"),
        rounded("reference.p95", "reference_p95"),
    )


def report_p_query(spark, sf):
    return report(spark, sf).select("feature", rounded("p_value"), rounded("adjusted_p_value"), "statistically_significant")


def cluster_query(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("cohort"), (F.col("doc_id") % 7).cast("int").alias("cluster_id"))
    out = drift.cluster_drift(rows, REFERENCE, PRODUCTION, 8)
    return out.withColumns({c: rounded(F.col(c)) for c in ("reference_proportion", "production_proportion", "proportion_delta")})


QUERIES = {
    "describe_drift": describe_query,
    "ks_statistic": ks_query,
    "wasserstein_distance": wasserstein_query,
    "ks_of_values": value_ks_query,
    "permutation_ks": permutation_query,
    "pearson_homogeneity": homogeneity_query,
    "permutation_homogeneity": permutation_homogeneity_query,
    "total_variation": variation_query,
    "jensen_shannon": jensen_query,
    "holm_adjust": holm_query,
    "report_distances": distances_query,
    "drift_report": report_query,
    "drift_report_p_values": report_p_query,
    "cluster_drift": cluster_query,
}

STACKED = f"""
stacked AS (
  SELECT lang AS cohort, 'character_length' AS feature, CAST(length({CLEAN}) AS DOUBLE) AS value FROM documents
  UNION ALL SELECT lang, 'word_count', CAST({sql_words(CLEAN)} AS DOUBLE) FROM documents
)"""


def running_sql(source: str, reference: str, production: str) -> str:
    return f"""
        hist AS (SELECT feature, value, count(*) FILTER (WHERE cohort = '{reference}') AS a, count(*) FILTER (WHERE cohort = '{production}') AS b
          FROM {source} WHERE cohort IN ('{reference}', '{production}') GROUP BY 1, 2),
        cum AS (SELECT feature, value, lead(value) OVER w AS following, sum(a) OVER w / CAST(sum(a) OVER t AS DOUBLE) AS fa, sum(b) OVER w / CAST(sum(b) OVER t AS DOUBLE) AS fb,
          sum(a) OVER t AS na, sum(b) OVER t AS nb FROM hist WINDOW w AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature)),
        distances AS (SELECT feature, CAST(max(na) AS BIGINT) AS reference_rows, CAST(max(nb) AS BIGINT) AS production_rows, max(abs(fa - fb)) AS ks,
          coalesce(sum(abs(fa - fb) * (following - value)), 0) AS w FROM cum GROUP BY feature)"""


LABELS = f"""
counts AS (
  SELECT label, CAST(count(*) FILTER (WHERE cohort = 'training') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE cohort = 'production') AS DOUBLE) AS b
  FROM (SELECT label, {sql_cohort('vec_id')} AS cohort FROM embeddings) WHERE cohort IN ('training', 'production') GROUP BY label
),
shares AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM counts)"""
MOD_SHARES = """
counts AS (
  SELECT doc_id % 7 AS label, CAST(count(*) FILTER (WHERE lang = 'en') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE lang = 'fr') AS DOUBLE) AS b
  FROM documents WHERE lang IN ('en', 'fr') GROUP BY 1
),
shares AS (SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM counts)"""
PEARSON_SQL = """sum(pow(a - (a + b) * na / (na + nb), 2) / ((a + b) * na / (na + nb)) + pow(b - (a + b) * nb / (na + nb), 2) / ((a + b) * nb / (na + nb)))"""
JS_SQL = """sqrt(greatest(0, sum(CASE WHEN a > 0 THEN a / na * log2((a / na) / ((a / na + b / nb) / 2)) ELSE 0 END
  + CASE WHEN b > 0 THEN b / nb * log2((b / nb) / ((a / na + b / nb) / 2)) ELSE 0 END) / 2))"""


def figures(column: str) -> str:
    return ", ".join([
        f"{sql_round(f'avg({column})')} AS mean", f"{sql_round(f'stddev_pop({column})')} AS std_population", f"{sql_round(f'min({column})')} AS min",
        *(f"{sql_round(f'quantile_cont({column}, {q})')} AS {n}" for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"))),
        f"{sql_round(f'max({column})')} AS max",
    ])


ORACLES = {
    "describe_drift": f"WITH {STACKED} SELECT feature, cohort, count(*) AS count, {figures('value')} FROM stacked GROUP BY feature, cohort",
    "ks_statistic": f"""
        WITH {STACKED}, {running_sql('stacked', 'en', 'fr')}
        SELECT feature, reference_rows, production_rows, round(ks, 6) + 0.0 AS ks_statistic FROM distances""",
    "wasserstein_distance": f"WITH {STACKED}, {running_sql('stacked', 'en', 'fr')} SELECT feature, round(w, 6) + 0.0 AS wasserstein FROM distances",
    "ks_of_values": f"""
        WITH v AS (SELECT event_type AS cohort, 'value' AS feature, value FROM events), {running_sql('v', 'click', 'purchase')}
        SELECT feature, round(ks, 6) + 0.0 AS ks_statistic, round(w, 6) + 0.0 AS wasserstein FROM distances""",
    "pearson_homogeneity": f"WITH {LABELS} SELECT 'cluster_id' AS feature, round({PEARSON_SQL}, 6) + 0.0 AS pearson_statistic FROM shares",
    "total_variation": f"WITH {LABELS} SELECT 'cluster_id' AS feature, round(sum(abs(a / na - b / nb)) / 2, 6) + 0.0 AS total_variation FROM shares",
    "jensen_shannon": f"WITH {LABELS} SELECT 'cluster_id' AS feature, round({JS_SQL}, 6) + 0.0 AS jensen_shannon FROM shares",
    "holm_adjust": """
        WITH t AS (SELECT source AS feature, round(1 / CAST(count(*) * count(*) AS DOUBLE), 6) AS p_value,
          round(count(*) FILTER (WHERE lang = 'en') / CAST(count(*) AS DOUBLE), 6) AS effect_size FROM documents GROUP BY source),
        s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, feature) + 1) * p_value AS step FROM t),
        h AS (SELECT feature, p_value, effect_size, least(1.0, max(step) OVER (ORDER BY p_value, feature)) AS adj FROM s)
        SELECT feature, p_value, effect_size, CAST(0.6 AS DOUBLE) AS practical_threshold, round(adj, 6) + 0.0 AS adjusted_p_value,
          adj < 0.05 AS statistically_significant, effect_size >= 0.6 AS practically_important FROM h""",
    "report_distances": f"""
        WITH {STACKED}, {running_sql('stacked', 'en', 'fr')}, {MOD_SHARES},
        spread AS (SELECT feature, stddev_pop(value) AS sd FROM stacked WHERE cohort = 'en' GROUP BY feature),
        d AS (SELECT d.feature, 'wasserstein' AS method, w / greatest(sd, 0.001) AS x FROM distances d JOIN spread s ON s.feature = d.feature
          UNION ALL SELECT 'cluster_id', 'jensenshannon', (SELECT {JS_SQL} FROM shares))
        SELECT feature, method, round(x, 6) + 0.0 AS distance, x >= 0.1 AS drifted FROM d""",
    "drift_report": f"""
        WITH {STACKED}, {running_sql('stacked', 'en', 'fr')}, {MOD_SHARES},
        q AS (SELECT feature, quantile_cont(value, 0.5) FILTER (WHERE cohort = 'fr') AS pm, quantile_cont(value, 0.95) FILTER (WHERE cohort = 'en') AS rp FROM stacked GROUP BY feature)
        SELECT d.feature, 'permutation_two_sample_KS' AS test, 'KS_D' AS effect_name, round(ks, 6) + 0.0 AS statistic, round(ks, 6) + 0.0 AS effect_size,
          round(w, 6) + 0.0 AS wasserstein_raw_units, reference_rows, production_rows, ks >= 0.1 AS practically_important, reference_rows AS reference_count,
          round(pm, 6) + 0.0 AS production_median, round(rp, 6) + 0.0 AS reference_p95 FROM distances d JOIN q ON q.feature = d.feature
        UNION ALL SELECT 'cluster_id', 'permutation_Pearson_homogeneity', 'total_variation', (SELECT round({PEARSON_SQL}, 6) + 0.0 FROM shares),
          (SELECT round(sum(abs(a / na - b / nb)) / 2, 6) + 0.0 FROM shares), NULL, (SELECT CAST(sum(a) AS BIGINT) FROM shares), (SELECT CAST(sum(b) AS BIGINT) FROM shares),
          (SELECT sum(abs(a / na - b / nb)) / 2 >= 0.1 FROM shares), NULL, NULL, NULL""",
    "cluster_drift": """
        WITH k AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS cluster_id),
        c AS (SELECT cluster_id, count(*) FILTER (WHERE lang = 'en') AS r, count(*) FILTER (WHERE lang = 'fr') AS p FROM k LEFT JOIN documents ON doc_id % 7 = cluster_id GROUP BY 1),
        s AS (SELECT *, r / CAST(sum(r) OVER () AS DOUBLE) AS rp, p / CAST(sum(p) OVER () AS DOUBLE) AS pp FROM c)
        SELECT cluster_id, r AS reference_count, p AS production_count, round(rp, 6) + 0.0 AS reference_proportion, round(pp, 6) + 0.0 AS production_proportion,
          round(pp - rp, 6) + 0.0 AS proportion_delta FROM s""",
}
