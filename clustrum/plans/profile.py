"""Queries of the exploration operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from clustrum.operators import drift, keywords, profile
from clustrum.functions.text import FRENCH_STOP_WORDS, stop_tokens
from clustrum.plans.cleaning import WORDS_SQL
from clustrum.plans.common import rounded, sql_clean, sql_round, table

CLEAN = sql_clean()


def rated(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def nulls_query(spark, sf):
    return profile.null_profile(rated(spark, sf), ["text", "quality", "toxic"]).withColumn("null_percent", rounded("null_percent"))


def distribution_query(spark, sf):
    return profile.value_distribution(table(spark, sf, "documents"), "lang").withColumn("share", rounded("share"))


def month_query(spark, sf):
    months = table(spark, sf, "orders").select(F.month("o_orderdate").alias("month"))
    return profile.value_distribution(months, "month").withColumn("share", rounded("share"))


def numeric_query(spark, sf):
    out = profile.numeric_profile(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("column_name", "count", *(rounded(c) for c in ("mean", "std", "min", "p25", "median", "p75", "max")))


def histogram_query(spark, sf):
    return profile.histogram(table(spark, sf, "documents"), "n_chars", bins=40)


def median_query(spark, sf):
    return profile.median_by_group(rated(spark, sf), "quality", "n_chars")


def pearson_query(spark, sf):
    out = profile.pearson_correlation(rated(spark, sf), "n_chars", "quality")
    return out.select("n", rounded("r"), rounded("t_statistic"))


def matrix_query(spark, sf):
    out = profile.correlation_matrix(rated(spark, sf).filter(F.col("quality").isNotNull()), ["n_chars", "quality"])
    return out.withColumn("r", rounded("r"))


def kendall_query(spark, sf):
    out = profile.kendall_correlation(rated(spark, sf), "n_chars", "quality")
    return out.select("n", "concordant", "discordant", rounded("tau_b"))


def kendall_many_query(spark, sf):
    orders = table(spark, sf, "events").select(F.hour("ts").alias("hour"), F.floor("value").alias("v"))
    out = profile.kendall_correlation(orders, "v", "hour")
    return out.select("n", "concordant", "discordant", rounded("tau_b"))


def normality_query(spark, sf):
    out = profile.normality_summary(table(spark, sf, "documents"), "n_chars")
    return out.select("n", rounded("skewness"), rounded("kurtosis"), rounded("jarque_bera", places=4))


def undefined_query(spark, sf):
    """Correlations that have no t: perfect ones, with a constant, and of no rows."""
    rows = table(spark, sf, "documents").select("n_chars", (-F.col("n_chars")).alias("minus"), F.lit(1).alias("one"))
    cases = [("perfect", rows, "n_chars"), ("reversed", rows, "minus"), ("constant", rows, "one"), ("empty", rows.filter("n_chars < 0"), "n_chars")]
    out = [
        profile.pearson_correlation(frame, "n_chars", other).select(F.lit(name).alias("case_name"), rounded("r"), "t_statistic", "p_value")
        for name, frame, other in cases
    ]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def undefined_kendall_query(spark, sf):
    rows = table(spark, sf, "documents").withColumn("one", F.lit(1))
    return profile.kendall_correlation(rows, "n_chars", "one").select("n", "tau_b", "p_value")


def undefined_distances_query(spark, sf):
    """Distances to a cohort without rows."""
    rows = table(spark, sf, "documents").withColumn("cohort", F.lit("reference"))
    counted = drift.pooled_histogram(drift.stack_features(rows, ["n_chars"]), "reference", "production")
    return drift.ks_statistic(rows, "n_chars", "reference", "production").join(
        drift.total_variation(counted), "feature").join(drift.jensen_shannon(counted), "feature")


def missing_column_query(spark, sf):
    rows = table(spark, sf, "documents").withColumn("missing", F.lit(None).cast("double"))
    return profile.numeric_profile(rows, ["n_chars", "missing"]).select("column_name", "count", rounded("mean"))


def null_group_query(spark, sf):
    rows = table(spark, sf, "documents").withColumn("lang", F.when(F.col("lang") != "en", F.col("lang")))
    return profile.ecdf(rows, "n_chars", ["lang"]).withColumn("cumulative_share", rounded("cumulative_share"))


def qq_query(spark, sf):
    out = profile.qq_points(table(spark, sf, "documents"), "n_chars")
    return out.select(*(rounded(c) for c in ("fraction", "normal_quantile", "observed", "fitted")))


def qq_observed_query(spark, sf):
    return profile.qq_points(table(spark, sf, "documents"), "n_chars").select(rounded("fraction"), rounded("observed"))


def ecdf_query(spark, sf):
    return profile.ecdf(table(spark, sf, "documents"), "n_chars", ["lang"]).withColumn("cumulative_share", rounded("cumulative_share"))


def top_query(spark, sf):
    return profile.top_shares(table(spark, sf, "documents"), "source", 5).withColumn("share", rounded("share"))


def keyword_query(spark, sf):
    clustered = table(spark, sf, "documents").withColumn("cluster_id", (F.substring("source", 4, 3).cast("int") - 1))
    return keywords.ctfidf_keywords(clustered).withColumn("score_ctfidf", rounded("score_ctfidf"))


def frequency_query(spark, sf):
    return keywords.term_frequency(table(spark, sf, "documents"))


def worst_rating_query(spark, sf):
    bad = table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 0"), "doc_id")
    return keywords.term_frequency(bad, top_n=50)


def top_terms_query(spark, sf):
    scored = table(spark, sf, "documents").groupBy(F.col("lang").alias("cluster"), F.col("source").alias("term")).agg(
        F.count(F.lit(1)).cast("double").alias("score_ctfidf"))
    return keywords.top_terms(scored, 3)


QUERIES = {
    "top_terms": top_terms_query,
    "null_profile": nulls_query,
    "value_distribution": distribution_query,
    "month_distribution": month_query,
    "numeric_profile": numeric_query,
    "histogram": histogram_query,
    "median_by_group": median_query,
    "pearson_correlation": pearson_query,
    "correlation_matrix": matrix_query,
    "kendall_correlation": kendall_query,
    "kendall_many_values": kendall_many_query,
    "normality_summary": normality_query,
    "undefined_profile": undefined_query,
    "undefined_kendall": undefined_kendall_query,
    "undefined_distances": undefined_distances_query,
    "numeric_profile_with_nulls": missing_column_query,
    "ecdf_null_group": null_group_query,
    "qq_points": qq_query,
    "qq_observed": qq_observed_query,
    "ecdf": ecdf_query,
    "top_shares": top_query,
    "ctfidf_keywords": keyword_query,
    "term_frequency": frequency_query,
    "term_frequency_by_rating": worst_rating_query,
}


def kendall_sql(cells: str) -> str:
    return f"""
        WITH cells AS ({cells}),
        pairs AS (
          SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN CAST(a.n AS DOUBLE) * b.n END) / 2 AS c,
            sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN CAST(a.n AS DOUBLE) * b.n END) / 2 AS d FROM cells a, cells b),
        tx AS (SELECT sum(t * (t - 1) / 2) AS v FROM (SELECT CAST(sum(n) AS DOUBLE) AS t FROM cells GROUP BY x)),
        ty AS (SELECT sum(t * (t - 1) / 2) AS v FROM (SELECT CAST(sum(n) AS DOUBLE) AS t FROM cells GROUP BY y)),
        total AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM cells)
        SELECT CAST(total.n AS BIGINT) AS n, CAST(c AS BIGINT) AS concordant, CAST(d AS BIGINT) AS discordant,
          round((c - d) / sqrt(total.n * (total.n - 1) / 2 - tx.v) / sqrt(total.n * (total.n - 1) / 2 - ty.v), 6) + 0.0 AS tau_b
        FROM pairs, tx, ty, total"""


def quartiles(column: str) -> str:
    parts = ", ".join(
        f"{sql_round(f'quantile_cont(CAST({column} AS DOUBLE), {q})')} AS {n}" for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))
    )
    return (
        f"SELECT '{column}' AS column_name, count({column}) AS count, {sql_round(f'avg({column})')} AS mean, "
        f"{sql_round(f'stddev_samp({column})')} AS std, {sql_round(f'min({column})')} AS min, {parts}, "
        f"{sql_round(f'max({column})')} AS max FROM lineitem"
    )


CLOUD = sorted({*stop_tokens((*FRENCH_STOP_WORDS, *keywords.CLOUD_STOP_WORDS))})
CLOUD_SQL = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in CLOUD) + ")"


def frequency_sql(source: str, n: int) -> str:
    plain = f"regexp_replace(lower({CLEAN}), '(https?://|www\\.)[^ \\t\\r\\n]+|[^ \\t\\r\\n]+@[^ \\t\\r\\n]+', ' ', 'g')"
    return f"""
        WITH w AS (SELECT unnest(regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {source})
        SELECT term, count(*) AS n FROM w WHERE term NOT IN {CLOUD_SQL} AND regexp_full_match(term, '[\\p{{L}}]{{3,}}')
        GROUP BY term ORDER BY n DESC, term LIMIT {n}"""


ORACLES = {
    "top_terms": """
        SELECT lang AS cluster, CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS INTEGER) AS rank, source AS term,
          CAST(count(*) AS DOUBLE) AS score_ctfidf FROM documents GROUP BY lang, source QUALIFY rank <= 3""",
    "null_profile": """
        SELECT c AS column_name, nulls AS null_count, round(nulls * 100.0 / n, 6) + 0.0 AS null_percent
        FROM (SELECT count(*) AS n, count(*) - count(text) AS text, count(*) - count(quality) AS quality, count(*) - count(toxic) AS toxic
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) UNPIVOT (nulls FOR c IN (text, quality, toxic))""",
    "value_distribution": "SELECT lang AS value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) + 0.0 AS share FROM documents GROUP BY lang",
    "month_distribution": """
        SELECT CAST(month(o_orderdate) AS INTEGER) AS value, count(*) AS n,
          round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) + 0.0 AS share FROM orders GROUP BY 1""",
    "numeric_profile": " UNION ALL ".join(quartiles(c) for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "histogram": """
        WITH bins AS (SELECT CAST(unnest(range(40)) AS INTEGER) AS bin),
        edges AS (SELECT CAST(min(n_chars) AS DOUBLE) AS low, (CAST(max(n_chars) AS DOUBLE) - CAST(min(n_chars) AS DOUBLE)) / 40 AS width FROM documents),
        c AS (SELECT CAST(least(39, floor((n_chars - low) / width)) AS INTEGER) AS bin, count(*) AS n FROM documents, edges GROUP BY 1)
        SELECT bins.bin, low + bins.bin * width AS lower, low + (bins.bin + 1) * width AS upper, coalesce(n, 0) AS n
        FROM edges, bins LEFT JOIN c ON c.bin = bins.bin""",
    "qq_observed": f"""
        SELECT round(i / CAST(100 AS DOUBLE), 6) + 0.0 AS fraction, round(q, 6) + 0.0 AS observed FROM (
          SELECT unnest(range(1, 100)) AS i, unnest(quantile_cont(CAST(n_chars AS DOUBLE), [{", ".join(str(i / 100) for i in range(1, 100))}])) AS q FROM documents)""",
    "undefined_profile": """
        SELECT * FROM (VALUES ('perfect', CAST(1 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE)),
          ('reversed', CAST(-1 AS DOUBLE), NULL, CAST(0 AS DOUBLE)), ('constant', NULL, NULL, NULL), ('empty', NULL, NULL, NULL)) t(case_name, r, t_statistic, p_value)""",
    "undefined_kendall": "SELECT count(*) AS n, CAST(NULL AS DOUBLE) AS tau_b, CAST(NULL AS DOUBLE) AS p_value FROM documents",
    "undefined_distances": """
        SELECT 'n_chars' AS feature, count(*) AS reference_rows, CAST(0 AS BIGINT) AS production_rows, CAST(NULL AS DOUBLE) AS ks_statistic,
          CAST(NULL AS DOUBLE) AS wasserstein, CAST(NULL AS DOUBLE) AS total_variation, CAST(NULL AS DOUBLE) AS jensen_shannon FROM documents""",
    "numeric_profile_with_nulls": f"""
        SELECT 'n_chars' AS column_name, count(*) AS count, {sql_round('avg(n_chars)')} AS mean FROM documents
        UNION ALL SELECT 'missing', CAST(0 AS BIGINT), CAST(NULL AS DOUBLE)""",
    "ecdf_null_group": """
        WITH h AS (SELECT CASE WHEN lang <> 'en' THEN lang END AS lang, n_chars AS value, count(*) AS n FROM documents GROUP BY 1, 2)
        SELECT lang, value, n, CAST(sum(n) OVER w AS BIGINT) AS cum_n,
          round(sum(n) OVER w / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE), 6) + 0.0 AS cumulative_share
        FROM h WINDOW w AS (PARTITION BY lang ORDER BY value)""",
    "median_by_group": "SELECT quality, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS median FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY quality",
    "pearson_correlation": """
        SELECT n, round(r, 6) + 0.0 AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) + 0.0 AS t_statistic
        FROM (SELECT count(*) AS n, corr(quality, n_chars) AS r FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "correlation_matrix": """
        WITH c AS (SELECT corr(quality, n_chars) AS r FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
        SELECT x, y, CASE WHEN x = y THEN CAST(1 AS DOUBLE) ELSE round(r, 6) + 0.0 END AS r
        FROM c, (VALUES ('n_chars'), ('quality')) a(x), (VALUES ('n_chars'), ('quality')) b(y)""",
    "kendall_correlation": kendall_sql("SELECT n_chars AS x, quality AS y, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2"),
    "kendall_many_values": kendall_sql("SELECT CAST(floor(value) AS BIGINT) AS x, hour(ts) AS y, count(*) AS n FROM events GROUP BY 1, 2"),
    "normality_summary": """
        WITH m AS (SELECT avg(CAST(n_chars AS DOUBLE)) AS mu FROM documents),
        s AS (SELECT count(*) AS n, avg(pow(n_chars - mu, 2)) AS m2, avg(pow(n_chars - mu, 3)) AS m3, avg(pow(n_chars - mu, 4)) AS m4 FROM documents, m),
        t AS (SELECT n, m3 / pow(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku FROM s)
        SELECT n, round(sk, 6) + 0.0 AS skewness, round(ku, 6) + 0.0 AS kurtosis, round(n / CAST(6 AS DOUBLE) * (sk * sk + ku * ku / 4), 4) + 0.0 AS jarque_bera FROM t""",
    "ecdf": """
        WITH h AS (SELECT lang, n_chars AS value, count(*) AS n FROM documents GROUP BY 1, 2)
        SELECT lang, value, n, CAST(sum(n) OVER w AS BIGINT) AS cum_n,
          round(sum(n) OVER w / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE), 6) + 0.0 AS cumulative_share
        FROM h WINDOW w AS (PARTITION BY lang ORDER BY value)""",
    "top_shares": """
        SELECT value, n, round(n / CAST(total AS DOUBLE), 6) + 0.0 AS share, CAST(rank AS INTEGER) AS rank FROM (
          SELECT source AS value, count(*) AS n, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, source) AS rank
          FROM documents GROUP BY source) WHERE rank <= 5""",
    "ctfidf_keywords": f"""
        WITH words AS (SELECT CAST(substr(source, 4, 3) AS INTEGER) - 1 AS cluster, {WORDS_SQL} AS w FROM documents WHERE {CLEAN} <> ''),
        terms AS (SELECT cluster, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words WHERE cluster >= 0),
        tf AS (SELECT cluster, term, count(*) AS n FROM terms GROUP BY 1, 2),
        scored AS (SELECT cluster, term, n / CAST(sum(n) OVER (PARTITION BY cluster) AS DOUBLE)
            * ln(1 + (SELECT floor(avg(t)) FROM (SELECT CAST(sum(n) AS DOUBLE) AS t FROM tf GROUP BY cluster)) / CAST(sum(n) OVER (PARTITION BY term) AS DOUBLE)) AS s FROM tf),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, term) AS rank FROM scored)
        SELECT cluster, CAST(rank AS INTEGER) AS rank, term, round(s, 6) + 0.0 AS score_ctfidf FROM ranked WHERE rank <= 10""",
    "term_frequency": frequency_sql("documents", 100),
    "term_frequency_by_rating": frequency_sql("documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0", 50),
}
