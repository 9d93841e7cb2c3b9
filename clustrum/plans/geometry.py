"""Queries of the geometry operators. Label means of `embeddings` serve as the frozen centroids."""
from __future__ import annotations

from pyspark.sql import functions as F

from clustrum.operators import geometry as g
from clustrum.operators.models import silhouette_squared_euclidean
from clustrum.plans.common import (
    N_CLUSTERS, SQL_CENTROIDS, SQL_SUMS, cohort_column, labelled_embeddings, noisy_labels, rounded, sql_cohort, sql_round, table,
)

FIGURES = ("mean", "std_population", "min", "p05", "median", "p95", "max")


def centroids(spark, sf):
    return g.centroids_of(labelled_embeddings(spark, sf))


def plain(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def geometry(spark, sf):
    return g.assignment_geometry(plain(spark, sf), centroids(spark, sf))


def centroid_query(spark, sf):
    return centroids(spark, sf).select("cluster_id", F.posexplode("centroid").alias("dim", "value")).select("cluster_id", "dim", rounded("value"))


def product_query(spark, sf):
    return g.vector_centroid_product(plain(spark, sf), centroids(spark, sf), "vec_id").withColumn("similarity", rounded("similarity"))


def assign_query(spark, sf):
    return g.assign_clusters(plain(spark, sf), centroids(spark, sf)).select("vec_id", "cluster_id")


def geometry_query(spark, sf):
    return geometry(spark, sf).select(
        "vec_id", "cluster_id", rounded("assigned_centroid_cosine_similarity", "similarity"),
        rounded("assigned_centroid_cosine_distance", "distance"), rounded("assignment_margin", "margin"),
    )


def checked_query(spark, sf):
    model = centroids(spark, sf)
    labelled = g.assign_clusters(plain(spark, sf), model)
    return g.check_geometry(labelled, model).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def describe_query(spark, sf):
    out = g.describe_geometry(geometry(spark, sf), "assignment_margin", N_CLUSTERS + 2)
    return out.select("cluster_id", "status", "count", *(rounded(c) for c in FIGURES))


def cluster_query(spark, sf):
    out = g.cluster_geometry(geometry(spark, sf), N_CLUSTERS)
    return out.select("measure", "cluster_id", "count", rounded("proportion"), *(rounded(c) for c in FIGURES))


def summary_query(spark, sf):
    out = g.geometry_summary(geometry(spark, sf))
    return out.select("measure", "count", *(rounded(c) for c in FIGURES))


def separation_query(spark, sf):
    return g.centroid_separation(centroids(spark, sf)).withColumn("cosine_distance", rounded("cosine_distance"))


def separation_summary_query(spark, sf):
    out = g.separation_summary(centroids(spark, sf))
    return out.select("count", *(rounded(c) for c in FIGURES))


def counts_query(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("cluster_id"), cohort_column("vec_id").alias("cohort"))
    out = g.cluster_counts(rows, N_CLUSTERS + 1, ("training", "production"))
    return out.withColumns({c: rounded(F.col(c)) for c in ("reference_proportion", "production_proportion", "proportion_delta")})


def partition_query(spark, sf):
    out = g.partition_summary(noisy_labels(spark, sf))
    return out.withColumns({c: rounded(F.col(c)) for c in ("coverage", "noise_ratio", "largest_cluster_ratio")})


def balance_query(spark, sf):
    out = g.population_balance(labelled_embeddings(spark, sf), N_CLUSTERS + 2)
    return out.withColumns({c: rounded(F.col(c)) for c in ("largest_cluster_proportion", "largest_to_smallest_ratio")})


def silhouette_query(spark, sf):
    return g.silhouette_cosine(noisy_labels(spark, sf)).withColumn("silhouette_cosine", rounded("silhouette_cosine"))


def squared_query(spark, sf):
    return silhouette_squared_euclidean(noisy_labels(spark, sf), "embedding").select(rounded("silhouette_squared_euclidean"))


def davies_query(spark, sf):
    return g.davies_bouldin(noisy_labels(spark, sf)).select(rounded("davies_bouldin"))


def inertia_query(spark, sf):
    return g.inertia(plain(spark, sf), centroids(spark, sf)).select(rounded("inertia"))


def kmeans_inertia_query(spark, sf):
    return g.kmeans_inertia(labelled_embeddings(spark, sf)).select(rounded("inertia"))


def box_query(spark, sf):
    out = g.box_summary(geometry(spark, sf), "assigned_centroid_cosine_similarity", ["cluster_id"])
    return out.select("cluster_id", "count", *(rounded(c) for c in ("min", "p25", "median", "p75", "max")))


def evaluate_query(spark, sf):
    out = g.evaluate_clustering(noisy_labels(spark, sf))
    doubles = ("coverage", "noise_ratio", "largest_cluster_ratio", "davies_bouldin", "silhouette_cosine")
    return out.withColumns({c: rounded(F.col(c)) for c in doubles})


def held_out_query(spark, sf):
    out = g.held_out_silhouette(labelled_embeddings(spark, sf), "vec_id", sample_size=200)
    return out.select(rounded("silhouette_cosine"), "silhouette_n_samples", "fingerprint", "undefined_reason")


def sampled_query(spark, sf):
    out = g.evaluate_clustering(noisy_labels(spark, sf), id_column="vec_id", sample_size=150)
    return out.select("n_samples", "n_clusters", rounded("davies_bouldin"), rounded("silhouette_cosine"), "silhouette_n_samples")


QUERIES = {
    "held_out_silhouette": held_out_query,
    "evaluate_clustering_sampled": sampled_query,
    "centroids_of": centroid_query,
    "vector_centroid_product": product_query,
    "assign_clusters": assign_query,
    "assignment_geometry": geometry_query,
    "check_geometry": checked_query,
    "describe_geometry": describe_query,
    "cluster_geometry": cluster_query,
    "geometry_summary": summary_query,
    "centroid_separation": separation_query,
    "separation_summary": separation_summary_query,
    "cluster_counts": counts_query,
    "partition_summary": partition_query,
    "population_balance": balance_query,
    "silhouette_cosine": silhouette_query,
    "silhouette_squared_euclidean": squared_query,
    "davies_bouldin": davies_query,
    "spherical_inertia": inertia_query,
    "kmeans_inertia": kmeans_inertia_query,
    "box_summary": box_query,
    "evaluate_clustering": evaluate_query,
}


def sql_figures(column: str) -> str:
    quantiles = ((0.05, "p05"), (0.5, "median"), (0.95, "p95"))
    return ", ".join([
        f"{sql_round(f'avg({column})')} AS mean", f"{sql_round(f'stddev_pop({column})')} AS std_population",
        f"{sql_round(f'min({column})')} AS min",
        *(f"{sql_round(f'quantile_cont({column}, {q})')} AS {n}" for q, n in quantiles),
        f"{sql_round(f'max({column})')} AS max",
    ])


MEASURES = """
stacked AS (
  SELECT 'assigned_similarity' AS measure, cluster_id, similarity AS v FROM geometry
  UNION ALL SELECT 'dispersion', cluster_id, distance FROM geometry UNION ALL SELECT 'margin', cluster_id, margin FROM geometry
)"""
SEPARATION = """
gaps AS (
  SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b,
    least(2.0, greatest(0.0, 1 - list_dot_product(a.centroid, b.centroid))) AS d FROM centroids a, centroids b
)"""
NOISY = """
rows_ AS (SELECT vec_id, label - 1 AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label >= 1),
means AS (
  SELECT label, any_value(n) AS n, list(s ORDER BY i) AS s, list(s / n ORDER BY i) AS mean
  FROM (SELECT label - 1 AS label, i, sum(CAST(embedding[i] AS DOUBLE)) AS s, count(*) AS n FROM embeddings, range(1, 65) t(i) WHERE label >= 1 GROUP BY 1, 2)
  GROUP BY label
)"""
PAIR_DISTANCE = """
dist AS (
  SELECT a.vec_id, a.label, b.label AS other, sum({d}) AS total, count(*) AS n
  FROM rows_ a, rows_ b WHERE a.vec_id <> b.vec_id GROUP BY 1, 2, 3
),
score AS (
  SELECT vec_id, max(total / n) FILTER (WHERE other = label) AS a, min(total / n) FILTER (WHERE other <> label) AS b FROM dist GROUP BY vec_id
)"""
COSINE = PAIR_DISTANCE.format(d="1 - list_dot_product(a.v, b.v)")
SQUARED = PAIR_DISTANCE.format(d="list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v)")
MEAN_SCORE = "avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)"
DAVIES = """
spread AS (SELECT r.label, avg(list_distance(r.v, m.mean)) AS s FROM rows_ r JOIN means m ON m.label = r.label GROUP BY r.label),
worst AS (
  SELECT a.label, max((sa.s + sb.s) / list_distance(a.mean, b.mean)) AS w FROM means a JOIN means b ON a.label <> b.label
  JOIN spread sa ON sa.label = a.label JOIN spread sb ON sb.label = b.label GROUP BY a.label
)"""
PARTITION = """
  count(*) AS n_samples, count(DISTINCT label) FILTER (WHERE label >= 1) AS n_clusters,
  round(avg(CASE WHEN label >= 1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS coverage,
  round(1 - avg(CASE WHEN label >= 1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS noise_ratio,
  (SELECT round(max(n) / CAST(sum(n) AS DOUBLE), 6) + 0.0 FROM (SELECT count(*) AS n FROM embeddings WHERE label >= 1 GROUP BY label)) AS largest_cluster_ratio"""

SAMPLE_SCORE = PAIR_DISTANCE.format(d="1 - list_dot_product(a.v, b.v)")
ORACLES = {
    "held_out_silhouette": f"""
        WITH rows_ AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY sha256('42|' || vec_id) LIMIT 200), {SAMPLE_SCORE},
        h AS (SELECT sha256('{{"vec_id":' || vec_id || '}}') AS x FROM rows_),
        l AS (SELECT i, CAST('0x' || substr(x, 1 + 8 * i, 8) AS UBIGINT) AS v FROM h, range(8) t(i)),
        s AS (SELECT i, CAST(sum(CAST(v AS HUGEINT)) AS VARCHAR) AS total, CAST(bit_xor(v) AS VARCHAR) AS mixed, count(*) AS n FROM l GROUP BY 1)
        SELECT (SELECT round({MEAN_SCORE}, 6) + 0.0 FROM score) AS silhouette_cosine, max(n) AS silhouette_n_samples,
          sha256(max(n) || ':' || string_agg(total, '-' ORDER BY i) || ':' || string_agg(mixed, '-' ORDER BY i)) AS fingerprint,
          CAST(NULL AS VARCHAR) AS undefined_reason FROM s""",
    "evaluate_clustering_sampled": f"""
        WITH {NOISY.replace('rows_ AS', 'every AS')}, rows_ AS (SELECT * FROM every ORDER BY sha256('42|' || vec_id) LIMIT 150), {SAMPLE_SCORE},
        {DAVIES.replace('rows_ r', 'every r')}
        SELECT (SELECT count(*) FROM embeddings) AS n_samples, (SELECT count(*) FROM means) AS n_clusters, (SELECT round(avg(w), 6) + 0.0 FROM worst) AS davies_bouldin,
          round({MEAN_SCORE}, 6) + 0.0 AS silhouette_cosine, count(*) AS silhouette_n_samples FROM score""",
    "centroids_of": f"""
        WITH {SQL_SUMS}
        SELECT cluster_id, CAST(i - 1 AS INTEGER) AS dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY cluster_id)), 6) + 0.0 AS value FROM sums""",
    "vector_centroid_product": f"WITH {SQL_CENTROIDS} SELECT vec_id, cluster_id, round(similarity, 6) + 0.0 AS similarity FROM products",
    "assign_clusters": f"WITH {SQL_CENTROIDS} SELECT vec_id, cluster_id FROM geometry",
    "assignment_geometry": f"""
        WITH {SQL_CENTROIDS} SELECT vec_id, cluster_id, round(similarity, 6) + 0.0 AS similarity, round(distance, 6) + 0.0 AS distance,
          round(margin, 6) + 0.0 AS margin FROM geometry""",
    "check_geometry": f"WITH {SQL_CENTROIDS} SELECT cluster_id, count(*) AS n FROM geometry GROUP BY cluster_id",
    "describe_geometry": f"""
        WITH {SQL_CENTROIDS}, k AS (SELECT CAST(unnest(range(12)) AS INTEGER) AS cluster_id)
        SELECT k.cluster_id, CASE WHEN count(margin) = 0 THEN 'unavailable' ELSE 'available' END AS status, count(margin) AS count, {sql_figures('margin')}
        FROM k LEFT JOIN geometry ON geometry.cluster_id = k.cluster_id GROUP BY k.cluster_id""",
    "cluster_geometry": f"""
        WITH {SQL_CENTROIDS}, {MEASURES}, k AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS cluster_id),
        every AS (SELECT cluster_id, measure FROM k, (SELECT DISTINCT measure FROM stacked))
        SELECT e.measure, e.cluster_id, count(v) AS count, round(count(v) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE), 6) + 0.0 AS proportion, {sql_figures('v')}
        FROM every e LEFT JOIN stacked s ON s.measure = e.measure AND s.cluster_id = e.cluster_id GROUP BY e.measure, e.cluster_id""",
    "geometry_summary": f"WITH {SQL_CENTROIDS}, {MEASURES} SELECT measure, count(*) AS count, {sql_figures('v')} FROM stacked GROUP BY measure",
    "centroid_separation": f"WITH {SQL_CENTROIDS}, {SEPARATION} SELECT cluster_a, cluster_b, round(d, 6) + 0.0 AS cosine_distance FROM gaps",
    "separation_summary": f"WITH {SQL_CENTROIDS}, {SEPARATION} SELECT count(*) AS count, {sql_figures('d')} FROM gaps WHERE cluster_a < cluster_b",
    "cluster_counts": f"""
        WITH e AS (SELECT label, {sql_cohort('vec_id')} AS cohort FROM embeddings), k AS (SELECT CAST(unnest(range(11)) AS INTEGER) AS cluster_id),
        c AS (SELECT cluster_id, count(*) FILTER (WHERE cohort = 'training') AS r, count(*) FILTER (WHERE cohort = 'production') AS p FROM k LEFT JOIN e ON label = cluster_id GROUP BY 1),
        s AS (SELECT *, r / CAST(sum(r) OVER () AS DOUBLE) AS rp, p / CAST(sum(p) OVER () AS DOUBLE) AS pp FROM c)
        SELECT cluster_id, r AS reference_count, p AS production_count, round(rp, 6) + 0.0 AS reference_proportion, round(pp, 6) + 0.0 AS production_proportion,
          round(pp - rp, 6) + 0.0 AS proportion_delta FROM s""",
    "partition_summary": f"SELECT {PARTITION} FROM embeddings",
    "population_balance": """
        WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
        SELECT count(*) AS represented_clusters, (SELECT string_agg(i, ',' ORDER BY i) FROM range(12) t(i) WHERE i NOT IN (SELECT label FROM c)) AS empty_cluster_ids,
          round(max(n) / CAST(sum(n) AS DOUBLE), 6) + 0.0 AS largest_cluster_proportion, round(max(n) / CAST(min(n) AS DOUBLE), 6) + 0.0 AS largest_to_smallest_ratio FROM c""",
    "silhouette_cosine": f"WITH {NOISY}, {COSINE} SELECT round({MEAN_SCORE}, 6) + 0.0 AS silhouette_cosine, count(*) AS silhouette_n_samples FROM score",
    "silhouette_squared_euclidean": f"WITH {NOISY}, {SQUARED} SELECT round({MEAN_SCORE}, 6) + 0.0 AS silhouette_squared_euclidean FROM score",
    "davies_bouldin": f"WITH {NOISY}, {DAVIES} SELECT round(avg(w), 6) + 0.0 AS davies_bouldin FROM worst",
    "spherical_inertia": f"WITH {SQL_CENTROIDS} SELECT round(sum(1 - similarity), 6) + 0.0 AS inertia FROM geometry",
    "kmeans_inertia": f"""
        WITH {SQL_SUMS}, m AS (SELECT cluster_id, list(s / n ORDER BY i) AS mean FROM sums GROUP BY cluster_id)
        SELECT round(sum(pow(list_distance(CAST(embedding AS DOUBLE[]), mean), 2)), 6) + 0.0 AS inertia FROM embeddings JOIN m ON label = cluster_id""",
    "box_summary": f"""
        WITH {SQL_CENTROIDS}
        SELECT cluster_id, count(*) AS count, round(min(similarity), 6) + 0.0 AS min, round(quantile_cont(similarity, 0.25), 6) + 0.0 AS p25,
          round(quantile_cont(similarity, 0.5), 6) + 0.0 AS median, round(quantile_cont(similarity, 0.75), 6) + 0.0 AS p75, round(max(similarity), 6) + 0.0 AS max
        FROM geometry GROUP BY cluster_id""",
    "evaluate_clustering": f"""
        WITH {NOISY}, {COSINE}, {DAVIES}
        SELECT {PARTITION}, (SELECT round(avg(w), 6) + 0.0 FROM worst) AS davies_bouldin,
          (SELECT round({MEAN_SCORE}, 6) + 0.0 FROM score) AS silhouette_cosine, (SELECT count(*) FROM score) AS silhouette_n_samples FROM embeddings""",
}
