"""Queries that encode, fit, freeze and sweep."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clustrum.operators import models
from clustrum.operators.geometry import assign_clusters, centroids_of, partition_summary
from clustrum.plans.common import SQL_CENTROIDS, labelled_embeddings, rounded, sql_clean, table
from clustrum.session import materialize, scratch_path

CLEAN = sql_clean()


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def encode_query(spark, sf):
    encoded = models.encode_texts(table(spark, sf, "documents").select("doc_id", "text"))
    return encoded.select("doc_id", F.posexplode("embedding").alias("dim", "value")).filter("value != 0").select(
        "doc_id", "dim", rounded(F.col("value").cast("double"), "value", 4))


def fit_query(method):
    def query(spark, sf):
        _, labelled, cost = models.fit_and_assign(vectors(spark, sf), method, n_clusters=10, n_init=3, max_iter=50)
        labelled = materialize(labelled, "fitted")
        return partition_summary(labelled).withColumn("inertia", rounded(F.lit(cost), "inertia"))
    query.__module__ = __name__
    return query


def fit_facts_query(method):
    """What has to hold for any start: all clusters are used, and the labels give the reported inertia."""
    def query(spark, sf):
        centroids, labelled, cost = models.fit_and_assign(vectors(spark, sf), method, n_clusters=10, n_init=2, max_iter=50)
        x, c = F.col("embedding").cast("array<double>"), F.col("centroid")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        if method == "kmeans":
            distance = dot(x, x) - 2 * dot(x, c) + dot(c, c)
        else:
            distance = 1 - F.try_divide(dot(x, c), F.sqrt(dot(x, x)) * F.sqrt(dot(c, c)))
        joined = labelled.join(F.broadcast(centroids), "cluster_id")
        return joined.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster_id").alias("clusters"), F.sum(distance).alias("sum")).select(
            "n", "clusters", (F.abs(F.col("sum") - cost) <= 1e-6 * cost).alias("inertia_matches"))
    query.__module__ = __name__
    return query


def from_means_query(method):
    """Three iterations from the label means, so that SQL can follow them: label of every row, and the inertia."""
    def query(spark, sf):
        start = centroids_of(labelled_embeddings(spark, sf))
        _, labelled, cost = models.fit_and_assign(vectors(spark, sf), method, max_iter=3, tol=0.0, initial=start)
        return labelled.select("vec_id", "cluster_id", rounded(F.lit(cost), "inertia"))
    query.__module__ = __name__
    return query


def repeated_rows_query(spark, sf):
    """Ten clusters of rows that hold three different vectors: ten centroids, inertia zero, the rows in three of them."""
    few = vectors(spark, sf).select("vec_id", F.transform(F.array(*map(F.lit, range(3))), lambda i: (F.col("vec_id") % 3 == i).cast("double") + 1).alias("embedding"))
    centroids, labelled, cost = models.fit_and_assign(few, "kmeans", n_clusters=10, n_init=2, max_iter=5)
    used = labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return used.select(F.dense_rank().over(Window.orderBy(F.desc("n"))).alias("place"), "n").crossJoin(
        centroids.agg(F.count(F.lit(1)).alias("centroids"))).withColumn("inertia", rounded(F.lit(cost), "inertia"))


def statistical_query(spark, sf):
    """Stability on draws of all rows: with the whole table drawn twice, equal seeds give equal partitions."""
    out = models.evaluate_stability(
        vectors(spark, sf), "vec_id", "kmeans", "statistical", n_repeats=2, sample_fraction=1.0, n_clusters=5, n_init=1, max_iter=15)
    return out.select("repeat_a", "repeat_b", rounded("ari"), "n_common", "method", "mode")


def variance_query(spark, sf):
    """All components keep the variance of the vectors."""
    reduced = models.reduce_dimensions(vectors(spark, sf), 64)
    spread = reduced.select(F.posexplode("reduced").alias("axis", "v")).groupBy("axis").agg(F.var_pop("v").alias("v"))
    return spread.agg(F.count(F.lit(1)).alias("axes"), rounded(F.sum("v"), "variance"))


def stability_query(spark, sf):
    return models.evaluate_stability(
        vectors(spark, sf), "vec_id", "spherical_kmeans", "global", n_repeats=2, n_clusters=5, n_init=1, max_iter=15)


def algorithmic_query(spark, sf):
    return models.evaluate_stability(
        vectors(spark, sf), "vec_id", "kmeans", "algorithmic", n_repeats=3, n_clusters=5, n_init=1, max_iter=15)


def sweep_query(spark, sf):
    """Two encoders of `documents`, two methods, two seeds; fitted on other rows than scored."""
    from clustrum.plans.common import cohort_column

    rows = table(spark, sf, "documents").select("doc_id", "text").withColumn("cohort", cohort_column("doc_id"))
    # Only the cohorts that are fitted or scored are encoded; the encoder keeps filters from being moved before it.
    rows = rows.filter("cohort IN ('training', 'selection')")
    train, held = {}, {}
    for name, dimension in (("small", 16), ("wide", 64)):
        encoded = materialize(models.encode_texts(rows, lambda d=dimension: models.HashedWordEncoder(d)).drop("text"), "sweep-vectors")
        train[name] = encoded.filter("cohort = 'training'")
        held[name] = encoded.filter("cohort = 'selection'")
    runs, _ = models.sweep(train, held, "doc_id", seeds=(42, 43), n_clusters=4, n_init=1, max_iter=15)
    return runs


def density_query(spark, sf):
    reduced = models.reduce_dimensions(vectors(spark, sf), 3)
    return models.density_cluster(reduced, "vec_id", "reduced", radius=0.1, min_neighbours=10, min_cluster_size=20)


def density_axes_query(spark, sf):
    """Density clusters of orders over (price, date) so that SQL can follow the cells."""
    orders = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array("l_quantity", F.col("l_discount") * 100).alias("v"))
    labelled = models.density_cluster(orders, "id", "v", radius=1.0, min_neighbours=10, min_cluster_size=50)
    return labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def reduce_query(spark, sf):
    reduced = models.reduce_dimensions(vectors(spark, sf), 15)
    return reduced.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("reduced")).alias("dimension"))


def profile_query(spark, sf):
    return models.language_profiles(table(spark, sf, "documents"))


def detect_query(spark, sf):
    documents = table(spark, sf, "documents")
    return models.language_detect(documents, models.language_profiles(documents)).select("doc_id", "detected")


def frozen_query(spark, sf):
    """Label means frozen, loaded again and used to assign."""
    path = scratch_path(spark, "frozen")
    identity = models.freeze_model(centroids_of(labelled_embeddings(spark, sf)), {"method": "spherical_kmeans", "n_clusters": 10}, path)
    centroids, _ = models.load_frozen(spark, path, identity, 64)
    return assign_clusters(vectors(spark, sf), centroids).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "encode_texts": encode_query,
    "spherical_kmeans_fit": fit_query("spherical_kmeans"),
    "kmeans_fit": fit_query("kmeans"),
    "stability_global": stability_query,
    "stability_algorithmic": algorithmic_query,
    "sweep": sweep_query,
    "spherical_kmeans_facts": fit_facts_query("spherical_kmeans"),
    "kmeans_facts": fit_facts_query("kmeans"),
    "kmeans_from_means": from_means_query("kmeans"),
    "spherical_kmeans_from_means": from_means_query("spherical_kmeans"),
    "kmeans_repeated_rows": repeated_rows_query,
    "stability_statistical": statistical_query,
    "reduced_variance": variance_query,
    "density_cluster": density_query,
    "density_cluster_cells": density_axes_query,
    "reduce_dimensions": reduce_query,
    "language_profiles": profile_query,
    "language_detect": detect_query,
    "frozen_model": frozen_query,
}

PROFILES = f"""
chars AS (SELECT doc_id, lang, lower({CLEAN}) AS t FROM documents),
pieces AS (SELECT doc_id, lang, unnest(regexp_extract_all(substr(t, o), '(?s).{{3}}')) AS trigram FROM chars, range(1, 4) s(o)),
profiles AS (
  SELECT lang, trigram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, trigram) - 1 AS position
  FROM (SELECT lang, trigram, count(*) AS n FROM pieces GROUP BY 1, 2) QUALIFY position < 300
)"""



def lloyd_sql(spherical: bool, steps: int = 3) -> str:
    """Iterations from the label means, one pair of tables each."""
    distance = "1 - list_dot_product(v, c)" if spherical else "list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c)"
    scale = "sqrt(sum(m * m) OVER (PARTITION BY cluster_id))" if spherical else "1"
    tables = [f"""
        rows_ AS (SELECT vec_id, {'list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))' if spherical else 'e'} AS v
          FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
        c0 AS (SELECT cluster_id, centroid AS c FROM centroids)"""]
    for i in range(steps + 1):
        tables.append(f"a{i} AS (SELECT vec_id, v, cluster_id, {distance} AS d FROM rows_, c{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) = 1)")
        if i < steps:
            tables.append(f"""c{i + 1} AS (SELECT cluster_id, list(m / s ORDER BY i) AS c FROM (
          SELECT *, {scale} AS s FROM (SELECT cluster_id, i, avg(v[i]) AS m FROM a{i}, range(1, 65) t(i) GROUP BY 1, 2)) GROUP BY cluster_id)""")
    return f"""
        WITH {SQL_CENTROIDS}, {', '.join(tables)}
        SELECT vec_id, cluster_id, (SELECT round(sum(d), 6) + 0.0 FROM a{steps}) AS inertia FROM a{steps}"""


ORACLES = {
    "kmeans_from_means": lloyd_sql(False),
    "spherical_kmeans_from_means": lloyd_sql(True),
    "kmeans_repeated_rows": """
        SELECT CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS place, count(*) AS n, CAST(10 AS BIGINT) AS centroids, CAST(0 AS DOUBLE) AS inertia
        FROM embeddings GROUP BY vec_id % 3""",
    "stability_statistical": """
        SELECT CAST(i AS INTEGER) AS repeat_a, CAST(i AS INTEGER) AS repeat_b, CAST(1 AS DOUBLE) AS ari, (SELECT count(*) FROM embeddings) AS n_common,
          'kmeans' AS method, 'statistical' AS mode FROM range(2) t(i)""",
    "encode_texts": f"""
        WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower({CLEAN}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w FROM documents),
        slots AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS dim, CAST(count(*) AS DOUBLE) AS n FROM words GROUP BY 1, 2),
        filled AS (SELECT * FROM slots UNION ALL SELECT doc_id, 0, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM slots))
        SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 4) + 0.0 AS value FROM filled""",
    "spherical_kmeans_facts": "SELECT count(*) AS n, CAST(10 AS BIGINT) AS clusters, true AS inertia_matches FROM embeddings",
    "kmeans_facts": "SELECT count(*) AS n, CAST(10 AS BIGINT) AS clusters, true AS inertia_matches FROM embeddings",
    "reduced_variance": """
        SELECT count(*) AS axes, round(sum(v), 6) + 0.0 AS variance
        FROM (SELECT i, var_pop(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) t(i) GROUP BY i)""",
    "density_cluster_cells": """
        WITH RECURSIVE cells AS (SELECT CAST(floor(l_quantity) AS BIGINT) AS x, CAST(floor(l_discount * 100) AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
        dense AS (SELECT a.x, a.y, a.x * 1000 + a.y AS k FROM cells a JOIN cells b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2 HAVING sum(b.n) >= 10),
        reach(x, y, root) AS (SELECT x, y, k FROM dense UNION SELECT d.x, d.y, r.root FROM reach r JOIN dense d ON abs(r.x - d.x) <= 1 AND abs(r.y - d.y) <= 1 WHERE r.root < d.k),
        labels AS (SELECT x, y, min(root) AS root FROM reach GROUP BY 1, 2),
        assigned AS (SELECT c.x, c.y, c.n, coalesce(max(l.root) FILTER (WHERE l.x = c.x AND l.y = c.y), min(l.root)) AS root
          FROM cells c LEFT JOIN labels l ON abs(l.x - c.x) <= 1 AND abs(l.y - c.y) <= 1 GROUP BY 1, 2, 3),
        sizes AS (SELECT root, sum(n) AS n FROM assigned GROUP BY root)
        SELECT CASE WHEN root IS NULL OR n < 50 THEN -1 ELSE CAST(row_number() OVER (ORDER BY n DESC) - 1 AS INTEGER) END AS cluster_id, CAST(sum(n) AS BIGINT) AS n
        FROM sizes GROUP BY root, n""",
    "language_profiles": f"WITH {PROFILES} SELECT lang, trigram, CAST(position AS INTEGER) AS position FROM profiles",
    "language_detect": f"""
        WITH {PROFILES},
        top AS (SELECT doc_id, trigram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, trigram) - 1 AS i
          FROM (SELECT doc_id, trigram, count(*) AS n FROM pieces GROUP BY 1, 2) QUALIFY i < 300),
        langs AS (SELECT DISTINCT lang FROM profiles),
        scores AS (SELECT t.doc_id, l.lang, sum(CASE WHEN p.position IS NULL THEN 300 ELSE abs(p.position - t.i) END) AS s
          FROM top t, langs l LEFT JOIN profiles p ON p.lang = l.lang AND p.trigram = t.trigram GROUP BY 1, 2),
        best AS (SELECT doc_id, lang FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s, lang) = 1)
        SELECT d.doc_id, coalesce(b.lang, 'NA') AS detected FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id""",
    "frozen_model": f"WITH {SQL_CENTROIDS} SELECT cluster_id, count(*) AS n FROM geometry GROUP BY cluster_id",
}
