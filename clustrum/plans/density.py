"""Queries over distances between rows: density clusters by radius, exact Euclidean silhouette."""
from __future__ import annotations

from pyspark.sql import functions as F

from clustrum.operators import density, tiles
from clustrum.plans.common import labelled_embeddings, rounded, table


def radius_query(spark, sf):
    """All 64 coordinates."""
    return density.radius_cluster(table(spark, sf, "embeddings"), "vec_id", "embedding", radius=1.2, min_neighbours=10)


def axes_query(spark, sf):
    """Two axes: the embeddings' first two coordinates."""
    plane = table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("v"))
    return density.radius_cluster(plane, "vec_id", "v", radius=0.02, min_neighbours=10, min_cluster_size=9)


def repeats_query(spark, sf):
    """Order lines by quantity and discount: few different points, each with a great share of the rows."""
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array("l_quantity", F.round(F.col("l_discount") * 100)).alias("v"))
    labelled = density.radius_cluster(lines, "id", "v", radius=1.0, min_neighbours=560, min_cluster_size=50)
    return labelled.groupBy("cluster_id", "is_core").agg(F.count(F.lit(1)).alias("n"))


def silhouette_query(spark, sf):
    return tiles.silhouette_euclidean(labelled_embeddings(spark, sf), "vec_id", "embedding").select(
        rounded("silhouette_euclidean"), "silhouette_n_samples")


def silhouette_sample_query(spark, sf):
    """A seeded sample of 300 rows, compared in tiles of 64."""
    return tiles.silhouette_euclidean(labelled_embeddings(spark, sf), "vec_id", "embedding", sample_rows=300, seed=42, tile=64).select(
        rounded("silhouette_euclidean"), "silhouette_n_samples")


QUERIES = {
    "radius_cluster": radius_query,
    "radius_cluster_axes": axes_query,
    "radius_cluster_repeats": repeats_query,
    "silhouette_euclidean": silhouette_query,
    "silhouette_euclidean_sample": silhouette_sample_query,
}


def dbscan_sql(points: str, distance: str, radius: float, least: int, smallest: int) -> str:
    """Common tables of a search over all pairs. `points`: id (the least of equal rows), v, n (rows at it)."""
    return f"""
        p AS ({points}),
        near AS (SELECT a.id AS x, b.id AS y, b.n FROM p a JOIN p b ON {distance} <= CAST({radius} AS DOUBLE)),
        core AS (SELECT x FROM near GROUP BY x HAVING sum(n) >= {least}),
        links AS (SELECT x, y FROM near WHERE x IN (SELECT x FROM core) AND y IN (SELECT x FROM core)),
        reach(x, root) AS (SELECT x, x FROM core UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.x WHERE r.root < l.y),
        labels AS (SELECT x, min(root) AS label FROM reach GROUP BY x),
        border AS (SELECT near.x, min(label) AS label FROM near JOIN labels ON labels.x = near.y WHERE near.x NOT IN (SELECT x FROM core) GROUP BY near.x),
        every AS (SELECT x, label, true AS is_core FROM labels UNION ALL SELECT x, label, false FROM border),
        sizes AS (SELECT label, CAST(row_number() OVER (ORDER BY sum(n) DESC, label) - 1 AS INTEGER) AS k
          FROM every JOIN p ON p.id = every.x GROUP BY label HAVING sum(n) >= {smallest}),
        clustered AS (SELECT p.id, p.n, coalesce(k, -1) AS cluster_id, coalesce(is_core, false) AS is_core
          FROM p LEFT JOIN every ON every.x = p.id LEFT JOIN sizes USING (label))"""


EMBEDDED = "SELECT vec_id AS id, CAST({v} AS DOUBLE[]) AS v, 1 AS n FROM embeddings"
LINES = """SELECT row_number() OVER (ORDER BY least_id, v) AS id, v, n FROM (
          SELECT min(l_orderkey * 10 + l_linenumber) AS least_id, [CAST(l_quantity AS DOUBLE), round(CAST(l_discount AS DOUBLE) * 100)] AS v, count(*) AS n
          FROM lineitem GROUP BY ALL)"""
SILHOUETTE = """
        pairs AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.v, b.v)) AS total FROM rows_ a JOIN rows_ b ON true GROUP BY ALL),
        sizes AS (SELECT label, count(*) AS n FROM rows_ GROUP BY label),
        parts AS (SELECT vec_id, max(n) FILTER (WHERE own = label) AS n, max(total / greatest(n - 1, 1)) FILTER (WHERE own = label) AS a,
          min(total / n) FILTER (WHERE own <> label) AS b FROM pairs JOIN sizes USING (label) GROUP BY vec_id)
        SELECT round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) + 0.0 AS silhouette_euclidean, count(*) AS silhouette_n_samples FROM parts"""

ORACLES = {
    "radius_cluster": f"""
        WITH RECURSIVE {dbscan_sql(EMBEDDED.format(v='embedding'), 'list_distance(a.v, b.v)', 1.2, 10, 1)}
        SELECT id AS vec_id, cluster_id, is_core FROM clustered""",
    "radius_cluster_axes": f"""
        WITH RECURSIVE {dbscan_sql(EMBEDDED.format(v='embedding[1:2]'), 'list_distance(a.v, b.v)', 0.02, 10, 9)}
        SELECT id AS vec_id, cluster_id, is_core FROM clustered""",
    "radius_cluster_repeats": f"""
        WITH RECURSIVE {dbscan_sql(LINES, 'list_distance(a.v, b.v)', 1.0, 560, 50)}
        SELECT cluster_id, is_core, CAST(sum(n) AS BIGINT) AS n FROM clustered GROUP BY ALL""",
    "silhouette_euclidean": f"WITH rows_ AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), {SILHOUETTE}",
    "silhouette_euclidean_sample": f"""
        WITH rows_ AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY sha256('42|' || vec_id) LIMIT 300), {SILHOUETTE}""",
}
