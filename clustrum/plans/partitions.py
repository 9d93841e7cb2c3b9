"""Queries of partition comparison and model selection. Runs are partitions of `embeddings` by the
largest or smallest of ten coordinates: two encoders (raw, absolute values), two methods, five seeds."""
from __future__ import annotations

from pyspark.sql import functions as F

from clustrum.operators import partitions as p
from clustrum.operators.geometry import assign_clusters, centroids_of, silhouette_cosine
from clustrum.plans.common import SQL_CENTROIDS, labelled_embeddings, rounded, table

GROUPS = ["encoder", "method"]
SEEDS = (42, 43, 44, 45, 46)
# First coordinate and length of the part of each vector that stands for a run: all 64 coordinates.
PARTS = {42: (1, 13), 43: (14, 13), 44: (27, 13), 45: (40, 13), 46: (53, 12)}


def run_labels(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.transform("embedding", F.abs).alias("sizes"))
    cells = []
    for encoder, vector in (("absolute", "sizes"), ("raw", "embedding")):
        for method, pick in (("largest", F.array_max), ("smallest", F.array_min)):
            for seed in SEEDS:
                part = F.slice(vector, *PARTS[seed])
                cells.append(F.struct(
                    F.lit(encoder).alias("encoder"), F.lit(method).alias("method"), F.lit(seed).alias("seed"),
                    (F.array_position(part, pick(part)) - 1).cast("int").alias("label"),
                ))
    return rows.select("vec_id", "embedding", F.inline(F.array(*cells)))


def pairs(spark, sf):
    return p.pairwise_ari(run_labels(spark, sf).drop("embedding"), GROUPS, "vec_id")


def runs(spark, sf):
    return silhouette_cosine(run_labels(spark, sf), "embedding", "label", [*GROUPS, "seed"]).withColumnRenamed("silhouette_cosine", "silhouette")


def assigned(spark, sf):
    rows = labelled_embeddings(spark, sf)
    model = centroids_of(rows)
    return assign_clusters(rows.select("vec_id", "embedding", (F.col("cluster_id") - 1).alias("a")), model).select(
        "vec_id", "a", F.col("cluster_id").alias("b"))


def compare_query(spark, sf):
    return p.compare_partitions(assigned(spark, sf), "a", "b").withColumns(
        {"ari": rounded(F.col("ari")), "ari_assigned_only": rounded(F.col("ari_assigned_only"))})


def compare_text_query(spark, sf):
    documents = table(spark, sf, "documents")
    lang = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(-1)
    coded = documents.select(lang.alias("a"), F.length("source").alias("b"))
    return p.compare_partitions(coded, "a", "b").withColumns(
        {"ari": rounded(F.col("ari")), "ari_assigned_only": rounded(F.col("ari_assigned_only"))})


def overlap_query(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", F.length("lang").alias("cluster_id"))
    return p.partition_overlap(left, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("cluster_id")), "doc_id")


def pairwise_query(spark, sf):
    return p.pairwise_runs(table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber"), ["l_returnflag"], "l_linenumber")


def pairwise_ari_query(spark, sf):
    return pairs(spark, sf).withColumn("ari", rounded("ari"))


def finished(spark, sf):
    return table(spark, sf, "events").filter("value > 200").select("event_type", F.hour("ts").alias("hour"))


def grid_query(spark, sf):
    return p.sweep_grid(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


def missing_query(spark, sf):
    events = table(spark, sf, "events").select("event_type", F.hour("ts").alias("hour"))
    expected = p.sweep_grid(events.filter("hour < 23"), ["event_type", "hour"])
    return p.missing_configurations(expected, finished(spark, sf), ["event_type", "hour"])


def evaluations(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("configuration"), F.col("l_orderkey").alias("train_id"), F.col("l_linestatus").alias("status"),
        F.col("l_shipdate").cast("date").alias("started"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"),
    ).distinct()


def newest_query(spark, sf):
    return p.newest_run(evaluations(spark, sf), ["configuration"], "started", "run_id", F.col("status") == "F").select(
        "configuration", "started", "run_id")


def link_query(spark, sf):
    newest = p.newest_run(evaluations(spark, sf), ["configuration"], "started", "run_id", F.col("status") == "F")
    trainings = table(spark, sf, "orders").select(F.col("o_orderkey").alias("train_id"), F.col("o_orderstatus").alias("status"))
    return p.link_train_eval(newest, trainings, "train_id", ["status"]).select("configuration", "train_id", "run_id")


def aggregate_query(spark, sf):
    out = p.sweep_aggregate(runs(spark, sf), pairs(spark, sf), GROUPS)
    return out.withColumns({c: rounded(F.col(c)) for c in ("silhouette_mean", "silhouette_std", "ari_mean", "ari_std")})


def peer_query(spark, sf):
    return p.peer_ari(pairs(spark, sf), GROUPS).withColumns({c: rounded(F.col(c)) for c in ("ari_mean", "ari_std")})


def rank_query(spark, sf):
    metrics = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("method")).agg(
        F.when(F.count(F.lit(1)) % 7 == 0, F.lit(float("nan"))).otherwise(F.round(F.avg("l_discount"), 4)).alias("davies_bouldin"))
    return p.rank_models(metrics, "davies_bouldin", "minimize")


def winner_query(spark, sf):
    scored = runs(spark, sf)
    return p.select_winner(p.sweep_aggregate(scored, pairs(spark, sf), GROUPS), scored, 42).select(
        *GROUPS, "seed", rounded("silhouette"), rounded("silhouette_mean"), rounded("ari_mean"))


def runs_of(spark, sf, flag):
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).groupBy("l_suppkey").agg(
        F.max("l_linenumber").alias("configuration"), F.min("l_quantity").alias("n_samples"),
        F.when(F.count(F.lit(1)) % 5 != 0, F.avg("l_discount")).alias("silhouette_cosine"))


def compare_runs_query(spark, sf):
    out = p.compare_runs(runs_of(spark, sf, "A"), runs_of(spark, sf, "R"), "l_suppkey", ["configuration", "n_samples"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("previous_score", "final_score", "difference")})


QUERIES = {
    "compare_partitions": compare_query,
    "compare_partitions_text": compare_text_query,
    "partition_overlap": overlap_query,
    "pairwise_runs": pairwise_query,
    "pairwise_ari": pairwise_ari_query,
    "sweep_grid": grid_query,
    "missing_configurations": missing_query,
    "newest_run": newest_query,
    "link_train_eval": link_query,
    "sweep_aggregate": aggregate_query,
    "peer_ari": peer_query,
    "rank_models": rank_query,
    "select_winner": winner_query,
    "compare_runs": compare_runs_query,
}


def ari_sql(cells: str, keys: str, name: str) -> str:
    """CTEs giving `name`(keys, n, ari) from a cell relation (keys, a, b, n)."""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""
        {name}_ab AS (SELECT {lead}sum(n * (n - 1) / 2) AS ab, sum(n) AS n FROM {cells} {group}),
        {name}_a AS (SELECT {lead}sum(m * (m - 1) / 2) AS ea FROM (SELECT {lead}a, sum(n) AS m FROM {cells} GROUP BY {lead}a) {group}),
        {name}_b AS (SELECT {lead}sum(m * (m - 1) / 2) AS eb FROM (SELECT {lead}b, sum(n) AS m FROM {cells} GROUP BY {lead}b) {group}),
        {name} AS (
          SELECT {lead}CAST(n AS BIGINT) AS n, CASE WHEN n < 2 THEN NULL WHEN ab = ea AND ab = eb THEN 1.0
            ELSE (ab - ea * eb / (n * (n - 1) / 2)) / ((ea + eb) / 2 - ea * eb / (n * (n - 1) / 2)) END AS ari
          FROM {name}_ab JOIN {name}_a {using} JOIN {name}_b {using})"""


def comparison_sql(pairs_cte: str) -> str:
    return f"""
        WITH {pairs_cte},
        cells AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM pairs GROUP BY a, b),
        kept AS (SELECT * FROM cells WHERE a >= 0 AND b >= 0), {ari_sql('cells', '', 'every')}, {ari_sql('kept', '', 'assigned')}
        SELECT round(every.ari, 6) + 0.0 AS ari, round(assigned.ari, 6) + 0.0 AS ari_assigned_only, every.n AS n_common, assigned.n AS n_common_assigned
        FROM every, assigned"""


def _configurations() -> str:
    cells = []
    for encoder, vector in (("absolute", "list_transform(v, lambda x: abs(x))"), ("raw", "v")):
        for method, pick in (("largest", "list_max"), ("smallest", "list_min")):
            for seed in SEEDS:
                part = f"({vector})[{PARTS[seed][0]}:{sum(PARTS[seed]) - 1}]"
                cells.append(
                    f"SELECT vec_id, '{encoder}' AS encoder, '{method}' AS method, {seed} AS seed, "
                    f"CAST(list_position({part}, {pick}({part})) - 1 AS INTEGER) AS label, v FROM vec"
                )
    return " UNION ALL ".join(cells)


RUNS = f"vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), runs AS ({_configurations()})"
PAIRS = RUNS + """,
cells AS (
  SELECT x.encoder, x.method, x.seed AS seed_a, y.seed AS seed_b, x.label AS a, y.label AS b, CAST(count(*) AS DOUBLE) AS n
  FROM runs x JOIN runs y ON x.vec_id = y.vec_id AND x.encoder = y.encoder AND x.method = y.method AND x.seed < y.seed GROUP BY ALL
), """ + ari_sql("cells", "encoder, method, seed_a, seed_b", "pairs")
SCORES = """
sums AS (
  SELECT encoder, method, seed, label, any_value(n) AS n, list(s ORDER BY i) AS s FROM (
    SELECT encoder, method, seed, label, i, sum(v[i]) AS s, count(*) AS n FROM runs, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1, 2, 3, 4
),
means AS (
  SELECT r.vec_id, r.encoder, r.method, r.seed, r.label = s.label AS own, s.n,
    CASE WHEN r.label = s.label THEN (s.n - 1 - (list_dot_product(r.v, s.s) - list_dot_product(r.v, r.v))) / greatest(s.n - 1, 1)
      ELSE 1 - list_dot_product(r.v, s.s) / s.n END AS d
  FROM runs r JOIN sums s ON r.encoder = s.encoder AND r.method = s.method AND r.seed = s.seed
),
per_row AS (
  SELECT vec_id, encoder, method, seed, max(d) FILTER (WHERE own) AS a, min(d) FILTER (WHERE NOT own) AS b, max(n) FILTER (WHERE own) AS size
  FROM means GROUP BY 1, 2, 3, 4
),
scores AS (
  SELECT encoder, method, seed, avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM per_row GROUP BY 1, 2, 3
)"""
AGGREGATED = """
agg AS (
  SELECT s.encoder, s.method, s.n_seeds, s.m, s.sd, p.am, p.asd, p.k FROM
    (SELECT encoder, method, count(*) AS n_seeds, avg(silhouette) AS m, stddev_samp(silhouette) AS sd FROM scores GROUP BY 1, 2) s
    JOIN (SELECT encoder, method, avg(ari) AS am, stddev_samp(ari) AS asd, count(*) AS k FROM pairs GROUP BY 1, 2) p
    ON s.encoder = p.encoder AND s.method = p.method
)"""
EVALUATIONS = """
evals AS (
  SELECT DISTINCT l_partkey AS configuration, l_orderkey AS train_id, l_linestatus AS status, CAST(l_shipdate AS DATE) AS started,
    l_orderkey * 10 + l_linenumber AS run_id FROM lineitem
),
newest AS (SELECT * FROM evals WHERE status = 'F' QUALIFY row_number() OVER (PARTITION BY configuration ORDER BY started DESC, run_id) = 1)"""


def runs_sql(flag: str) -> str:
    return f"""
        SELECT l_suppkey, max(l_linenumber) AS c, min(l_quantity) AS q, CASE WHEN count(*) % 5 <> 0 THEN avg(l_discount) END AS s
        FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY l_suppkey"""


ORACLES = {
    "compare_partitions": comparison_sql(SQL_CENTROIDS + ", pairs AS (SELECT label - 1 AS a, cluster_id AS b FROM geometry)"),
    "compare_partitions_text": comparison_sql(
        "pairs AS (SELECT CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE -1 END AS a, length(source) AS b FROM documents)"),
    "partition_overlap": """
        SELECT d.doc_id, CAST(length(lang) AS INTEGER) AS a, quality AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "pairwise_runs": """
        WITH r AS (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem)
        SELECT a.l_returnflag, a.l_linenumber AS seed_a, b.l_linenumber AS seed_b FROM r a JOIN r b ON a.l_returnflag = b.l_returnflag AND a.l_linenumber < b.l_linenumber""",
    "pairwise_ari": f"WITH {PAIRS} SELECT encoder, method, seed_a, seed_b, round(ari, 6) + 0.0 AS ari, n FROM pairs",
    "sweep_grid": """
        SELECT * FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT DISTINCT o_orderpriority FROM orders)""",
    "missing_configurations": """
        WITH e AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, value FROM events),
        expected AS (SELECT * FROM (SELECT DISTINCT event_type FROM e WHERE hour < 23), (SELECT DISTINCT hour FROM e WHERE hour < 23)),
        found AS (SELECT DISTINCT event_type, hour FROM e WHERE value > 200)
        SELECT event_type, hour, 'missing' AS problem FROM (SELECT * FROM expected EXCEPT SELECT * FROM found)
        UNION ALL SELECT event_type, hour, 'unexpected' FROM (SELECT * FROM found EXCEPT SELECT * FROM expected)""",
    "newest_run": f"WITH {EVALUATIONS} SELECT configuration, started, run_id FROM newest",
    "link_train_eval": f"""
        WITH {EVALUATIONS} SELECT configuration, train_id, run_id FROM newest JOIN orders ON o_orderkey = train_id AND o_orderstatus = status""",
    "sweep_aggregate": f"""
        WITH {PAIRS}, {SCORES}, {AGGREGATED}
        SELECT encoder, method, n_seeds, n_seeds AS valid_silhouettes, n_seeds = 5 AS eligible, round(m, 6) + 0.0 AS silhouette_mean,
          round(sd, 6) + 0.0 AS silhouette_std, round(am, 6) + 0.0 AS ari_mean, round(asd, 6) + 0.0 AS ari_std, k AS ari_pairs FROM agg""",
    "peer_ari": f"""
        WITH {PAIRS}, sides AS (SELECT encoder, method, seed_a AS seed, ari FROM pairs UNION ALL SELECT encoder, method, seed_b, ari FROM pairs)
        SELECT encoder, method, seed, round(avg(ari), 6) + 0.0 AS ari_mean, round(stddev_samp(ari), 6) + 0.0 AS ari_std, count(*) AS ari_pairs FROM sides GROUP BY 1, 2, 3""",
    "rank_models": """
        WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) AS method, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE round(avg(l_discount), 4) END AS score FROM lineitem GROUP BY 1)
        SELECT method, score, score IS NULL AS excluded, CASE WHEN score IS NOT NULL THEN CAST(row_number() OVER (ORDER BY score NULLS LAST, method) AS INTEGER) END AS rank FROM m""",
    "select_winner": f"""
        WITH {PAIRS}, {SCORES}, {AGGREGATED}, best AS (SELECT * FROM agg ORDER BY m DESC, am DESC, encoder, method LIMIT 1)
        SELECT b.encoder, b.method, s.seed, round(s.silhouette, 6) + 0.0 AS silhouette, round(m, 6) + 0.0 AS silhouette_mean, round(am, 6) + 0.0 AS ari_mean
        FROM best b JOIN scores s ON s.encoder = b.encoder AND s.method = b.method AND s.seed = 42""",
    "compare_runs": f"""
        WITH j AS (SELECT r.*, a.l_suppkey IS NOT NULL AS known, a.c = r.c AND a.q = r.q AS agree, a.s AS old FROM ({runs_sql('R')}) r LEFT JOIN ({runs_sql('A')}) a ON a.l_suppkey = r.l_suppkey)
        SELECT l_suppkey, CASE WHEN NOT known THEN 'unavailable' WHEN NOT agree THEN 'incompatible' WHEN old IS NOT NULL AND s IS NOT NULL THEN 'available' ELSE 'unavailable' END AS status,
          CASE WHEN known AND agree THEN round(old, 6) + 0.0 END AS previous_score, CASE WHEN known AND agree THEN round(s, 6) + 0.0 END AS final_score,
          CASE WHEN known AND agree THEN round(s - old, 6) + 0.0 END AS difference FROM j""",
}
