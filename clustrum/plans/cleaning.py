"""Queries of the cleaning operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from clustrum.functions.text import FRENCH_STOP_WORDS, clean_text, stop_tokens, tokens, trigrams, unigrams_and_bigrams
from clustrum.functions.vectors import dot, norm
from clustrum.operators import cleaning, cohorts, ordering
from clustrum.plans.common import rounded, sql_clean, sql_round, sql_words, table

CLEAN = sql_clean()


def documents(spark, sf):
    return table(spark, sf, "documents")


def dated(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("date_experience"))


def clean_query(spark, sf):
    return cleaning.with_clean_text(documents(spark, sf)).select("doc_id", "text")


def reject_query(spark, sf):
    return cleaning.reject_invalid(table(spark, sf, "conversations"), "conv_id")


def limits_query(spark, sf):
    return cleaning.text_limits(documents(spark, sf)).select("doc_id", "limit_reason")


def quarantine_query(spark, sf):
    valid, rest = cleaning.split_valid(cleaning.text_limits(documents(spark, sf)))
    counts = lambda df, kind, by: df.groupBy(by.alias("reason")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(kind))
    return counts(valid, "valid", F.lit("none")).unionByName(counts(rest, "quarantine", F.col("limit_reason")))


def title_query(spark, sf):
    gaps = documents(spark, sf).select("doc_id", F.when(F.col("lang") != "de", F.col("text")).alias("commentaire"), F.col("source").alias("titre"))
    return cleaning.fill_from_title(gaps).select("doc_id", "commentaire")


def drop_query(spark, sf):
    return cleaning.drop_columns(documents(spark, sf), ["text", "source"])


def language_query(spark, sf):
    return cleaning.language_filter(documents(spark, sf)).select("doc_id", "lang")


def date_query(spark, sf):
    return cleaning.parse_experience_date(dated(spark, sf))


def parts_query(spark, sf):
    parsed = cleaning.parse_experience_date(dated(spark, sf))
    return cleaning.year_month_parts(parsed).select("o_orderkey", "date_experience_year", "date_experience_month")


def reply_query(spark, sf):
    rated = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("text").alias("commentaire"), F.when(F.col("quality") == 1, F.col("source")).alias("dataServiceReply")
    )
    return cleaning.concat_reply(rated).select("doc_id", "comm_reply")


def features_query(spark, sf):
    return cleaning.text_features(documents(spark, sf)).select("doc_id", "character_length", "word_count")


def normalize_query(spark, sf):
    scaled = table(spark, sf, "embeddings").withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    )
    return cleaning.l2_normalize(scaled).select("vec_id", F.posexplode("embedding").alias("dim", "value")).select(
        "vec_id", "dim", rounded("value")
    )


def noise_query(spark, sf):
    noisy = table(spark, sf, "embeddings").select("vec_id", (F.col("label") - 1).alias("cluster_id"))
    return cleaning.drop_noise(noisy)


def rating_query(spark, sf):
    rated = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("note"))
    return cleaning.filter_by_rating(rated, 1).join(documents(spark, sf), "doc_id").select("doc_id", "note", "lang", "n_chars")


def dedupe_query(spark, sf):
    return cleaning.dedupe_reviews(documents(spark, sf).select("doc_id", "text", "lang", "source"), ["text", "lang"], "doc_id").select(
        "doc_id", "lang", "source"
    )


def duplicate_query(spark, sf):
    return cleaning.duplicate_ids(table(spark, sf, "conversations"), "conv_id")


def distinct_query(spark, sf):
    return cleaning.distinct_texts(documents(spark, sf))


def intersect_query(spark, sf):
    return cohorts.shared_ids(documents(spark, sf), table(spark, sf, "labels"), "doc_id")


def union_query(spark, sf):
    by = lambda name, column: table(spark, sf, name).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("method", F.lit(name))
    return by("documents", "lang").unionByName(by("events", "event_type")).unionByName(by("orders", "o_orderstatus"))


def sort_query(spark, sf):
    keyed = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return ordering.global_index(keyed, ["o_orderdate", "o_orderkey"], "position")


def digest_query(spark, sf):
    return cohorts.row_digests(documents(spark, sf), "doc_id")


def substring_query(spark, sf):
    text = F.col("date_experience")
    return dated(spark, sf).select(
        "o_orderkey", F.substring(text, -4, 4).cast("int").alias("year"),
        F.concat(F.lower(F.element_at(F.split(text, " "), 1)), F.lit("/"), F.length(text).cast("string")).alias("month_and_length"),
    )


def json_query(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.to_json(F.struct("event_id", "event_type")).alias("as_json"),
        F.sha2("props", 256).rlike("^[0-9a-f]{64}$").alias("is_hex"),
    )


def terms_query(spark, sf):
    words = tokens(clean_text("text"), stop_tokens(FRENCH_STOP_WORDS))
    return documents(spark, sf).select("doc_id", words.alias("w")).select("doc_id", "w", unigrams_and_bigrams(F.col("w")).alias("t")).select(
        "doc_id", F.size("w").alias("n_words"), F.size("t").alias("n_terms"),
        F.sha2(F.array_join("t", "|"), 256).alias("terms_digest"),
    )


def trigram_query(spark, sf):
    return documents(spark, sf).select(F.explode(trigrams(clean_text("text"))).alias("trigram")).groupBy("trigram").agg(
        F.count(F.lit(1)).alias("n")
    )


def vector_query(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", rounded(norm(v), "norm"), rounded(dot(v, F.reverse(v)), "palindrome"),
        rounded(F.array_max(v).cast("double"), "top"), F.array_position(v, F.array_max(v)).alias("top_at"),
    )


def null_functions_query(spark, sf):
    joined = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic").isNull(), "unknown").otherwise("fine").alias("toxicity"),
    )


STOP_SQL = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_tokens(FRENCH_STOP_WORDS)) + ")"
WORDS_SQL = f"list_filter(regexp_extract_all(lower({CLEAN}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN {STOP_SQL})"

QUERIES = {
    "clean_text": clean_query,
    "reject_invalid": reject_query,
    "text_limits": limits_query,
    "quarantine_split": quarantine_query,
    "fill_from_title": title_query,
    "drop_columns": drop_query,
    "language_filter": language_query,
    "parse_experience_date": date_query,
    "year_month_parts": parts_query,
    "concat_reply": reply_query,
    "text_features": features_query,
    "l2_normalize": normalize_query,
    "drop_noise": noise_query,
    "filter_by_rating": rating_query,
    "dedupe_reviews": dedupe_query,
    "duplicate_ids": duplicate_query,
    "distinct_texts": distinct_query,
    "intersect_ids": intersect_query,
    "union_results": union_query,
    "sort_by_date": sort_query,
    "text_digests": digest_query,
    "substring_functions": substring_query,
    "json_and_hash_functions": json_query,
    "tokens_and_ngrams": terms_query,
    "character_trigrams": trigram_query,
    "vector_functions": vector_query,
    "null_functions": null_functions_query,
}

ORACLES = {
    "clean_text": f"SELECT doc_id, {CLEAN} AS text FROM documents",
    "reject_invalid": f"""
        SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE {CLEAN} = '') AS BIGINT) AS blank_texts,
          CAST(count(*) FILTER (WHERE conv_id IS NULL) AS BIGINT) AS missing_ids,
          CAST(count(conv_id) - count(DISTINCT conv_id) AS BIGINT) AS surplus_ids FROM conversations""",
    "text_limits": f"""
        SELECT doc_id, CASE WHEN {CLEAN} = '' THEN 'blank' WHEN length(text) < 1 THEN 'too_short'
          WHEN length(text) > 5000 THEN 'too_long' END AS limit_reason FROM documents""",
    "quarantine_split": f"""
        SELECT coalesce(r, 'none') AS reason, count(*) AS n, CASE WHEN r IS NULL THEN 'valid' ELSE 'quarantine' END AS part
        FROM (SELECT CASE WHEN {CLEAN} = '' THEN 'blank' WHEN length(text) > 5000 THEN 'too_long' END AS r FROM documents)
        GROUP BY r""",
    "fill_from_title": "SELECT doc_id, CASE WHEN lang <> 'de' THEN text ELSE source END AS commentaire FROM documents",
    "drop_columns": "SELECT doc_id, lang, n_chars FROM documents",
    "language_filter": "SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND text IS NOT NULL",
    "parse_experience_date": """
        SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS date_experience, CAST(o_orderdate AS DATE) AS date_to_sort FROM orders""",
    "year_month_parts": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS date_experience_year,
          CAST(month(o_orderdate) AS INTEGER) AS date_experience_month FROM orders""",
    "concat_reply": """
        SELECT d.doc_id, d.text || CASE WHEN l.quality = 1 THEN d.source ELSE '' END AS comm_reply
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "text_features": f"""
        SELECT doc_id, CAST(length({CLEAN}) AS INTEGER) AS character_length, {sql_words(CLEAN)} AS word_count FROM documents""",
    "l2_normalize": f"""
        WITH scaled AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) * (label + 2) AS x FROM embeddings, range(1, 65) t(i))
        SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim,
          {sql_round('x / sqrt(sum(x * x) OVER (PARTITION BY vec_id))')} AS value FROM scaled""",
    "drop_noise": "SELECT vec_id, label - 1 AS cluster_id FROM embeddings WHERE label >= 1",
    "filter_by_rating": """
        SELECT l.doc_id, l.quality AS note, d.lang, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality = 1""",
    "dedupe_reviews": """
        SELECT doc_id, lang, source FROM documents
        QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1""",
    "duplicate_ids": "SELECT conv_id, count(*) AS copies FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "distinct_texts": f"SELECT DISTINCT sha256({CLEAN}) AS text_digest FROM documents",
    "intersect_ids": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "union_results": """
        SELECT lang AS value, count(*) AS n, 'documents' AS method FROM documents GROUP BY 1
        UNION ALL SELECT event_type, count(*), 'events' FROM events GROUP BY 1
        UNION ALL SELECT o_orderstatus, count(*), 'orders' FROM orders GROUP BY 1""",
    "sort_by_date": """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate,
          row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders""",
    "text_digests": f"SELECT doc_id, sha256({CLEAN}) AS text_digest FROM documents",
    "substring_functions": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
          lower(strftime(o_orderdate, '%B')) || '/' || length(strftime(o_orderdate, '%B %-d, %Y')) AS month_and_length FROM orders""",
    "json_and_hash_functions": """
        SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
          '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS as_json, true AS is_hex FROM events""",
    "tokens_and_ngrams": f"""
        WITH words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
        terms AS (SELECT doc_id, w, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM words)
        SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(t) AS INTEGER) AS n_terms,
          sha256(array_to_string(t, '|')) AS terms_digest FROM terms""",
    "character_trigrams": f"""
        WITH chars AS (SELECT {CLEAN} AS t FROM documents),
        pieces AS (SELECT unnest(regexp_extract_all(substr(t, o), '(?s).{{3}}')) AS trigram FROM chars, range(1, 4) s(o))
        SELECT trigram, count(*) AS n FROM pieces GROUP BY trigram""",
    "vector_functions": f"""
        SELECT vec_id, {sql_round('sqrt(list_dot_product(v, v))')} AS norm,
          {sql_round('list_dot_product(v, list_reverse(v))')} AS palindrome, {sql_round('list_max(v)')} AS top,
          CAST(list_position(v, list_max(v)) AS BIGINT) AS top_at
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
    "null_functions": """
        SELECT d.doc_id, coalesce(l.quality, -1) AS quality,
          CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic IS NULL THEN 'unknown' ELSE 'fine' END AS toxicity
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}
