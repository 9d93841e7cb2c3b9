"""One registered query per operator of this subpackage, with its SQL where SQL can express it."""
from __future__ import annotations

from pyspark.sql import functions as F

from clustrum.llm import (
    bpe, decontaminate, jaccard, langid, mixing, phrases, pii, quality, secret_scan, shards, spotsigs, urls, whitening,
)
from clustrum.llm.common import table

# Fixed values of the contract: the URL rules.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# Shares of the tokens that the mixture should have; production parameters of the query and the pipeline.
DOMAIN_TARGETS = {"toxic": 0.08}
# Stands in for a secret that a user would keep out of the code.
SURROGATE_KEY = b"key of the registered query"


def op1_url_filter(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_sharding(spark, sf):
    return shards.assign_shards(table(spark, sf, "documents"), 16)


def label_domains(labels):
    """Domain of each labelled document: toxic, or else plain or junk by its quality."""
    return labels.select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'plain' WHEN quality = 0 THEN 'junk' END").alias("domain"))


def op3_source_mixing(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents"), label_domains(table(spark, sf, "labels")), DOMAIN_TARGETS)
    shares = [F.col("posterior")[d].alias(f"p_{d}") for d in ("junk", "plain", "toxic")]
    return mixed.select("doc_id", "tokens", *shares, "rate", "copies")


def op4_quality_classifier(spark, sf):
    return quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op5_document_fingerprints(spark, sf):
    return spotsigs.fingerprint_edits(table(spark, sf, "documents"))


def op6_benchmark_decontamination(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("text_key")


def op7_pii_surrogates(spark, sf):
    return pii.replace_entities(table(spark, sf, "documents"), SURROGATE_KEY)


def op8_ngram_jaccard_join(spark, sf):
    return jaccard.near_duplicate_classes(table(spark, sf, "documents"))


def op9_language_id(spark, sf):
    return langid.predict_language(table(spark, sf, "documents"))


def op10_secret_scan(spark, sf):
    return secret_scan.scan_secrets(table(spark, sf, "documents"))


def op11_embedding_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


def op12_phrase_collocations(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


def op13_bpe(spark, sf):
    import public_tokenizers

    return bpe.round_trip(table(spark, sf, "documents"), bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_sharding, op3_source_mixing, op4_quality_classifier, op5_document_fingerprints,
    op6_benchmark_decontamination, op7_pii_surrogates, op8_ngram_jaccard_join,
    op9_language_id, op10_secret_scan, op11_embedding_whitening, op12_phrase_collocations, op13_bpe,
)}

ORACLES = {
    "op1_url_filter": """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parts""",
    "op6_benchmark_decontamination": """
WITH d AS (
  SELECT doc_id, rowid_ AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS passage
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS passage
  FROM (SELECT r, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM d, sizes)
), hits AS (SELECT r, i, places.n, item_id FROM places JOIN item_windows USING (passage)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op8_ngram_jaccard_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON other = x
)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op12_phrase_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, greatest(1, len(w) - k + 2))) AS i FROM split, range(1, 5) t(k))
), counted AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2 AND a >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * cuts.a // (x.a + y.a) AS BIGINT) AS score
  FROM cuts
  JOIN counted x ON x.lang = cuts.lang AND x.k = c AND x.phrase = array_to_string(w[1:c], ' ')
  JOIN counted y ON y.lang = cuts.lang AND y.k = cuts.k - c AND y.phrase = array_to_string(w[c + 1:], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates WHERE k > 2)) GROUP BY ALL
), kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE NOT coalesce(100 * longer >= 80 * a, false)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
