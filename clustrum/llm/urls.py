"""URL filter lists: host-suffix and path-prefix expressions joined on hash prefixes, then confirmed.

Each URL is expanded into the expressions a rule could have, every expression is looked up by the first digits of
its SHA-256 in the rule table, the full digest confirms, and the longest rule decides.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrum.llm.common import LOWER, UPPER, broadcast_if_small
from clustrum.session import materialize

PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """Text between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(rules: DataFrame, rule: str = "rule", verdict: str = "verdict") -> DataFrame:
    """Rules as (rule, verdict, host labels, path length, prefix, digest), one row per expression.

    A rule is `host` + `path`, like `example.net/en/`; null rules and rules without a host fit nothing and go.
    Of contradicting rows for one rule, `block` wins.
    """
    text = F.col(rule)
    host = F.translate(F.regexp_extract(text, "^[^/]*", 0), UPPER, LOWER)
    path = F.regexp_extract(text, "^[^/]*(.*)$", 1)
    return (
        rules.where(text.isNotNull() & (host != ""))
        .select(F.concat(host, path).alias("expression"), F.col(verdict).alias("verdict"), host.alias("h"), path.alias("p"))
        .groupBy("expression", "h", "p").agg(F.max("verdict").alias("verdict"))
        .select(
            F.col("expression").alias("rule"), "verdict", F.size(F.split("h", r"\.", -1)).alias("labels"),
            F.length("p").alias("path_length"), F.sha2("expression", 256).alias("digest"),
        )
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All (host suffix + path prefix) texts whose numbers of labels and characters occur among the rules."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.filter(F.array(*map(F.lit, labels)), lambda k: k <= F.size(parts)),
        lambda k: F.array_join(F.slice(parts, -k, k), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length(path)), lambda k: F.substring(path, F.lit(1), k))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict of its URL; columns of these names are replaced.

    A rule fits its own host and all subdomains if the path starts with the rule's; the longest fitting rule decides,
    without one the verdict is `default` and the rule null. The rule table is broadcast only below a checked size. Copies
    of a URL are judged once, and the judged URLs are written, so that a URL of a third of all rows is a
    join side that Spark can split. Null URLs, URLs without `://`, and empty tables give empty host and path and `default`.
    """
    known = materialize(rule_table(rules), "url-rules")
    # Numbers of host labels and path lengths in use: at most 127 and the length of the longest rule.
    shape = known.agg(F.sort_array(F.collect_set("labels")), F.sort_array(F.collect_set("path_length"))).first()
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if not shape[0]:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    distinct = parsed.where("host <> ''").select("host", "path").distinct()
    expanded = distinct.select(
        "host", "path", F.explode(expressions(F.col("host"), F.col("path"), shape[0], shape[1])).alias("expression"),
    ).withColumn("url_digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("url_digest", 1, PREFIX_DIGITS))
    found = expanded.join(broadcast_if_small(known), "prefix").where(F.col("digest") == F.col("url_digest"))
    decided = found.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("length"), "rule", "verdict")).alias("best"),
    ).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    decided = materialize(decided, "url-verdicts")
    return parsed.join(decided, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
