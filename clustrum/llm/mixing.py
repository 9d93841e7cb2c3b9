"""Rates of documents that bring the expected tokens of each domain to target shares, in column expressions only.

A naive Bayes classifier, learned from a table of labelled documents, gives every document a posterior over the
domains (soft membership). Nonnegative rates are then fitted by least squares on the domain totals: projected gradient
steps from a rate of one for all, so that documents are moved no more than the targets ask for. The state of the
descent is its list of residuals, one number per domain and step; rates are recomputed from it inside each pass over the
posteriors, and only domain totals reach the driver.
"""
from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrum.llm.common import broadcast_if_small
from clustrum.session import materialize

#: At most this many labelled rows are learned from, those with the smallest hash of the id.
SAMPLE_ROWS = 4000
#: Words of the classifier: those that tell the domains apart best in the sample.
VOCABULARY = 1000
#: Pseudo-rows of the whole sample added to each domain, and the least likelihood-ratio statistic of a word: chance words
#: of a small sample or a rare domain stay out.
SMOOTHING = 10.0
LEAST_STATISTIC = 25.0
MAX_STEPS = 60
#: Steps end when no domain total is off its target by more than this share of all tokens.
TOLERANCE = 1e-4


def words_of(text: Column) -> Column:
    """Words of the classifier: lower-cased, between blanks and line feeds, some of them empty."""
    return F.split(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" ")), " ", -1)


def n_tokens(text: Column) -> Column:
    """Number of the runs without ASCII blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\\S+")).cast("long")


def learn_domains(docs: DataFrame, labelled: DataFrame, key: str, text: str, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[str, float]]:
    """(word, weights: array in the order of the domains) and the logit of each domain for a text without any of the words.

    `labelled` has (key, domain). Naive Bayes on the presence of words: a weight is what a word adds to the logit. Words are those whose
    presence depends on the domain most clearly; at most VOCABULARY, ties go to the smaller word.
    """
    chosen = labelled.where(F.col(key).isNotNull() & F.col("domain").isNotNull()).select(F.col(key).alias("__id"), "domain")
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("__id"), "__id", "domain").limit(sample_rows))
    sample = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(chosen, "__id")
    held = materialize(sample.select("domain", F.array_distinct(words_of(F.col("text"))).alias("words")), "domain-sample")
    rows = {r["domain"]: r["n"] for r in held.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").collect()}
    domains, total = sorted(rows), sum(rows.values())
    if not domains:
        return docs.sparkSession.createDataFrame([], "word string, weights array<double>"), {}
    counts = held.select("domain", F.explode("words").alias("word")).where("word <> ''").groupBy("word").agg(
        *[F.sum((F.col("domain") == d).cast("double")).alias(f"n{i}") for i, d in enumerate(domains)], F.count("*").cast("double").alias("n"))
    overall = F.col("n") / total
    counts = counts.where(overall < 1)
    inside = [(F.col(f"n{i}") + overall * SMOOTHING) / (rows[d] + SMOOTHING) for i, d in enumerate(domains)]
    present = [F.log(p / overall) for p in inside]
    absent = [F.log((F.lit(1.0) - p) / (F.lit(1.0) - overall)) for p in inside]
    statistic = sum((
        (p * x + (F.lit(1.0) - p) * y) * (2 * rows[d]) for d, p, x, y in zip(domains, inside, present, absent)), F.lit(0.0))
    ranked = counts.select("word", F.array(*[x - y for x, y in zip(present, absent)]).alias("weights"), F.array(*absent).alias("absent"), statistic.alias("statistic"))
    vocabulary = materialize(ranked.where(F.col("statistic") >= LEAST_STATISTIC).orderBy(F.desc("statistic"), "word").limit(VOCABULARY), "vocabulary")
    base = vocabulary.agg(*[F.sum(F.element_at("absent", i + 1)) for i in range(len(domains))]).first()
    return vocabulary.select("word", "weights"), {d: log(rows[d] / total) + (base[i] or 0.0) for i, d in enumerate(domains)}


def domain_posteriors(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", **options) -> tuple[DataFrame, list[str]]:
    """(doc_id, text_key, tokens, posterior: array in the order of the returned domains), one row per row of `docs`.

    Only words of the vocabulary leave the explode of a text; their weights are summed per (id, text digest) before the shuffle.
    """
    vocabulary, logits = learn_domains(docs, labelled, key, text, **options)
    domains = sorted(logits)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.md5(content.cast("binary")).alias("text_key"), n_tokens(content).alias("tokens"), content.alias("text"))
    if not domains:
        return rows.select("doc_id", "text_key", "tokens", F.array().cast("array<double>").alias("posterior")), domains
    # One empty word in each text, which weighs nothing: it keeps texts without known words, and counts equal rows.
    words = rows.select("doc_id", "text_key", "tokens", F.array_union(words_of(F.col("text")), F.array(F.lit(""))).alias("words"))
    names = [f"w{i}" for i in range(len(domains))]
    known = vocabulary.select("word", *[F.element_at("weights", i + 1).alias(n) for i, n in enumerate(names)])
    known = known.unionAll(vocabulary.sparkSession.range(1).select(F.lit(""), *[F.lit(0.0) for _ in names]))
    # At most VOCABULARY words and the empty one.
    hits = words.select("doc_id", "text_key", "tokens", F.explode("words").alias("word")).join(F.broadcast(known), "word")
    summed = hits.groupBy("doc_id", "text_key", "tokens").agg(
        F.count_if(F.col("word") == "").alias("equal"), *[F.sum(n).alias(n) for n in names])
    logit = [F.lit(logits[d]) + F.col(n) / F.col("equal") for d, n in zip(domains, names)]
    top = F.greatest(*logit) if len(logit) > 1 else logit[0]
    powers = summed.select("doc_id", "text_key", "tokens", "equal", F.array(*[F.exp(x - top) for x in logit]).alias("powers"))
    total = F.aggregate("powers", F.lit(0.0), lambda a, x: a + x)
    found = powers.select("doc_id", "text_key", "tokens", "equal", F.transform("powers", lambda p: p / total).alias("posterior"))
    return _repeated(found, "equal"), domains


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as the column `times` says, without it; no array is longer than a million."""
    step, million = "__step", 1_000_000
    blocks = rows.where(F.col(times) > 0).withColumn(step, F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / million))))
    size = F.least(F.lit(million), F.col(times) - F.col(step) * million)
    return blocks.withColumn(step, F.explode(F.sequence(F.lit(1).cast("long"), size.cast("long")))).drop(step, times)


def rate_after(posterior: Column, steps: list[list[float]]) -> Column:
    """Rate of a document after the given gradient steps, each projected on rates from zero up."""
    def step(rate: Column, gradient: Column) -> Column:
        slope = F.aggregate(F.arrays_zip(posterior.alias("p"), gradient.alias("g")), F.lit(0.0), lambda a, z: a + z["p"] * z["g"])
        return F.greatest(F.lit(0.0), rate - slope)

    taken = F.array(*[F.array(*map(F.lit, s)) for s in steps]) if steps else F.array().cast("array<array<double>>")
    return F.aggregate(taken, F.lit(1.0), step)


def fit_rates(posteriors: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[list[list[float]], list[dict[str, float]]]:
    """Gradient steps that bring expected domain tokens to `targets` (shares of all tokens now), and the totals before and
    after each.

    Domains without a target share what is left in proportion to their tokens. With tokens t and posteriors p, misses m are
    measured by the inverse of M = sum(t p p') over the documents with a rate above zero, a matrix of the size of the domains:
    the gradient per token is then p' M^-1 m, and a step of one solves the problem at once where no rate meets zero.
    Steps go on until the misses are within TOLERANCE or no longer fall. What cannot be reached is approached as
    closely as rates allow.
    """
    places = range(len(domains))
    share = [F.element_at("posterior", i + 1) for i in places]

    def state(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of the domains, and M, after these steps."""
        rated = posteriors.withColumn("rate", rate_after(F.col("posterior"), steps))
        free = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(0)
        row = rated.agg(
            *[F.sum(F.col("rate") * F.col("tokens") * p) for p in share],
            *[F.sum(free * share[i] * share[j]) for i in places for j in places]).first()
        values = np.array([float(x or 0.0) for x in row])
        return values[:len(domains)], values[len(domains):].reshape(len(domains), -1)

    now, moments = state([])
    everything = now.sum()
    given = sum(targets.get(d, 0.0) for d in domains)
    free = sum(n for n, d in zip(now, domains) if d not in targets)
    wanted = np.array([
        everything * (targets[d] if d in targets else max(0.0, 1 - given) * (n / free if free else 0.0)) for n, d in zip(now, domains)])
    steps, history = [], [now]
    for _ in range(MAX_STEPS):
        misses = history[-1] - wanted
        worst = np.abs(misses).max()
        if worst <= TOLERANCE * everything or (len(history) > 3 and worst > 0.999 * np.abs(history[-3] - wanted).max()):
            break
        steps.append((np.linalg.pinv(moments, rcond=1e-9, hermitian=True) @ misses).tolist())
        now, moments = state(steps)
        history.append(now)
    return steps, [dict(zip(domains, h.tolist())) for h in history]


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: doc_id, tokens, posterior (map by domain), rate (expected copies) and copies (its rounding by a hash of id and text).

    Copies are the whole part of the rate, and one more with the chance of the rest, so their expectation is the rate. Null
    and empty texts have no tokens and the prior as posterior; repeated rows get equal rates; without labelled rows all
    rates are 1; an empty table gives no rows. Further columns are not read.
    """
    posteriors, domains = domain_posteriors(docs, labelled, key, text, **options)
    posteriors = materialize(posteriors, "posteriors")
    steps, _ = fit_rates(posteriors, domains, targets) if domains else ([], [])
    rated = posteriors.withColumn("rate", rate_after(F.col("posterior"), steps) if domains else F.lit(1.0))
    chance = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(1 << 30)) / float(1 << 30)
    names = F.array(*map(F.lit, domains)) if domains else F.array().cast("array<string>")
    return rated.select(
        "doc_id", "text_key", "tokens", F.map_from_arrays(names, "posterior").alias("posterior"), "rate",
        (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with each row as often as its copies say; ids and texts of copies are those of the row."""
    copies = materialize(mix(docs, labelled, targets, key, text, **options).where("copies <> 1").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), F.col("copies").alias("__copies")).distinct(), "copies")
    same = docs[key].eqNullSafe(F.col("__id")) & (F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")) == F.col("__text"))
    counted = docs.join(broadcast_if_small(copies), same, "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    return _repeated(counted, "__copies").select(*docs.columns)
