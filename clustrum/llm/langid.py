"""Language of a text by the nearest of several centroids per language, with rejection by distance.

A text is a unit TF-IDF vector of hashed letter n-grams (two and three bytes of its lower-cased letters, other characters
read as one blank). Each language of a bounded labelled sample has a few centroids from spherical k-means, so that unlike
kinds of text in one language keep centroids of their own. A text gets the language of the centroid with the largest
cosine; texts farther away than nearly all labelled texts of that centroid are marked as rejected.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clustrum.llm.common import held_out

#: At most this many labelled rows per language are learned from, those with the smallest hash of the id, and of at most
#: MAX_LANGUAGES languages (the most frequent ones).
ROWS_PER_LANGUAGE = 600
MAX_LANGUAGES = 200
CENTROIDS = 4
BUCKETS = 8192
BLOCK_ROWS = 256
#: A text is rejected beyond this quantile of its centroid's labelled distances, widened by half the rest of the way to 1.
REJECT_QUANTILE = 0.999

_OTHERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed two- and three-byte grams of the letters of the whole text."""
    data = np.frombuffer((" " + _OTHERS.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = data[:-1] * np.uint32(257) + data[1:]
    three = two[:-1] * np.uint32(263) + data[2:] + np.uint32(1)
    grams = np.concatenate([two * np.uint32(2654435761), three * np.uint32(2246822519)]) >> np.uint32(19)
    return np.bincount(grams, minlength=BUCKETS).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Model:
    weights: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        counts = np.array([gram_counts(t) for t in texts], np.float32).reshape(len(texts), BUCKETS)
        return unit(np.log1p(counts) * self.weights)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine of the nearest centroid, and whether it is too far; `und`, 0 and rejected without letters."""
        names, scores, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if rows and self.languages:
            cosines = self.vectors([texts[i] for i in rows]) @ self.centroids.T
            best = cosines.argmax(axis=1)
            top = np.clip(cosines[np.arange(len(rows)), best].astype(np.float64), 0.0, 1.0)
            scores[rows], rejected[rows] = top, 1 - top > self.limits[best]
            for i, b in zip(rows, best):
                names[i] = self.languages[b]
        return names, scores, rejected


def cluster(rows: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts: unit centroids, and each row's centroid."""
    picked, nearest = [0], rows @ rows[0]
    while len(picked) < min(k, len(rows)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[picked[-1]])
    centroids = rows[picked]
    for _ in range(rounds):
        member = (rows @ centroids.T).argmax(axis=1)
        sums = np.array([rows[member == c].sum(axis=0) if (member == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = unit(sums)
    return centroids, (rows @ centroids.T).argmax(axis=1)


def fit_model(counts: np.ndarray, languages: list[str], k: int = CENTROIDS) -> Model:
    """Inverse document frequencies and centroids of a labelled sample (rows of gram counts)."""
    frequency = (counts > 0).sum(axis=0)
    weights = (np.log((1 + len(counts)) / (1 + frequency)) + 0.05).astype(np.float32)
    vectors = unit(np.log1p(counts) * weights)
    names, centroids, limits = [], [np.zeros((0, BUCKETS), np.float32)], []
    for language in sorted(set(languages)):
        rows = vectors[[i for i, l in enumerate(languages) if l == language]]
        found, member = cluster(rows, k)
        far = 1 - np.einsum("ij,ij->i", rows, found[member])
        for c in range(len(found)):
            reach = np.quantile(far[member == c], REJECT_QUANTILE) if (member == c).any() else 0.0
            names.append(language), limits.append(reach + (1 - reach) / 2)
        centroids.append(found)
    return Model(weights, np.concatenate(centroids), names, np.array(limits))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", exclude: Column | None = None) -> Model:
    """Model from a bounded sample of the rows with a language and letters; rows of `exclude` (default: held out) are not read."""
    exclude = held_out(key) if exclude is None else exclude
    labelled = docs.where(~exclude & F.col(lang).isNotNull())
    named = labelled.groupBy(F.col(lang).alias("__lang")).count().orderBy(F.desc("count"), "__lang").limit(MAX_LANGUAGES)
    by_hash = Window.partitionBy("__lang").orderBy(F.xxhash64("__id"), "__id")
    ids = labelled.select(F.col(key).alias("__id"), F.col(lang).alias("__lang")).join(F.broadcast(named), "__lang")
    # Hashes in the lowest part of their range, about four times as many as wanted, before rows of a language meet in one task.
    lowest = F.xxhash64("__id") / float(1 << 64) + 0.5 <= F.lit(4.0 * ROWS_PER_LANGUAGE) / F.col("count")
    # Bounded by MAX_LANGUAGES * ROWS_PER_LANGUAGE.
    ids = ids.where(lowest).withColumn("__rank", F.row_number().over(by_hash)).where(F.col("__rank") <= ROWS_PER_LANGUAGE).select("__id", "__lang").distinct()
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL")
    sample = rows.join(F.broadcast(ids), (rows["__id"] == ids["__id"]) & (rows["lang"] == ids["__lang"])).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(gram_counts(t), n) for t, n in zip(texts, names) if has_letter(t)]
            terms = [np.flatnonzero(c).astype(np.uint16) for c, _ in out]
            yield pa.record_batch([
                pa.array([t.tobytes() for t in terms], pa.binary()),
                pa.array([c[t].tobytes() for (c, _), t in zip(out, terms)], pa.binary()), pa.array([n for _, n in out], pa.string()),
            ], ["terms", "counts", "lang"])

    # Repeated ids could make the join larger than the list of ids.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("terms", "counts"), "terms", "counts")
    grams = sample.mapInArrow(count, "terms binary, counts binary, lang string").withColumn("rank", F.row_number().over(order))
    kept = grams.where(F.col("rank") <= ROWS_PER_LANGUAGE).orderBy("lang", "rank").collect()
    counts = np.zeros((len(kept), BUCKETS), np.float32)
    for i, row in enumerate(kept):
        counts[i, np.frombuffer(row["terms"], np.uint16)] = np.frombuffer(row["counts"], np.float32)
    return fit_model(counts, [row["lang"] for row in kept])


def predict_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (cosine of the nearest centroid, 0 to 1), rejected.

    `lang_pred` is the nearest learned language even where `rejected` says that the text is too far from it; null and
    empty texts and texts without letters are `und` with score 0, and so is everything if no row has a language.
    Prediction reads the text alone. Repeated rows are all kept; an empty table gives no rows.
    """
    # Arrays travel as a plain dictionary: executors need no copy of the package.
    fitted = docs.sparkSession.sparkContext.broadcast(vars(learn(docs, key, text, lang)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**fitted.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(at, BLOCK_ROWS)
                names, scores, rejected = model.predict(block.column(1).to_pylist())
                yield pa.record_batch(
                    [block.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    predicted = rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
    return predicted.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
