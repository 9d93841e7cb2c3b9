"""Text quality by votes of the nearest labelled documents in a latent-semantic space.

Terms are words (hashed), triples of character classes (letters, capitals, digits, blanks, each kind of punctuation) and
shares of repetition. TF-IDF vectors of a bounded labelled sample are reduced by a truncated SVD; each document is projected,
compared by cosine with every labelled vector in blocks of one matrix product, and scored by its nearest neighbours'
labels, weighted by similarity.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clustrum.llm.common import binary_column, held_out

#: At most this many labelled rows are learned from, those with the smallest hash of the id.
SAMPLE_ROWS = 4000
DIMENSIONS = 96
NEIGHBOURS = 30
SHARPNESS = 4.0
WORD_BUCKETS = 4096
BLOCK_ROWS = 256

# Character classes: small letters and all non-ASCII bytes 0, capitals 1, digits 2, then one for each mark below, the rest last.
MARKS = b" \n.,!?|*$#%&@-_/\\:;=+'\"()[]{}<>~^"
CLASSES = len(MARKS) + 4
_CLASS_OF = bytes(
    1 if 65 <= c <= 90 else 0 if c >= 128 or 97 <= c <= 122 else 2 if 48 <= c <= 57
    else 3 + MARKS.index(c) if c in MARKS else CLASSES - 1 for c in range(256))
WIDTH = CLASSES ** 3 + WORD_BUCKETS
REPEATS = 3


def term_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms with their counts, and the shares of repeated neighbouring words, of repeated words and of repeated lines."""
    if not text:
        return np.empty(0, np.int32), np.empty(0, np.float32), np.zeros(REPEATS, np.float32)
    classes = np.frombuffer(text.translate(_CLASS_OF), np.uint8).astype(np.int32)
    triples = np.bincount((classes[:-2] * CLASSES + classes[1:-1]) * CLASSES + classes[2:]) if len(classes) > 2 else np.empty(0, np.int64)
    seen = np.flatnonzero(triples)
    words = text.lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    buckets = np.bincount((hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=WORD_BUCKETS)
    used = np.flatnonzero(buckets)
    lines = [line for line in text.split(b"\n") if line.strip()]
    n = max(1, len(words))
    repeats = np.array([
        np.count_nonzero(hashes[1:] == hashes[:-1]) / n,
        # Long texts repeat words anyhow: distinct words are held against the square root of the length.
        max(0.0, 1 - len(np.unique(hashes)) / min(n, 4 * n ** 0.5)),
        1 - len(set(lines)) / max(1, len(lines)),
    ], np.float32)
    terms = np.concatenate([seen, used + CLASSES ** 3]).astype(np.int32)
    return terms, np.concatenate([triples[seen], buckets[used]]).astype(np.float32), repeats


@dataclass
class Model:
    """Vocabulary, weights, latent axes, and the labelled vectors with their labels."""

    column_of: np.ndarray
    weights: np.ndarray
    split: int
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def tfidf(self, counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Rows with two unit parts, triples of classes and (at less weight) words, and the shares of repetition."""
        out = np.zeros((len(counted), len(self.weights) + REPEATS), np.float32)
        for row, (terms, counts, repeats) in enumerate(counted):
            columns = self.column_of[terms]
            known = columns >= 0
            out[row, columns[known]] = (1 + np.log(counts[known])) * self.weights[columns[known]]
            out[row, len(self.weights):] = repeats * 2
        for part, share in ((out[:, :self.split], 1.0), (out[:, self.split:len(self.weights)], 0.3)):
            norms = np.sqrt(np.einsum("ij,ij->i", part, part))[:, None]
            np.multiply(part, share / np.maximum(norms, 1e-12), out=part)
        return out

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = rows @ self.axes
        norms = np.sqrt((latent * latent).sum(axis=1, keepdims=True))
        return latent / np.maximum(norms, 1e-12)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, weighted by a power of the cosine; ties by row order."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        similar = self.project(self.tfidf([term_counts(t) for t in texts])) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        nearest = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, nearest, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        votes = (weight * self.labels[nearest]).sum(axis=1) / np.maximum(total, 1e-300)
        return np.clip(np.where(total > 0, votes, self.labels.mean()), 0.0, 1.0)


def truncated_svd(rows: np.ndarray, dimensions: int, rounds: int = 3) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a seeded start."""
    k = min(dimensions, *rows.shape)
    basis = np.random.default_rng(7).standard_normal((rows.shape[1], min(k + 16, *rows.shape))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, axes = np.linalg.svd(rows @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ axes[:k].T).astype(np.float32))


def fit_model(counted: list[tuple], labels: np.ndarray) -> Model:
    """Weights, axes and labelled vectors of a sample; terms of fewer than three of its rows are left out."""
    frequency = np.zeros(WIDTH, np.int64)
    for terms, *_ in counted:
        frequency[terms] += 1
    used = np.flatnonzero(frequency >= 3) if len(counted) >= 50 else np.flatnonzero(frequency)
    column_of = np.full(WIDTH, -1, np.int32)
    column_of[used] = np.arange(len(used))
    weights = (np.log((1 + len(counted)) / (1 + frequency[used])) + 0.1).astype(np.float32)
    model = Model(column_of, weights, int((used < CLASSES ** 3).sum()), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), labels)
    if len(labels):
        rows = model.tfidf(counted)
        model.axes = truncated_svd(rows, DIMENSIONS)
        model.vectors = model.project(rows)
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          sample_rows: int = SAMPLE_ROWS, exclude: Column | None = None) -> Model:
    """Model from at most `sample_rows` labelled rows; rows of `exclude` (default: held out) and null ids or labels are never read."""
    exclude = held_out(key) if exclude is None else exclude
    chosen = labels.where(~exclude & F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).alias("__id"), F.col(label).cast("double").alias("__label"))
    # Bounded by `sample_rows`.
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample_rows))
    sample = docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(chosen, "__id").select("text", "__label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [term_counts(t) for t in binary_column(batch, "text")]
            parts = [pa.array([c[i].tobytes() for c in counted], pa.binary()) for i in range(3)]
            yield pa.record_batch([*parts, batch.column(1)], ["terms", "counts", "repeats", "label"])

    rows = sample.mapInArrow(count, "terms binary, counts binary, repeats binary, label double")
    # Copies of one id could outnumber the chosen labels.
    rows = rows.orderBy(F.xxhash64("terms", "counts"), "label").limit(sample_rows).collect()
    counted = [(np.frombuffer(r.terms, np.int32), np.frombuffer(r.counts, np.float32), np.frombuffer(r.repeats, np.float32)) for r in rows]
    return fit_model(counted, np.array([r.label for r in rows], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher is likelier label 1), predicted (score >= 0.5).

    The score is a function of the whole text alone. Null and empty texts and texts that share no term with the
    sample get the share of label 1 in the sample, without labelled rows every text gets 0.5. Repeated rows are all
    kept; an empty table gives no rows; further columns are not read.
    """
    # Arrays travel as a plain dictionary: executors need no copy of the package.
    fitted = docs.sparkSession.sparkContext.broadcast(vars(learn(docs, labels, key, text, **options)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**fitted.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(at, BLOCK_ROWS)
                scores = model.scores(binary_column(block, "text"))
                yield pa.record_batch([block.column(0), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of the rows of `docs` that are predicted good; in one pass, without a join."""
    # Arrays travel as a plain dictionary: executors need no copy of the package.
    fitted = docs.sparkSession.sparkContext.broadcast(vars(learn(docs, labels, key, text, **options)))
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**fitted.value)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(start, BLOCK_ROWS)
                texts = block.column(at).cast(pa.large_binary()).to_pylist()
                yield block.filter(pa.array(model.scores(texts) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
