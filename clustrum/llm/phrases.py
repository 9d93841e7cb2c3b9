"""Phrases of two to four words that score high as collocations, mined by SON partitioning.

Texts are dealt into shards. Each shard is mined completely: a phrase that is frequent in the corpus has in at least one shard
its share of the support by that shard's share of the words, so the shard's support is the corpus support lowered in
proportion, rounded up. The union of the locally frequent phrases holds all frequent ones; a second pass over all texts
counts its members exactly. A shard is mined by many tasks, each on one range of phrase hashes; hashes only choose
candidates, counts are kept by the phrases themselves.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustrum.llm.common import binary_column, broadcast_if_small, mix
from clustrum.llm.sketches import bucket_bits, is_set
from clustrum.session import materialize

MAX_WORDS = 4
#: Shards of the first pass: more of them lower the local support further, fewer give each task less to drop.
SHARDS = 6
#: Characters of texts whose phrases a task counts at a time, and phrase hashes it holds before it sends them on.
BLOCK_BYTES, HELD_HASHES = 1 << 21, 3 << 19
#: Rows whose texts a task takes out of an Arrow batch at a time.
BATCH_ROWS = 500
#: Phrase occurrences for each range of hashes: a task merges those of one range of one shard at a time.
RANGE_OCCURRENCES = 1 << 22
#: Largest table of candidate bits, 2^28 bits or 32 MB; with more candidates it lets more other phrases through to the exact count.
MAX_BITS = 28
_NONE, _BREAK = 0, 1
_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c == 9 else 10 if 10 <= c <= 13 or c in b".,;:!?" else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _segments(texts: list[bytes | None], groups: list[int]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Blocks of texts of about BLOCK_BYTES, A-Z lower-cased, pieces ended by line feeds; longer texts are cut between pieces."""
    block, of, size = [], [], 0
    for text, group in zip(texts, groups):
        text = (text or b"").translate(_BYTES)
        start = 0
        while start < len(text):
            end = len(text) if len(text) - start <= BLOCK_BYTES else text.find(b"\n", start + BLOCK_BYTES)
            end = len(text) if end < 0 else end
            block.append(text[start:end])
            of.append(group)
            size += end - start
            start = end
            if size >= BLOCK_BYTES:
                yield block, of
                block, of, size = [], [], 0
    if block:
        yield block, of


class _Block:
    """Words of a block as numbers, and its distinct phrases per group with their counts."""

    def __init__(self, texts: list[bytes], groups: list[int]):
        numbers = _Ids({b"": _NONE, b"\n": _BREAK})
        parts = []
        for text in texts:
            words = (text + b"\n").replace(b"\n", b" \n ").split(b" ")
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        ids = np.concatenate(parts)
        group = np.repeat(np.array(groups, np.int64), [len(p) for p in parts])
        kept = ids != _NONE
        self.ids, self.group, self.words = ids[kept], group[kept], list(numbers)

    def counts(self, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from 1: groups and word numbers of the distinct phrases, and how often each occurs."""
        ids, width = self.ids, np.int64(len(self.words))
        at = np.flatnonzero(ids > _BREAK)
        place = np.full(len(ids), -1, np.int64)
        for n in range(1, max_words + 1):
            if n > 1:
                at = at[(place[at] >= 0) & (at + n - 1 < len(ids))]
                at = at[ids[at + n - 1] > _BREAK]
            last = ids[at + n - 1]
            code = (self.group[at] if n == 1 else place[at]) * width + last
            _, first, inverse, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            place[:] = -1
            place[at] = inverse
            first = at[first]
            yield n, self.group[first], ids[first[:, None] + np.arange(n)], count

    def hashes(self, words: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """64-bit hashes of phrases, one seed each."""
        if not hasattr(self, "word_hash"):
            self.word_hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        out = seeds.copy()
        for k in range(words.shape[1]):
            out = mix(out * _STEP + self.word_hash[words[:, k]])
        return out

    def phrases(self, words: np.ndarray) -> list[bytes]:
        return list(map(b" ".join, zip(*([self.words[i] for i in words[:, k].tolist()] for k in range(words.shape[1])))))


def _grouped(batch: pa.RecordBatch) -> tuple[list[tuple], list[int]]:
    """The distinct (lang, shard) of a batch and the number of each row's."""
    numbers = _Ids()
    rows = [numbers[pair] for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    return list(numbers), rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray, _Block]]:
    """(lang, shard) pairs, seed of each by language alone, and block, for batches of (lang, shard, text)."""
    for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
        pairs, rows = _grouped(batch)
        seeds = np.array([xxhash.xxh3_64_intdigest(lang.encode()) for lang, _ in pairs], np.uint64)
        for texts, groups in _segments(binary_column(batch, "text"), rows):
            yield pairs, seeds, _Block(texts, groups)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as steps, and their counts, in byte planes: the planes of zeros shrink when a shuffle compresses them."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in (steps, counts.astype("<u4"))]
    return b"".join(planes)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    whole = lambda part, kind: np.ascontiguousarray(np.frombuffer(part, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()
    return np.cumsum(whole(data[:8 * n], "<u8"), dtype=np.uint64), whole(data[8 * n:], "<u4").astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _word_counts(texts: DataFrame) -> DataFrame:
    """(lang, shard, word, count): occurrences of each word of a language, shard null; of all words of a shard, word null."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs, _, block in _blocks(batches):
            _, group, words, counts = next(block.counts(1))
            totals = np.bincount(group, counts, len(pairs)).astype(np.int64)
            yield pa.record_batch([
                pa.array([pairs[g][0] for g in group.tolist()] + [lang for lang, _ in pairs], pa.string()),
                pa.array([None] * len(group) + [shard for _, shard in pairs], pa.int32()),
                pa.array(block.phrases(words) + [None] * len(pairs), pa.binary()).cast(pa.string()),
                pa.array(np.concatenate([counts, totals]).tolist(), pa.int64()),
            ], ["lang", "shard", "word", "count"])

    rows = texts.mapInArrow(count, "lang string, shard int, word string, count long")
    return rows.groupBy("lang", "shard", "word").agg(F.sum("count").alias("count"))


def _locally_frequent(texts: DataFrame, supports: DataFrame, ranges_log2: int, max_words: int) -> DataFrame:
    """(hash): distinct hashes of the phrases that reach the support of a shard (lang, shard, support) in it."""
    def send(held: dict) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (lang, shard), parts in held.items():
            keys, counts = _summed(*map(np.concatenate, zip(*parts)))
            cuts = np.searchsorted(keys, np.arange(1, 1 << ranges_log2, dtype=np.uint64) << np.uint64(64 - ranges_log2)) if ranges_log2 else []
            for part, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts))):
                if len(k):
                    out.append((lang, shard, part, _packed(k, c)))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.binary()))],
                                  ["lang", "shard", "part", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for pairs, seeds, block in _blocks(batches):
            for n, group, words, counts in block.counts(max_words):
                if n == 1:
                    continue
                keys = block.hashes(words, seeds[group])
                order = np.argsort(group, kind="stable")
                cuts = np.searchsorted(group[order], np.arange(1, len(pairs)))
                for pair, rows in zip(pairs, np.split(order, cuts)):
                    if len(rows):
                        held.setdefault(pair, []).append((keys[rows], counts[rows]))
                size += len(keys)
            if size >= HELD_HASHES:
                yield from send(held)
                held, size = {}, 0
        yield from send(held)

    def mine(group: pa.Table) -> pa.Table:
        keys, counts = _summed(*map(np.concatenate, zip(*map(_unpacked, group["data"].to_pylist()))))
        return pa.table({"hash": keys[counts >= group["support"][0].as_py()].view(np.int64)})

    counted = texts.mapInArrow(count, "lang string, shard int, part int, data binary")
    return (
        counted.join(supports, ["lang", "shard"]).groupBy("lang", "shard", "part").applyInArrow(mine, "hash long")
        .distinct()
    )


def _exact_counts(texts: DataFrame, bits: np.ndarray, max_words: int) -> DataFrame:
    """(lang, words, phrase, count) of the phrases whose hash the table of candidates holds, over all texts."""
    table = texts.sparkSession.sparkContext.broadcast(bits)
    shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs, seeds, block in _blocks(batches):
            for n, group, words, counts in block.counts(max_words):
                if n == 1:
                    continue
                taken = is_set(table.value, (block.hashes(words, seeds[group]) >> shift).astype(np.int64))
                yield pa.record_batch([
                    pa.array([pairs[g][0] for g in group[taken].tolist()], pa.string()), pa.array([n] * len(taken), pa.int32()),
                    pa.array(block.phrases(words[taken]), pa.binary()).cast(pa.string()), pa.array(counts[taken], pa.int64()),
                ], ["lang", "words", "phrase", "count"])

    rows = texts.mapInArrow(count, "lang string, words int, phrase string, count long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("count").alias("a"))


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 30, max_words: int = MAX_WORDS, shards: int = SHARDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (lang, words, phrase, a) of 2 to `max_words` words that occur `min_count` times or more in a language; words
    (lang, word, f) that do; and words in all (lang, n).

    Null texts are empty; a null language is `und`; equal rows count as often as they stand. Texts are cut into pieces at
    ``.,;:!?`` and line breaks, pieces into words at blanks and tabs.
    """
    texts = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64(F.col(text)), F.lit(shards)).cast("int").alias("shard"), F.col(text).alias("text"))
    counted = materialize(_word_counts(texts).where(F.col("shard").isNotNull() | (F.col("count") >= min_count)), "words")
    per_shard = counted.where("shard IS NOT NULL AND count > 0")
    totals = materialize(per_shard.groupBy("lang").agg(F.sum("count").alias("n")), "totals")
    # The share of the support, rounded up: n_shard * min_count / n.
    share = F.expr(f"CAST((CAST(count AS DECIMAL(28,0)) * {min_count} + n - 1) DIV n AS LONG)")
    supports = materialize(per_shard.join(totals, "lang").select("lang", "shard", F.greatest(share, F.lit(1)).alias("support")), "supports")
    occurrences = (totals.agg(F.sum("n")).first()[0] or 0) * (max_words - 1)
    ranges = max(0, (occurrences // (shards * RANGE_OCCURRENCES)).bit_length())
    local = materialize(_locally_frequent(texts, broadcast_if_small(supports), ranges, max_words), "candidates")
    n_bits = min(MAX_BITS, max(10, (local.count() * 16).bit_length()))
    bits = bucket_bits(local, lambda b: b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), n_bits)
    exact = materialize(_exact_counts(texts, bits, max_words).where(F.col("a") >= min_count), "phrases")
    return exact, counted.where("shard IS NULL").select("lang", "word", F.col("count").alias("f")), totals


def _part(start: str, length: str) -> F.Column:
    return F.expr(f"array_join(slice(w, {start}, {length}), ' ')")


def score_phrases(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """`phrases` with l, r and score of the cut that scores least (of equal ones the earliest).

    The score of a cut is 2000000 * a / (l + r), floored, with the counts l and r of its parts, in exact decimals. A part of
    a frequent phrase is frequent itself, so both parts are found among `phrases` and `words`.
    """
    cuts = phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "words", "k", _part("1", "k").alias("first"), _part("k + 1", "words - k").alias("rest"))
    known = broadcast_if_small(materialize(
        words.select("lang", F.col("word").alias("part"), "f").unionAll(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))),
        "parts"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.withColumnsRenamed({"part": part, "f": name}), ["lang", part])
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) DIV (CAST(l AS DECIMAL(20,0)) + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "words", "phrase", "a", "best.l", "best.r", "best.score")


def without_parts(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """`phrases` without those that lie inside a longer one of `phrases` that occurs `percent` times in a hundred as often."""
    w = phrases.select("lang", "words", "a", F.split("phrase", " ").alias("w")).where("words > 2")
    inside = w.withColumn("length", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn(
        "start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)))
    longer = inside.select("lang", _part("start", "length").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.expr(f"CAST(longer AS DECIMAL(20,0)) * 100 >= CAST(a AS DECIMAL(20,0)) * {percent}")
    return phrases.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("longer")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 30, first: int = 2000, max_words: int = MAX_WORDS,
    shards: int = SHARDS,
) -> DataFrame:
    """The `first` phrases of each language: lang, rank, phrase, a, l, r, n, score; by score and a, both falling, then phrase.

    Languages without a frequent phrase and empty tables give no rows. Every count covers all texts. Further columns are
    not read. Intermediate tables are written to the shared folder.
    """
    phrases, words, totals = frequent_phrases(docs, text, lang, min_count, max_words, shards)
    scored = without_parts(score_phrases(phrases, words)).join(broadcast_if_small(totals), "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
