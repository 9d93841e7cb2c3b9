"""Passages of benchmark items inside documents: a set join on the rarest shingle of every item-sized window.

A window of an item lies in a document only if all its shingles do, so its rarest shingle is a sufficient prefix.
Documents are looked up by prefix shingles only; where one occurs, its place in the window fixes where the window would
begin and end (length and position bounds), and the words between are compared one by one.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustrum.llm.common import SHINGLE_WORDS, binary_column, broadcast_if_small, window_hashes, word_hashes
from clustrum.llm.sketches import bucket_bits, is_set
from clustrum.session import materialize

WINDOW_WORDS = 10
#: Bits of the table that picks out document shingles before the join; more bits let fewer others through.
PICK_BITS = 22
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased; none of null."""
    return text.translate(_LETTERS).split() if text else []


def _shingles(batch: pa.RecordBatch, sizes: list[int]) -> Iterator[tuple[int, list[bytes], int, np.ndarray]]:
    """Row, its words, shingle size and shingle hashes, for every row of a batch and every size."""
    for row, text in enumerate(binary_column(batch, "text")):
        words = words_of(text)
        hashes = word_hashes(words)
        for size in sizes:
            yield row, words, size, window_hashes(hashes, size)


def _top(hashes: np.ndarray, bits: int = PICK_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def item_windows(benchmark: DataFrame, item: str, text: str, window: int, shingle: int) -> DataFrame:
    """(item_id, window, n, token, at): each window's words joined by a blank, with all its shingles and their places.

    A window of fewer words than a shingle is one shingle itself. Items without words have no window.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("item_id")).to_pylist()
            out: list[tuple] = []
            for item_id, data in zip(ids, binary_column(batch, "text")):
                words = words_of(data)
                n = min(window, len(words))
                if not n:
                    continue
                size = min(shingle, n)
                tokens = window_hashes(word_hashes(words), size).view(np.int64)
                for start in range(len(words) - n + 1):
                    passage = b" ".join(words[start:start + n])
                    out += [(item_id, passage, n, size, int(tokens[start + k]), k) for k in range(n - size + 1)]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.record_batch([
                pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32()),
                pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int32()),
            ], ["item_id", "passage", "n", "size", "token", "at"])

    items = benchmark.select(F.col(item).cast("string").alias("item_id"), F.col(text).alias("text"))
    return items.mapInArrow(cut, "item_id string, passage binary, n int, size int, token long, at int")


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS,
) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit (words inside a window that occurs), n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; null item ids are left out of the list of items; repeated rows are all
    kept; an empty benchmark hits nothing; an empty table gives no rows. `items_sha256` is the digest of the item ids,
    sorted as strings and joined by commas. Further columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    windows = materialize(item_windows(benchmark, item, item_text, window, shingle), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # 1 to `shingle`

    # How often each shingle of an item occurs in all documents. Only those that the bit table lets through are counted.
    def picked(tokens: DataFrame):
        return spark.sparkContext.broadcast(bucket_bits(
            tokens, lambda b: b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), PICK_BITS))

    all_bits = picked(windows.select("token"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h[is_set(all_bits.value, _top(h))] for *_, h in _shingles(batch, sizes) if len(h)]
            tokens, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(counts)], ["token", "count"])

    counted = docs.select("text").mapInArrow(occurrences, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    rarity = windows.select("token").distinct().join(counted, "token", "left").select("token", F.coalesce("count", F.lit(0)).alias("count"))
    # A window whose rarest shingle occurs nowhere occurs nowhere.
    ranked = windows.join(materialize(rarity, "rarity"), "token").groupBy("passage", "n", "size").agg(
        F.min(F.struct("count", "token", "at")).alias("rarest"))
    prefixes = materialize(ranked.where("rarest.count > 0").select(
        "passage", "n", F.col("rarest.token").alias("token"), F.col("rarest.at").alias("at")), "prefixes")
    prefix_bits = picked(prefixes.select("token"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and a row for each place of a probable prefix shingle, with the words around it."""
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("doc_id")), binary_column(batch, "text")
            keys = [hashlib.md5(t or b"", usedforsecurity=False).digest() for t in texts]
            rows, totals, tokens, places, left, around = [], [], [], [], [], []
            n_words = [0] * len(texts)
            for row, words, size, hashes in _shingles(batch, sizes):
                n_words[row] = len(words)
                for place in is_set(prefix_bits.value, _top(hashes)).tolist():
                    first = max(0, place - (window - size))
                    rows.append(row), totals.append(len(words)), tokens.append(hashes[place]), places.append(place)
                    left.append(place - first)
                    around.append(b" ".join(words[first:place + window]))
            n = len(texts)
            taken = ids.take(pa.array(list(range(n)) + rows, pa.int64()))
            yield pa.record_batch([
                taken, pa.array(keys + [keys[r] for r in rows], pa.binary()),
                pa.array(n_words + totals, pa.int64()),
                pa.array([None] * n + np.array(tokens, np.uint64).view(np.int64).tolist(), pa.int64()),
                pa.array([None] * n + places, pa.int32()), pa.array([None] * n + left, pa.int32()),
                pa.array([None] * n + around, pa.binary()),
            ], ["doc_id", "text_key", "n_words", "token", "place", "before", "around"])

    schema = f"doc_id {kind}, text_key binary, n_words long, token long, place int, before int, around binary"
    looked_up = materialize(docs.mapInArrow(look_up, schema), "looked-up")
    # Equal rows (same id, same text) have the same hits: they are found once.
    start = F.col("place") - F.col("at")
    words = F.split(F.col("around").cast("string"), " ", -1)
    hits = (
        looked_up.where("token IS NOT NULL").distinct().join(broadcast_if_small(prefixes), "token")
        .where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .withColumn("words", words)
        .where(F.array_join(F.slice("words", F.col("before") - F.col("at") + 1, F.col("n")), " ") == F.col("passage").cast("string"))
        .select("doc_id", "text_key", start.alias("start"), (start + F.col("n")).alias("end"), "passage")
    )
    hits = materialize(hits, "hits")
    on_text = ["doc_id", "text_key"]
    before = Window.partitionBy(*on_text).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = hits.select(*on_text, "start", "end").distinct().withColumn("covered", covered).groupBy(*on_text).agg(
        F.sum("covered").cast("long").alias("n_hit"))
    owners = materialize(windows.select("passage", "item_id").where("item_id IS NOT NULL").distinct(), "owners")
    items = hits.select(*on_text, "passage").distinct().join(broadcast_if_small(owners), "passage").groupBy(*on_text).agg(
        F.array_sort(F.collect_set("item_id")).alias("items"))
    found = materialize(n_hit.join(
        items.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "items"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left",
    ).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "n_hit", "items"), "found")
    rows = looked_up.where("token IS NULL").select(*on_text, "n_words")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "text_key",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the rows that hold a window of a benchmark item; rows are told apart by id and text digest."""
    found = contamination(docs, benchmark, key, text, **options).where("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).distinct()
    found = broadcast_if_small(materialize(found, "contaminated"))
    same_text = F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))) == F.col("__text")
    return docs.join(found, docs[key].eqNullSafe(F.col("__id")) & same_text, "left_anti").select(*docs.columns)
