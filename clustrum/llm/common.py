"""Table access, scratch tables and word hashing shared by the operators of this subpackage."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE_WORDS = 5
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows that no classifier may learn from: crc32 of the id as text leaves 1 modulo 3."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def broadcast_if_small(written: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """`written` with a broadcast hint only if its rows, counted in full, fit into `max_bytes`; else a plain join side.

    Bytes are counted as the text of all columns. The table should be written out: it is read once to be measured.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in written.columns), F.lit(0))
    total = written.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(written) if total <= max_bytes else written


def binary_column(batch: pa.RecordBatch, name: str) -> list:
    """UTF-8 bytes (or None) of a text column of an Arrow batch."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each input bit over all output bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of `size` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= _MULTIPLIER
        out += hashes[k:k + n]
    return mix(out + np.uint64(size))


def shingle_set(words: list[bytes], size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of all `size`-word shingles; fewer words form one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.sort(window_hashes(word_hashes(words), min(size, len(words))))
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]
