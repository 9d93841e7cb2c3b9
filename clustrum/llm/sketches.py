"""Fixed-size arrays over all keys of a table, merged slice by slice on the executors."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64
#: Rows whose keys are made at a time.
BLOCK_ROWS = 1000
_SCHEMA = "slice int, data binary"


def _count_planes(counts: np.ndarray) -> bytes:
    """Byte planes of 32-bit counts: the planes of zeros shrink to nothing when a shuffle compresses them."""
    return np.minimum(counts, 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _sliced(
    df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int, kind: type, take: Callable, encode: Callable,
    decode: Callable, merge: Callable,
) -> list[bytes]:
    """Each task takes the first `bits` bits of all its keys into one array of `kind` and sends it in SLICES parts; each part is
    merged as a stream."""
    width = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, kind)
        for batch in (b.slice(at, BLOCK_ROWS) for b in batches for at in range(0, b.num_rows, BLOCK_ROWS)):
            take(total, (keys_of(batch) >> np.uint64(64 - bits)).astype(np.int64))
        for i in range(SLICES):
            part = encode(total[i * width:(i + 1) * width])
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([part], pa.binary())], ["slice", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                merged[at] = merge(merged[at], decode(data)) if at in merged else decode(data)
        if merged:
            yield pa.record_batch(
                [pa.array(list(merged), pa.int32()), pa.array([encode(v) for v in merged.values()], pa.binary())], ["slice", "data"])

    parts = [encode(np.zeros(width, kind))] * SLICES
    for row in df.mapInArrow(count, _SCHEMA).repartition(SLICES, "slice").mapInArrow(add, _SCHEMA).collect():
        parts[row["slice"]] = bytes(row["data"])
    return parts


def bucket_counts(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """How many keys of `df` begin with each value of `bits` bits (32-bit counts, held at their maximum).

    `keys_of` gives the unsigned 64-bit keys of a batch. The driver gets 4 * 2^bits bytes, whatever the size of the table.
    """
    def take(total: np.ndarray, buckets: np.ndarray) -> None:
        seen, counts = np.unique(buckets, return_counts=True)
        total[seen] += counts.astype(np.uint32)

    parts = _sliced(df, keys_of, bits, np.uint32, take, _count_planes, _from_planes, np.add)
    return np.concatenate([_from_planes(p) for p in parts]).astype(np.uint32)


def bucket_bits(df: DataFrame, keys_of: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """Packed bits: whether any key begins with each value of `bits` bits. The driver gets 2^bits bits."""
    def take(total: np.ndarray, buckets: np.ndarray) -> None:
        total[buckets] = True

    parts = _sliced(
        df, keys_of, bits, np.bool_, take, lambda v: np.packbits(v).tobytes(), lambda d: np.unpackbits(np.frombuffer(d, np.uint8)), np.bitwise_or)
    return np.frombuffer(b"".join(parts), np.uint8)


def is_set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indices of the values in `at` whose bit is set."""
    return np.flatnonzero((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
