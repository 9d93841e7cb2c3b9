"""Records of quoted CSV files, cut by many tasks although line breaks inside quotes are data.

A task reads the lines of one split and cannot know whether it begins inside quotes. So a first pass finds, for both cases, in
which state each split ends; the states are chained per file, one small row a split; a second pass cuts every split with its
true state. Only records that cross splits are put together by a shuffle.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrum.session import materialize, table_bytes

#: A longer record is taken for an unbalanced quote and refused.
MAX_RECORD_CHARS = 1 << 25
#: Largest table of splits that is sent to every task.
BROADCAST_BYTES = 32 << 20


def _open_pattern(sep: str) -> re.Pattern:
    """Lines that, begun outside quotes, end inside them. A quote counts at the start of a field only; two are one inside quotes."""
    s = re.escape(sep)
    return re.compile(rf'(?:(?:"(?:[^"]++|"")*+"[^{s}]*+|[^"{s}][^{s}]*+)?{s})*+"(?:[^"]++|"")*+')


def _ends_open(line: str, inside: bool, pattern: re.Pattern) -> bool:
    if '"' not in line:
        return inside
    return pattern.fullmatch('"' + line if inside else line) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line): the lines of each split in their order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, list[str], pa.RecordBatch]]:
    """Runs of lines of one split: its (file, block), the number of the first of them, the lines."""
    current, number = None, 0
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        lines, start = batch.column(2).to_pylist(), 0
        while start < len(keys):
            end = start + 1
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if keys[start] != current:
                current, number = keys[start], 0
            yield current, number, lines[start:end], batch.slice(start, end - start)
            number += end - start
            start = end


def _split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, from_outside, from_inside, closes): whether a split ends inside quotes, by how it begins, and whether the record
    that was open at its beginning ends in it."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, found = _open_pattern(sep), {}
        for key, _, part, _ in _splits(batches):
            outside, inside, closes = found.get(key, (False, True, False))
            for line in part:
                outside, inside = _ends_open(line, outside, pattern), _ends_open(line, inside, pattern)
                closes = closes or not inside
            found[key] = outside, inside, closes
        rows = [(*k, *v) for k, v in found.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "block", "from_outside", "from_inside", "closes"])

    return lines.mapInArrow(find, "file string, block long, from_outside boolean, from_inside boolean, closes boolean")


def _chained(states: DataFrame) -> DataFrame:
    """(file, block, inside, begun): how each split really begins, and in which split the record open there began."""
    def chain(file: pa.Table) -> pa.Table:  # one row a split of one file
        file = file.sort_by("block")
        out, inside, begun = [], False, None
        for r in file.to_pylist():
            out.append((r["file"], r["block"], inside, begun))
            ends = r["from_inside"] if inside else r["from_outside"]
            if ends and (not inside or r["closes"]):
                begun = r["block"]
            inside, begun = ends, begun if ends else None
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64())
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(zip(("file", "block", "inside", "begun"), kinds))})

    return states.groupBy("file").applyInArrow(chain, "file string, block long, inside boolean, begun long")


def read_records(spark: SparkSession, path: str, sep: str = ",", max_chars: int = MAX_RECORD_CHARS) -> DataFrame:
    """(file, block, line, record): every record of the CSV files under `path` as one text, without its line end; `file`, `block` (where
    its split begins) and `line` order the records. Empty lines are left out, and a byte order mark of a file.

    Lines end in a line feed, alone or after a carriage return. A record of more than `max_chars` characters stops the read.
    """
    lines = _lines(spark, path)
    begins = materialize(_chained(_split_states(lines, sep)), "csv-splits")
    if table_bytes(begins) <= BROADCAST_BYTES:
        joined = lines.join(F.broadcast(begins), ["file", "block"])
    else:  # a shuffle loses the order of the lines: it is restored within each split
        numbered = lines.withColumn("at", F.monotonically_increasing_id()).join(begins, ["file", "block"])
        joined = numbered.repartition("file", "block").sortWithinPartitions("file", "block", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, and the pieces of those that cross splits, under the split in which they began."""
        pattern, key, inside, home, first, parts, size = _open_pattern(sep), None, False, None, 0, [], 0
        out: list[tuple] = []

        def piece(closed: bool) -> None:
            # A piece at the beginning of a split belongs to a record that began before; one that stays open goes on after it.
            whole = closed and home == key[1]
            out.append((key[0], home, first, None if whole else key[1], "\n".join(parts)))

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            batch = pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["file", "block", "line", "piece", "record"])
            out.clear()
            return batch

        for split, number, part, batch in _splits(batches):
            if split != key:
                if key is not None and parts:
                    piece(False)
                key, parts, size = split, [], 0
                inside, home = batch.column(3)[0].as_py(), batch.column(4)[0].as_py()
                first = -1
            for at, line in enumerate(part, number):
                if not parts and not inside:
                    home, first = key[1], at
                parts.append(line)
                size += len(line) + 1
                if size > max_chars:
                    raise ValueError(f"a record of more than {max_chars} characters: is a quote missing?")
                inside = _ends_open(line, inside, pattern)
                if not inside:
                    piece(True)
                    parts, size = [], 0
            yield flush()
        if parts:
            piece(False)
        yield flush()

    schema = "file string, block long, line long, piece long, record string"
    cuts = materialize(joined.select("file", "block", "line", "inside", "begun").mapInArrow(cut, schema), "csv-records")
    crossing = cuts.where("piece IS NOT NULL").groupBy("file", "block").agg(
        F.max("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "record"))), lambda p: p["record"]), "\n").alias("record"))
    whole = cuts.where("piece IS NULL").select("file", "block", "line", "record").unionByName(crossing.select("file", "block", "line", "record"))
    top = (F.col("block") == 0) & (F.col("line") == 0)
    record = F.regexp_replace(F.when(top, F.ltrim("record", F.lit("\ufeff"))).otherwise(F.col("record")), "\r$", "")
    return whole.select("file", "block", "line", record.alias("record")).where("record <> ''")
