"""Quoted CSV files read by many tasks: the records of a plain reader, whatever the splits."""
import csv
import io
import random

import pytest

from clustrum.operators.cleaning import ContractError
from clustrum.sources import records, reviews

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.files.openCostInBytes")}
    spark.conf.set(SPLIT, "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def rows_of(seed, n=90):
    rng = random.Random(seed)
    pieces = ["a", 'say ""hi""', "two\nlines", ",", "é", "\n\n", '""', " x ", "", "long " * 20]
    return [[f"r{i}", "".join(rng.choice(pieces).replace('""', '"') for _ in range(rng.randrange(0, 6))) + "t", rng.choice(["", "5\" pipe", "k"])] for i in range(n)]


def as_csv(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed", [1, 2])
def test_records_of_many_splits_equal_a_plain_reader(spark, tmp_path, small_splits, seed):
    rows = [["id", "text", "more"], *rows_of(seed)]
    (tmp_path / "one.csv").write_text(as_csv(rows))
    lines = records._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 8
    header, fields = reviews.read_fields(spark, str(tmp_path))
    assert header == rows[0]
    found = sorted(fields.collect(), key=lambda r: (r._file, r._block, r._line))
    assert [[r._f0, r._f1, r._f2 or ""] for r in found] == rows[1:] and not any(r._bad for r in found)


def test_splits_beyond_the_broadcast_give_the_same(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(records, "BROADCAST_BYTES", 0)
    rows = rows_of(3, 40)
    (tmp_path / "one.csv").write_text(as_csv(rows))
    found = sorted(records.read_records(spark, str(tmp_path)).collect(), key=lambda r: (r.block, r.line))
    assert [next(csv.reader(io.StringIO(r.record, newline=""))) for r in found] == rows


def test_strict_reader_over_splits_keeps_rows_order_and_refusals(spark, tmp_path, small_splits):
    rows = rows_of(4, 60)
    (tmp_path / "good.csv").write_text("﻿" + as_csv([["", "commentaire", "k"], *rows]), encoding="utf-8")
    out = reviews.read_reviews_strict(spark, str(tmp_path / "good.csv")).orderBy("source_row_index").collect()
    assert [(r.source_row_id, r.text) for r in out] == [(r[0], r[1]) for r in rows] and [r.source_row_index for r in out] == list(range(60))
    for fault in ("r0,again,k\n", "short\n", "a,b,c,d\n", "z,  ,k\n", ",text,k\n", '"open quote,x\n'):
        (tmp_path / "bad.csv").write_text(as_csv([["", "commentaire", "k"], *rows]) + fault)
        with pytest.raises(ContractError):
            reviews.read_reviews_strict(spark, str(tmp_path / "bad.csv"))


def test_carriage_returns_empty_lines_and_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'id,text\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    (tmp_path / "b.csv").write_bytes(b"id,text\n3,w")
    _, fields = reviews.read_fields(spark, str(tmp_path))
    assert sorted((r._f0, r._f1.replace("\r", "")) for r in fields.collect()) == [("1", "x\ny"), ("2", "z"), ("3", "w")]


def test_an_endless_record_stops_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"' + "x\n" * 200)
    with pytest.raises(Exception, match="is a quote missing"):
        records.read_records(spark, str(tmp_path), max_chars=100).collect()


@pytest.mark.parametrize("line", [
    "plain", '"a', '"a"', 'a,"b', 'a",b', '5" x,"y ""z', '"a""', '"",""', 'x"', '"a,b', '",', 'a"b","c', '"a"b,"c', '""', '"""', ',,"',
])
def test_states_of_a_line(line):
    def plain(text, open_):
        """A reader that looks at one character after the other."""
        state, i = ("quoted" if open_ else "start"), 0
        while i < len(text):
            c = text[i]
            if state == "quoted":
                if c == '"' and text[i + 1:i + 2] == '"':
                    i += 1
                elif c == '"':
                    state = "after"
            elif c == ",":
                state = "start"
            elif state == "start" and c == '"':
                state = "quoted"
            else:
                state = "field"
            i += 1
        return state == "quoted"

    pattern = records._open_pattern(",")
    assert (records._ends_open(line, False, pattern), records._ends_open(line, True, pattern)) == (plain(line, False), plain(line, True))
