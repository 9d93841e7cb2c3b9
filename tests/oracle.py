"""Runs a registered query and its SQL on the same tables and compares rows, names, types and values."""
from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(sf: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def differences(df, sql: str, connection) -> list[str]:
    names = sorted(df.columns)
    relation = connection.sql(sql)
    found = []
    if sorted(relation.columns) != names:
        return [f"columns {names} != {sorted(relation.columns)}"]
    types = dict(zip(relation.columns, map(str, relation.types)))
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != types[name]:
            found.append(f"type of {name}: {kind} != {types[name]}")
    mine = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    at = [relation.columns.index(n) for n in names]
    theirs = [tuple(_plain(r[i]) for i in at) for r in relation.fetchall()]
    if len(mine) != len(theirs):
        found.append(f"rows {len(mine)} != {len(theirs)}")
    left, right = sorted(mine, key=repr), sorted(theirs, key=repr)
    if left != right:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        found.append(f"values of {names}: only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}")
    return found
