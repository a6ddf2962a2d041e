"""Runs a registered query and its SQL twin and compares them cell by cell."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, datetime) and value.time() == datetime.min.time():
        return value.date()
    return value


def _sort_key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(frame, connection, text: str) -> str | None:
    """None where rows, column names and values agree, else what differs."""
    columns = sorted(frame.columns)
    result = connection.execute(text)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = sorted(
        (tuple(_plain(row[i]) for i in order) for row in result.fetchall()), key=_sort_key
    )
    ours = sorted(
        (tuple(_plain(row[c]) for c in columns) for row in frame.collect()), key=_sort_key
    )
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for a, b in zip(ours, theirs):
        for column, x, y in zip(columns, a, b):
            if isinstance(x, float) and isinstance(y, (int, float)):
                same = x == y or (math.isnan(x) and math.isnan(y))
            elif isinstance(x, date) or isinstance(y, date):
                same = x == y
            else:
                same = x == y
            if not same:
                return f"{column}: {x!r} against {y!r} in {a} / {b}"
    return None
