"""Runs registered queries and their SQL side by side."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def sort_key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=sort_key)


def difference(spark, con, fn, sql, sf_dir) -> str | None:
    """What differs between the query and its SQL, or None."""
    df = fn(spark, sf_dir)
    got_names, got = lines(df.columns, [tuple(r) for r in df.collect()])
    found = con.sql(sql)
    want_names, want = lines(found.columns, found.fetchall())
    if got_names != want_names:
        return f"columns {got_names} against {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} against {b}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types of {a} against {b}"
    return None
