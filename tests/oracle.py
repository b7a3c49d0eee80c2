"""Compare a query's Spark rows with its DuckDB oracle, ignoring row and column order."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set enable_progress_bar = false")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        x = float(value)
        return "nan" if math.isnan(x) else repr(0.0 if x == 0 else x)
    if isinstance(value, datetime.datetime) and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty when equal."""
    rel = con.execute(sql)
    oracle_cols = [d[0] for d in rel.description]
    if sorted(oracle_cols) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs oracle {sorted(oracle_cols)}"]
    want = rows_of(oracle_cols, rel.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return [f"{len(got)} rows vs oracle {len(want)}", f"got {got[:2]}", f"want {want[:2]}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return [f"{len(bad)} of {len(got)} rows differ", *[f"got {g}\n    want {w}" for g, w in bad[:3]]] if bad else []
