"""Runs a query and its oracle SQL and compares rows regardless of order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("n", "nan") if math.isnan(v) else ("f", repr(v))
    return (type(v).__name__, v)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql) -> str | None:
    """None when equal, else a short account of the first difference."""
    got_cols, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_cols, want = _sorted_rows([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}; first {got[:1]} / {want[:1]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} != {w}"
    return None
