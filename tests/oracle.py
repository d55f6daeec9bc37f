"""Compares queries with their SQL run by DuckDB, and runs any query over a folder."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, query, sql: str, folder: str) -> tuple[int, str]:
    """Row count and '' where both sides agree, else what differs."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duck(folder)
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(got), f"{name}: columns {sorted(df.columns)} and {sorted(cols)}"
    if got != want:
        g, w = set(map(repr, got)), set(map(repr, want))
        return len(got), f"{name}: {len(got)} and {len(want)} rows; only Spark {sorted(g - w)[:3]}; only SQL {sorted(w - g)[:3]}"
    return len(got), ""
