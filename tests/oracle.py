"""Compare a query with its SQL on the same parquet tables."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{d}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(v)
    return v if v is None else str(v)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when names and rows agree, else a short description."""
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = _rows(got_cols, got), _rows(want_cols, want)
    if len(a) != len(b):
        extra, lack = set(a) - set(b), set(b) - set(a)
        return f"{len(a)} rows != {len(b)}; extra {list(extra)[:3]} lacking {list(lack)[:3]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else None
