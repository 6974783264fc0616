"""Compares a query with its SQL in DuckDB as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return v


def duck(data_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(data_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return con


def difference(df, sql: str, data_dir: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    cols = sorted(df.columns)
    ours = Counter(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    with duck(data_dir) as con:
        got = con.execute(sql)
        names = [x[0] for x in got.description]
        if sorted(names) != cols:
            return f"columns {cols} and {sorted(names)}"
        at = [names.index(c) for c in cols]
        theirs = Counter(tuple(_cell(r[i]) for i in at) for r in got.fetchall())
    if ours == theirs:
        return ""
    a, b = ours - theirs, theirs - ours
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list(a.items())[:3]}; only SQL {list(b.items())[:3]}"
