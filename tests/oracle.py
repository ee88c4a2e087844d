"""Compares a Spark result with DuckDB's."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None if v is None else "nan"
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return int(f) if f.is_integer() else f
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def compare(df, con, sql: str) -> str | None:
    """What differs, or None."""
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    at = [cols.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
    return None if got else "no rows"
