"""Compare a query with its SQL on the same tables: names, row count and all values, in any order."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(v):  # noqa: ANN001, ANN201
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def compare(df, con, sql: str) -> str | None:  # noqa: ANN001
    """None if equal, else what differs."""
    cols = sorted(df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in cols) for r in (x.asDict(recursive=True) for x in df.select(*cols).collect()))
    if len(want) != len(got):
        extra = [r for r in got if r not in set(want)][:2]
        return f"{len(got)} rows against {len(want)}: {cols} {extra} {[r for r in want if r not in set(got)][:2]}"
    diff = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(diff)} rows differ: {cols} {diff[0]}" if diff else None
