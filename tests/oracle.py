"""Compare registered queries with their SQL on the given tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if not v.is_integer() else float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=repr)


def differences(con, df, sql: str, limit: int = 3) -> list:
    """Empty when names and the multiset of rows agree exactly."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    want, got = _rows(names, cur.fetchall()), _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return [("rows", len(got), len(want), got[:2], want[:2])]
    return [(g, w) for g, w in zip(got, want) if g != w][:limit]
