"""Runs a query and its DuckDB SQL over the same tables and compares schema and rows, whatever their order."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v.asDict().values())
    return v


def compare(spark, name: str, query, sql: str, sf_dir: str) -> int:
    """Raises AssertionError where they differ; returns the number of rows."""
    df = query(spark, sf_dir)
    c = connect(sf_dir)
    rel = c.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns), (name, cols, rel.columns)
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    other = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert mine == other, (name, sum(mine.values()), sum(other.values()), list((mine - other).items())[:5], list((other - mine).items())[:5])
    return sum(mine.values())
