"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(tuple(v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return str(v) if hasattr(v, "isoformat") else v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, query, sql: str, sf_dir: str = SF_DIR) -> list[str]:
    """What differs, at most a few lines; empty if the results are equal."""
    df = query(spark, sf_dir)
    cur = connect(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    a, b = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    if len(a) != len(b):
        return [f"{len(a)} and {len(b)} rows"] + [str(x)[:300] for x in (a[:2] + b[:2])]
    return [f"{str(x)[:400]} and {str(y)[:400]}" for x, y in zip(a, b, strict=True) if x != y][:5]
