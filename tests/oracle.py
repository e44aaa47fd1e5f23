"""Runs a query on Spark and its SQL on DuckDB, and compares rows and columns."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """Empty if both give the same columns and rows."""
    rel = duck(sf_dir).sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} against {sorted(rel.columns)}"]
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    out = [] if len(mine) == len(theirs) else [f"{len(mine)} rows against {len(theirs)}"]
    return out + [f"{a} against {b}" for a, b in zip(mine, theirs, strict=False) if a != b][:5]
