"""Side-by-side comparison of a query with its DuckDB twin."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """Empty if both sides agree, else what differs first."""
    df = fn(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    if ours == theirs:
        return "" if all(type(a) is type(b) for x, y in zip(ours[:50], theirs[:50]) for a, b in zip(x, y)) else f"types {[type(v).__name__ for v in ours[0]]} and {[type(v).__name__ for v in theirs[0]]}"
    n = sum(a != b for a, b in zip(ours, theirs))
    return f"{n} of {len(ours)} rows differ, first {next((a, b) for a, b in zip(ours, theirs) if a != b)}"
