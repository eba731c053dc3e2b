"""Run registered queries against their SQL in DuckDB, like the driver does."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, run, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns, kinds of types, and rows; else what differs."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    left = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != names:
        return f"columns {names} != {sorted(columns)}"
    order = [columns.index(c) for c in names]
    right = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    left, right = _sorted(left), _sorted(right)
    for a, b in zip(left, right, strict=True):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            return f"{a} != {b}"
    return "" if left else "no rows"
