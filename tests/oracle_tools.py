"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _cell(x: object) -> str:
    if x is None or x != x:
        return "~"
    return f"{float(x):.6g}" if isinstance(x, (float, Decimal)) else str(x).removesuffix(" 00:00:00")


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in rows)


def assert_same(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = c.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())
