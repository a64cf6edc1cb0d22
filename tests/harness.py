"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, bool):
        return value
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def connection(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def same(df, sql: str, sf_dir: str = DATA) -> int:
    """Asserts equal columns and rows; returns how many rows."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    asked = connection(sf_dir).execute(sql)
    columns = [d[0] for d in asked.description]
    want = rows_of(columns, asked.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want, strict=True):
        assert g == w, (sorted(columns), g, w)
    return len(got)
