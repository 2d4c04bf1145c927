"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def assert_same(spark, directory: str, query, sql: str) -> None:
    df = query(spark, directory)
    got = rows_of(df.columns, df.collect())
    result = duck(directory).execute(sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want
