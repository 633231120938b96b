"""Runs a query in Spark and its SQL in DuckDB over the same parquet tables, and compares all rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from read_parquet('{source}')")
    return con


def _plain(v):
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return repr(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    return sorted(tuple(_plain(r[c]) for c in columns) for r in rows)


def compare(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = rows_of(columns, (r.asDict(recursive=True) for r in df.collect()))
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = rows_of(columns, (dict(zip(names, r)) for r in result.fetchall()))
    assert len(got) == len(want)
    assert got == want, ([x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
