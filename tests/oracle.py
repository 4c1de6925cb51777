"""Compare a query with its SQL in DuckDB, as sorted rows of values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(found, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in found), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    c = connection(sf_dir)
    told = c.execute(sql)
    names = [d[0] for d in told.description]
    assert sorted(df.columns) == sorted(names)
    expected, got = rows(told.fetchall(), names), rows(df.collect(), df.columns)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == b
