"""Runs a query and its SQL side by side."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def rows(columns: list[str], found: list) -> list[tuple]:
    order = sorted(columns)

    def plain(x):
        return None if isinstance(x, float) and math.isnan(x) else str(x)

    return sorted((tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in found), key=str)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    expected = rows(columns, want.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(columns)
    assert got == expected
