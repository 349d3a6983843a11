"""Spark results against DuckDB's on the same files."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    rows = zip(*(table[x].to_pylist() for x in names)) if names else []
    return sorted((tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in rows), key=repr)


def same_as_sql(df, sql: str, sf_dir: str = DATA) -> None:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = con.sql(sql).to_arrow_table()
    got = df.toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    assert a == b
