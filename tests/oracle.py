"""Compare a Spark result with what DuckDB gives for the same tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def _plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    return bytes(v) if isinstance(v, bytearray) else v


def rows_of(rows: list, order: list[int]) -> Counter:
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(df: DataFrame, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    got = con.sql(sql)
    assert sorted(got.columns) == sorted(df.columns)
    theirs = rows_of(got.fetchall(), [got.columns.index(c) for c in df.columns])
    ours = rows_of(df.collect(), list(range(len(df.columns))))
    assert ours, "no rows"
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
