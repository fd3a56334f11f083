"""Rows of a Spark query against rows of DuckDB SQL."""

import os
from decimal import Decimal

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql):
    rel = duck().sql(sql)
    expected = normal(rel.fetchall(), rel.columns)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]
