"""Runs a query and its DuckDB twin over the same tables and compares rows without order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if x != x else float(f"{x:.10g}")
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    if x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((repr([_plain(r[i]) for i in order]) for r in rows))


def assert_same(spark, plan, sql, sf_dir):
    df = plan(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connection(sf_dir).execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    odd = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not odd, f"{len(odd)} rows differ, first: {odd[0]}"
    return len(got[1])
