"""Every registered query with SQL gives DuckDB's rows on the smallest data."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from pointline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"streamed_table", "leakage_audit", "trained_scores", "family_scores", "search_trials", "out_of_fold_scores"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.oracles()) - SLOW))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    want = duck.sql(catalog.oracles()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert rows_of(df.columns, df.collect(), order) == rows_of(want.columns, want.fetchall(), order)
