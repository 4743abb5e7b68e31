"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from lintarium.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=str)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted((tuple(_plain(dict(zip(columns, r))[c]) for c in names) for r in cursor.fetchall()), key=str)
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
