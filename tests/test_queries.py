"""Every query that has a SQL twin, against it, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from hirelake.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rounded(x):
    if isinstance(x, float):
        return round(x, 6)
    return str([rounded(y) for y in x]) if isinstance(x, list) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([rounded(r[i]) for i in order]) for r in data)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, db, name):
    df = QUERIES[name](spark, DATA)
    twin = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows(df.columns, df.collect()) == rows(twin.columns, twin.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["role", "skill", "cnt"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
