"""Every registered query against its SQL twin on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
from tablesync.checks.views import TABLES

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canon(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    got = sorted((tuple(canon(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cursor = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(canon(r[i]) for i in place) for r in cursor.fetchall()), key=repr)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
