"""Every query with SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tensorloom.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(r[k] for k in order) for r in data], key=repr)


def compared(spark, duck, query, sql):
    df = query(spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    want = rows(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert repr(got) == repr(want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    compared(spark, duck, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["b", "idx", "re"] and df.count() == 64 * 500
    assert set(entry.oracle_sql()) <= set(entry.queries())
