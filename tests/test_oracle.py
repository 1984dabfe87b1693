"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from trivium.plans import queries as core

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def normal(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert normal(tuple(r) for r in got.select(*columns).collect()) == normal(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
