"""Every query against its SQL counterpart on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check import table

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, STATEMENTS = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def base():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in sorted(FOLDER.glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_equal(spark, base, name):
    mine, theirs = table(QUERIES[name](spark, str(FOLDER)).toPandas()), table(base.execute(STATEMENTS[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert mine.equals(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STATEMENTS)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 201
