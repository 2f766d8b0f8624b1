"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", contract.oracle_sql())
def test_query_equals_sql(spark, oracle, name):
    found = contract.queries()[name](spark, SF_DIR)
    columns = sorted(found.columns)
    wanted = oracle.execute(contract.oracle_sql()[name])
    names = [column[0] for column in wanted.description]
    assert sorted(names) == columns
    places = [names.index(column) for column in columns]
    expected = [tuple(row[place] for place in places) for row in wanted.fetchall()]
    assert ordered(tuple(row) for row in found.select(columns).collect()) == ordered(expected)


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_keyword_query_has_sql():
    from termloom import catalog

    assert set(catalog.ORACLES) == set(catalog.QUERIES)
