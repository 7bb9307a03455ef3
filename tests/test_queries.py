"""Every registered query; where there is SQL, against it."""

import pytest

import __spark_entry__ as contract
from compare import rows_of_duckdb, rows_of_spark, tables, type_differences

SF_DIR = "/root/testdata/sf0.01"
QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return tables(SF_DIR)


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, database, name):
    result = QUERIES[name](spark, SF_DIR)
    expected = database.sql(SQL[name])
    assert type_differences(result, expected) == []
    names, rows = rows_of_spark(result)
    expected_names, expected_rows = rows_of_duckdb(expected)
    assert names == expected_names
    assert rows == expected_rows
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns[:2] == ["id_client", "user_id"]
    assert result.count() == 15
