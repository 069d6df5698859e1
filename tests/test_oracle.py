"""Every query with a SQL equivalent, against DuckDB on the same tables."""

import pytest
from compare import compare, connect
from conftest import SMALL

import __spark_entry__ as contract

SQL = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert compare(db, QUERIES[name](spark, SMALL), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_learned_query_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
