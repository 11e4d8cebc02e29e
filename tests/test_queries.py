"""Every registered query against its SQL counterpart in DuckDB, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as driver
from conftest import SMALL
from feedrank.plans.catalogue import QUERIES as CATALOGUE

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()
TABLES = ("documents", "pages", "events", "lineitem", "benchmark")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(CATALOGUE) <= set(QUERIES)
    assert set(CATALOGUE) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query_matches_its_oracle(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    columns = sorted(result.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    rows = sorted(repr(tuple(row[c] for c in columns)) for row in result.collect())
    places = [relation.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(row[p] for p in places)) for row in relation.fetchall())
    if name not in ("fetch_failure_policy", "fetch_retries"):  # the smallest tables hold no failed fetch to warn of
        assert rows


def test_entry_is_the_daily_ranking(spark):
    result = driver.entry(spark)
    assert {"run_date", "rank", "score", "title", "url", "tags"} <= set(result.columns)
    assert result.count() > 0
