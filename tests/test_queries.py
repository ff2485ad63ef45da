"""Every registered query with SQL must agree with DuckDB; the others must run."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import connect, difference

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    assert difference(got, duck.execute(oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_runs(spark, name):
    assert queries()[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
