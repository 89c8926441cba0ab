"""All queries against their SQL, and the driver's entry points."""

import pytest

import __spark_entry__
from sorrel.plans import oracle, queries
from tests.compare import duck, same

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, con, name):
    same(queries.queries()[name](spark, sf_dir), con, SQL[name])


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows[0]["priority"] >= rows[-1]["priority"] >= 50
