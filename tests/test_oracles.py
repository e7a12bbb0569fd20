"""Every registered query against its SQL on the smallest given tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    # the operators for training data, which SQL cannot all express, have tests of their own
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_sql(spark, con, name):
    rows, problems = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not problems
    assert rows > 0
