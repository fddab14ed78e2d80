"""Every named query agrees with its SQL statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

from shelfscope.plans.registry import ORACLES as STATEMENTS
from shelfscope.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_query_has_a_statement():
    assert QUERIES.keys() == STATEMENTS.keys()
    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("key", QUERIES)
def test_statement(spark, data, con, key):
    assert difference(QUERIES[key](spark, data), con, STATEMENTS[key]) is None


def test_flagship(spark):
    assert not entry.entry(spark).isEmpty()
