"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    problem = difference(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())
