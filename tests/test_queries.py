"""Every named query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connection

CHECKED = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


def test_names():
    assert set(CHECKED) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3984


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, con, small, name):
    assert compare(spark, con, name, small) is None
