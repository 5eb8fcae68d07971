"""Every named query next to its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from issuelens.plans.catalog import QUERIES as CATALOG
from tests.oracle import connect, difference

NAMES = list(CATALOG)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_keys_match():
    assert set(oracle_sql()) <= set(queries())
    assert set(NAMES) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name, queries()[name], oracle_sql().get(name)) is None


def test_entry(spark, sf_dir):
    assert entry(spark).count() == 1
