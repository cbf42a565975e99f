"""Every query with SQL gives the same rows as DuckDB. The others are tested by their invariants."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_queries import check, connect

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, connection, name):
    assert check(spark, connection, name, SMALL) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
