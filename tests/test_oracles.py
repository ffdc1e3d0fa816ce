"""Every query with an oracle equals it at the smallest scale."""
import os

import pytest

import __spark_entry__ as e
from tests.oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = e.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, name):
    assert compare(e.queries()[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(e.queries())
