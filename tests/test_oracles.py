import os

import pytest

import __spark_entry__
from freightloom.plans import QUERIES
from oracle import assert_equal, connection

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_rows_equal_duckdb(spark, con, name):
    assert_equal(QUERIES[name].build(spark, FOLDER), con, QUERIES[name].sql)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_rows_without_sql(spark, name):
    assert QUERIES[name].build(spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
