"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from shelfspark.queries.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    rows, _, difference = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert difference is None
    assert rows > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
