"""Every query of the subpackage that SQL can express, against its SQL on the smallest tables."""

import os

import pytest
from oracle import compare, connect

import shelfspark.llm.queries  # noqa: F401
from shelfspark.llm.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    rows, _, difference = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert difference is None
    assert rows > 0
