"""Queries of the subpackage against their SQL twins."""

import os

import pytest
from compare import compare, sql_engine

from hindcast.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(spark, sql_engine(SF), name, QUERIES[name], ORACLES[name], SF)[0] > 0
