from __future__ import annotations

import pytest
from crossengine import compare, connect

import __spark_entry__ as entry_point
from tidewire.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf, con):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert entry_point.entry(spark).columns == ["id", "location", "category", "label", "quality", "created_at"]
