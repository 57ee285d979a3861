"""Every registered query with SQL equals it on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from visitline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="shared tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs_whole(spark, name):
    got = registry.QUERIES[name](spark, SF)
    assert got.columns and got.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source_state", "future_state", "count"] and df.count() == 9


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
