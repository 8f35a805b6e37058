"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from bindings import ORACLES, QUERIES
from compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
    assert set(ORACLES) == set(QUERIES)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5
    assert sum(r["episode_count"] for r in rows) == 1500


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    status, note = compare(spark, con, SF, name)
    assert status == "ok", note
