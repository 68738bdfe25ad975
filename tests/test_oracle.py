"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries, registry
from tools.check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry()))
def test_query_matches_oracle(spark, con, sf_dir, name):
    ok, note = compare(spark, con, registry()[name].build, registry()[name].oracle, sf_dir)
    assert ok, note


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
