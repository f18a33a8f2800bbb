"""Every query of the engine against its DuckDB oracle."""

from __future__ import annotations

import pytest
from oracle import differences, duck

from tidemark import catalog


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_all_have_oracles():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    assert differences(spark, sf, catalog.queries()[name], catalog.oracle_sql()[name], con) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
