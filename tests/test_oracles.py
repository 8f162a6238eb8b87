"""Every query with SQL gives what DuckDB gives on the small tables."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

import __spark_entry__ as contract
from oracle_check import compare, connect

SQL = contract.oracle_sql()
MODEL_QUERIES = sorted(set(contract.queries()) - set(SQL))


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, SF_SMALL, contract.queries()[name], SQL[name]) == ""


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert "snapshot_id" in df.columns and df.count() > 0
