"""Each registered query with oracle SQL against DuckDB on the same Parquet files."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    assert differences(queries()[name](spark, SF_DIR), duck, oracle_sql()[name]) == []


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["order_date", "customer_state", "product_category", "orders", "revenue"]
    assert df.count() > 0
