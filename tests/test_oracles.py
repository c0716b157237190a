"""Every query with a SQL twin agrees with it; the others return rows."""

from __future__ import annotations

import os

import __spark_entry__ as spark_entry
import oracle
import pytest

SF_DIR = os.environ.get("PAIRLAB_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    found = oracle.differences(spark, con, QUERIES[name], SQL.get(name), SF_DIR)
    assert [p for p in found if p != "no rows"] == []


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 3
