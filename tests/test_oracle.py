"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402

from levelmap.plans import catalog, oracle  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and SQL.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name, QUERIES[name], SQL[name])
    assert ok, note


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "mode" in df.columns
