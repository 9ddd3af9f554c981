"""Every registered query against its checking SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import compare, connect

from tidemark.checks import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_check(spark, con, name):
    verdict, _, _, _, note = compare(spark, con, name, SF_DIR)
    assert verdict in ("ok", "rows-only"), note


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
