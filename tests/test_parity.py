"""Every registered query equals its SQL."""

import os

import pytest

from rollbook.catalog.registry import QUERIES
from tests.parity import compare, connect, entry

SF = os.environ.get("PARITY_SF", "0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) in ("", "no rows")


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
