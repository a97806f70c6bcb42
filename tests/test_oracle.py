"""Every registered forecast query against its SQL, over whole tables of the smallest size."""

from __future__ import annotations

import pytest

from seagrid.plans.queries import ORACLES, QUERIES
from tests.oracle import SF, assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], con)


def test_entry_imports_and_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
