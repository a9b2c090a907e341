"""Every registered query against its SQL on the smallest shared tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# The smallest tables have no learners for calibration.
LARGER = "/root/testdata/sf0.01"
ON_LARGER = {"i13_model_selection", "i15_preferred_parameters"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    sf, tables = (LARGER, duck(LARGER)) if name in ON_LARGER else (SF, con)
    assert differences(spark, tables, entry.queries()[name], entry.oracle_sql()[name], sf) == []


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
