"""A few registered queries beside their SQL on the smallest tables, and facts of the registry."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
PICKED = ["i27_win_frame", "e03_prior_win_rate", "d10_current_snapshot", "e07_hazard_targets", "h27_business_rules", "d19_precision_at_k",
          "d23_psi_drift", "h62_redistribution", "j02_critical_path", "j03_cascade", "i16_price_band", "a11_advisory_merge", "k02_debounce_stream"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, con, name):
    ok, message = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert ok, message


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
