"""Registered queries against their SQL, on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract
import check_queries as check

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The model searches repeat what test_models covers and take the longest.
SLOW = {"search_best", "reproduce_best", "svc_linear", "search_svm"}
NAMES = [n for n in contract.queries() if n not in SLOW or os.environ.get("TEST_ALL")]


@pytest.fixture(scope="module")
def con():
    return check.database(SF)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = contract.queries()[name](spark, SF).toArrow()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
    else:
        assert check.compare(got, con.sql(sql).to_arrow_table()) == ""


def test_entry(spark):
    assert contract.entry(spark).count() == 1
