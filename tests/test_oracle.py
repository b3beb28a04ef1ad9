"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import check
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
# Iterates over written tables; the form with closing is compared here.
SLOW = {"r11_high_terrain_component"}


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_matches_sql(spark, con, name):
    verdict, _, _ = check.compare(spark, con, name, SF, QUERIES, ORACLES)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_entry_runs(spark):
    assert entry_points.entry(spark).columns[-1] == "region_id"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
