"""What the measures' plans must not do with pixels."""

import re

import pytest

from dishscope.queries import QUERIES


@pytest.fixture()
def plan_of(spark):
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for k in held:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", ["ring_profiles_relative", "ring_profiles"])
def test_rings_stay_where_they_are_read(plan_of, name):
    """F8, F9: pixels are not gathered by colony to meet its depth, and no row a draw is made."""
    plan = plan_of(name)
    assert not re.search(r"SortMergeJoin \[plate_id#\d+, colony_id#\d+\]", plan) and "_rep" not in plan


def test_colonies_meet_no_copies_of_pixels(plan_of):
    """neighbours are found in line, not by a join with four copies of every pixel; no row a draw is made."""
    plan = plan_of("colony_measures")
    assert "LeftSemi" not in plan and "_rep" not in plan


def test_bootstrap_deals_no_draws(plan_of):
    """only block sums are dealt, at most eight times."""
    plan = plan_of("block_bootstrap")
    assert "_rep" not in plan and "SortMergeJoin" not in plan
