"""Every query with SQL must agree with it, on the smallest tables."""

import pytest

from oracle import compare, connect
from reelspark.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
# nothing happens at this size, which is a valid answer
MAY_BE_EMPTY = {"multi_video_order_stop", "config_unknown_games", "logs_without_frames", "missing_artifacts"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    outcome = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert outcome == "" or (outcome == "EMPTY" and name in MAY_BE_EMPTY), outcome


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
