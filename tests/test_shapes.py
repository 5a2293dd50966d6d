"""The plans of the graphs that are derived from the star schema."""

import pytest

from pathloom.plans import shapes

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    """Lines of the first plan as (depth, text)."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [(len(text) - len(text.lstrip(" :+-")), text.lstrip(" :+-")) for text in lines if text.strip()]


def test_lines_move_to_suppliers_orders_and_pairs_only(spark, no_broadcast):
    plan = plan_of(shapes.trade(spark, SF))
    at = next(i for i, (_, text) in enumerate(plan) if "FileScan" in text and "l_suppkey" in text)
    above, depth = [], plan[at][0]
    for d, text in reversed(plan[:at]):
        if d < depth:
            above, depth = [*above, text], d
    assert sum(text.startswith("Exchange") for text in above) == 3


def test_road_reads_its_lines_once(spark):
    assert sum("FileScan" in text for _, text in plan_of(shapes.road(spark, SF))) == 1
