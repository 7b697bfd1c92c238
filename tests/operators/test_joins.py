"""Sides whose sizes Spark guesses far too low aren't sent through the driver."""

import pytest

from plumbline.plans import queries as plans

PATH = "/root/testdata/sf0.001"


def executed(spark, run):
    """The plans of all that ``run`` executes, as they ended."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    since = max((e.executionId() for e in listed(store)), default=-1)
    run()
    bus.waitUntilEmpty(30_000)
    return [e.physicalPlanDescription() for e in listed(store) if e.executionId() > since]


def listed(store):
    rows = store.executionsList()
    return [rows.apply(k) for k in range(rows.size())]


NAMES = """rule_shared_boundaries rule_must_not_have_gaps rule_lines_must_connect lines_extended burn_in_all burn_in_nearest plots_enclosing
observations_snapped plots_masked repair_planned topology_issues"""


@pytest.mark.parametrize("name", NAMES.split())
def test_nothing_is_broadcast(spark, name):
    # What is known of finished shuffles may be used; guesses from files may not.
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        found = executed(spark, lambda: plans.QUERIES[name](spark, PATH).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert found and any("SortMergeJoin" in p for p in found)
    assert not any("BroadcastExchange" in p for p in found)
