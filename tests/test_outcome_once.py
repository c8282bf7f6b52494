from reelspark.plans.catalog import QUERIES


def test_signals_of_rules_are_gathered_once_per_frame(spark):
    plan = QUERIES["detect_events_overrides"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries(") <= 4, plan.count("map_from_entries(")
