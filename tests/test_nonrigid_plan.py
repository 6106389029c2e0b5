"""Registration and resampling are done once, not again for every table that reads them."""

from kinetrace.plans import catalog


def test_the_last_plan_holds_the_flow_alone(spark):
    plan = catalog.nonrigid_scrolls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan and "Window" not in plan
