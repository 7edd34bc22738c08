"""The best truth of a box is found without a sort of all pairs."""

from boxwright.plans import registry


def test_pairs_are_not_aggregated(spark):
    plan = registry.load()[0]["J19_best_truth"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
