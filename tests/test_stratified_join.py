"""Covariates come to the predictions, which stay where they lie."""

from gradeline.plans import catalog


def test_covariates_come_to_the_predictions(spark, sf_dir):
    plan = catalog.QUERIES["stratified_metrics"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [sample_id" in plan and "SortMergeJoin [sample_id" not in plan and "BroadcastHashJoin [sample_id" not in plan
