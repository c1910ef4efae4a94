"""The sort of churn leads with the column that tells most rows apart."""

import re

from gradeline.operators import predictions


def test_sample_leads_the_sort(spark):
    rows = [(run, s, e, (s + e) % 3 % 2) for run in (0, 1) for s in range(20) for e in (1, 2, 3)]
    df = spark.createDataFrame(rows, "run int, sample_id bigint, epoch int, pred int")
    out = predictions.churn(df, ["run"], "sample_id", "epoch", "pred")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[sample_id#\d+L? ASC", plan)
    flips = {(run, e): sum((s + e) % 3 % 2 != (s + e - 1) % 3 % 2 for s in range(20)) / 20 for run in (0, 1) for e in (2, 3)}
    got = {(r["run"], r["epoch"]): r["churn"] for r in out.collect()}
    assert got == flips | {(0, 1): None, (1, 1): None}
