"""A stored, bucketed prediction table is averaged where it lies."""

import uuid

import pytest

from gradeline.operators import predictions
from gradeline.sources.writers import store_predictions


def test_no_exchange_over_stored_predictions(spark, tmp_path):
    rows = [(arm, 0, s if s else None, e, 1, 0.1 * (e - 35), 1 - 0.1 * (e - 35)) for arm in (0, 1) for s in range(40) for e in range(36, 41)]
    df = spark.createDataFrame(rows, "arm int, seed int, sample_id bigint, epoch int, y_true int, p0 double, p1 double")
    name = "preds_" + uuid.uuid4().hex
    stored = store_predictions(df, name, str(tmp_path / "bucketed"), buckets=4, sort=["arm", "epoch"])
    df.write.parquet(str(tmp_path / "plain"))
    plain = spark.read.parquet(str(tmp_path / "plain"))
    keys = ["arm", "seed", "sample_id"]
    mean = lambda d: predictions.mean_checkpoints(d, keys, expected_k=5)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(mean(stored)) and "Exchange" in plan(mean(plain))
    assert "Exchange" not in plan(predictions.churn(predictions.predict(stored), ["arm", "seed"], "sample_id", "epoch", "y_pred").select("churn").limit(1)).split("Window")[-1]
    as_rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    assert [r[:3] for r in as_rows(mean(stored))] == [r[:3] for r in as_rows(mean(plain))] and mean(stored).count() == 80
    for a, b in zip(as_rows(mean(stored)), as_rows(mean(plain))):
        assert a[3:] == pytest.approx(b[3:])
    with pytest.raises(Exception):
        store_predictions(df, name, str(tmp_path / "again"))
