"""Fanned-out rows come in partitions that fit a task, and are stored where they lie."""

import pytest

from gradeline import session
from gradeline.plans import catalog
from gradeline.sources import tables


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 1 << 14)


def test_partitions_follow_the_fanned_out_rows(spark, sf_dir, small_tasks):
    rows = tables.predictions(spark, sf_dir)
    tasks = tables.prediction_tasks(spark, sf_dir)
    assert tasks == -(-rows.count() // (1 << 14)) > spark.sparkContext.defaultParallelism
    assert rows.rdd.getNumPartitions() == tasks
    assert tables.predictions(spark, sf_dir, tasks=7).rdd.getNumPartitions() == 7


def test_store_has_a_bucket_per_partition_and_moves_no_fanned_out_row(spark, sf_dir, small_tasks):
    tasks = tables.prediction_tasks(spark, sf_dir)
    rows = tables.predictions(spark, sf_dir, tasks=tasks).repartition(tasks, "sample_id")
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    known = {t.name for t in spark.catalog.listTables()}
    out = catalog.QUERIES["mean_checkpoints_stored"](spark, sf_dir)
    (name,) = {t.name for t in spark.catalog.listTables()} - known
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe extended {name}").collect()}
    assert described["Num Buckets"] == str(tasks)
    assert out.where("n_checkpoints = 5").count() == tables.table(spark, sf_dir, "orders").count() * 25
