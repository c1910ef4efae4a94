"""Streaming monitors on small files."""

import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradeline.sources import records, writers
from gradeline.streaming import monitors


@pytest.fixture()
def folder():
    return Path(tempfile.mkdtemp(prefix="gradeline-stream-"))


def test_churn_over_two_batches_ignores_late_epochs(spark, folder):
    src, out, ckpt = str(folder / "in"), str(folder / "out"), str(folder / "ckpt")
    schema = "run_id bigint, sample_id bigint, epoch bigint, pred bigint"
    default = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitors.ROCKSDB)
    try:
        for batch in ([(1, 1, 1, 0), (1, 2, 1, 1), (1, 1, 2, 1)], [(1, 1, 1, 0), (1, 1, 3, 1), (1, 2, 2, 1)]):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
            monitors.run_available(monitors.monitor_churn(spark.readStream.schema(schema).parquet(src)), out, ckpt)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", default)
    got = {(r["sample_id"], r["epoch"]): (r["flipped"], r["late_rows"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 2): (True, 0), (1, 3): (False, 1), (2, 2): (False, 0)}


def test_monitor_runs_flags_collapse(spark, folder):
    src = str(folder / "in")
    rows = [("a", "2024-01-01 00:10:00", 0.9, 0.1)] * 3 + [("b", "2024-01-01 00:20:00", 0.9, 0.1), ("b", "2024-01-01 00:21:00", 0.1, 0.9), ("b", "2024-01-01 00:21:00", 0.2, 0.8)]
    rows += [("z", "2024-01-03 00:00:00", 0.9, 0.1)]
    df = spark.createDataFrame(rows, "run string, ts string, p0 double, p1 double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(src)
    watched = monitors.monitor_runs(spark.readStream.schema(df.schema).parquet(src), ["run"])
    monitors.run_available(watched, str(folder / "out"), str(folder / "ckpt"))
    got = {r["run"]: (r["n0"], r["n1"], r["collapsed"]) for r in spark.read.parquet(str(folder / "out")).collect()}
    assert got["a"] == (3, 0, True) and got["b"] == (1, 2, False)


def test_log_append_and_stream(spark, folder):
    path = str(folder / "log")
    rows = spark.createDataFrame([(1, 7, 0.0, 1e-3, 1e-3, 0.0)], records.STEP_LOG_SCHEMA)
    writers.append_log(rows, path)
    writers.append_log(rows.withColumn("step", F.lit(2).cast("bigint")), path)
    assert sorted(r["step"] for r in records.read_log(spark, path).collect()) == [1, 2]
    monitors.run_available(records.stream_log(spark, path, files_per_trigger=1), str(folder / "out"), str(folder / "ckpt"))
    assert spark.read.parquet(str(folder / "out")).count() == 2


def test_runs_over_batches_out_of_order(spark, folder):
    """Each file is a batch; epochs come out of order, one row comes after its window is closed and is counted."""
    src, out = str(folder / "in"), str(folder / "out")
    schema = "ts timestamp, run int, epoch int, p0 double, p1 double"
    batches = [
        [("2024-01-01 10:05:00", 1, 2, 0.9, 0.1), ("2024-01-01 10:10:00", 1, 1, 0.2, 0.8)],
        [("2024-01-01 10:01:00", 1, 1, float("nan"), float("nan")), ("2024-01-01 10:59:00", 1, 2, 0.3, 0.7)],
        [("2024-01-01 15:00:00", 1, 3, 0.5, 0.5)],
        [("2024-01-01 15:10:00", 1, 3, 0.4, 0.6)],  # the filter of late rows follows the watermark one batch later
        [("2024-01-01 10:02:00", 1, 1, 0.6, 0.4), ("2024-01-01 15:30:00", 1, 3, 0.1, 0.9)],
    ]
    rows = F.to_timestamp("ts")
    for batch in batches:
        spark.createDataFrame(batch, schema.replace("ts timestamp", "ts string")).withColumn("ts", rows).coalesce(1).write.mode("append").parquet(src)

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    import os
    import time

    files = sorted((f for f in os.listdir(src) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{src}/{f}"))
    for k, name in enumerate(files):  # one file a batch, in the order written
        os.utime(f"{src}/{name}", (time.time() + k, time.time() + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    job = (
        monitors.monitor_runs(stream, ["run", "epoch"], delay="1 hour", window="1 hour").writeStream.outputMode("update")
        .foreachBatch(keep).option("checkpointLocation", str(folder / "ckpt")).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    last = {}
    for r in spark.read.parquet(out).orderBy("batch").collect():
        last[r["epoch"], r["window_start"].hour] = (r["n0"], r["n1"], r["has_nan"], r["collapsed"])
    assert last == {(2, 10): (1, 1, False, False), (1, 10): (1, 1, True, False), (3, 15): (1, 2, False, False)}
    assert monitors.late_rows(job) == 1
