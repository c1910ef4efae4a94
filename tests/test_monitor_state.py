"""Durable counts of late rows; churn with an initial state, restarts, timers and an audit of the state."""

import os
import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradeline.operators.predictions import churn
from gradeline.streaming import monitors


@pytest.fixture()
def folder():
    return Path(tempfile.mkdtemp(prefix="gradeline-state-"))


def put(spark, path, rows, schema, number):
    """One more file of a stream's source, in a fixed order."""
    df = spark.createDataFrame(rows, schema)
    df = df.withColumn("ts", F.to_timestamp("ts")) if "ts" in df.columns else df
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    df.coalesce(1).write.mode("append").parquet(path)
    for name in set(os.listdir(path)) - before:
        os.utime(f"{path}/{name}", (1_700_000_000 + number,) * 2)


def test_late_rows_over_batches_and_a_restart(spark, folder):
    src, out, log = str(folder / "in"), str(folder / "out"), str(folder / "late")
    schema = "ts string, run int, p0 double, p1 double"
    late = lambda n: [("2024-01-01 10:00:00", 10 + i, 0.5, 0.5) for i in range(n)]
    fresh = lambda h: [(f"2024-01-02 {h:02d}:00:00", 1, 0.5, 0.5)]
    listener = monitors.LateRowLog(spark, log)
    spark.streams.addListener(listener)
    try:
        injected, number = 0, 0
        for part in ([(fresh(1), 0), (fresh(2), 0), (late(3) + fresh(3), 3)], [(late(2) + fresh(4), 2), (fresh(5), 0), (late(4), 4)]):
            for rows, n in part:
                put(spark, src, rows, schema, number := number + 1)
                injected += n
            stream = spark.readStream.schema("ts timestamp, run int, p0 double, p1 double").option("maxFilesPerTrigger", 1).parquet(src)
            job = (monitors.monitor_runs(stream, ["run"], delay="1 hour", window="1 hour").writeStream.outputMode("append").format("parquet")
                   .option("checkpointLocation", str(folder / "ckpt")).trigger(availableNow=True).start(out))
            job.awaitTermination()
            assert listener.settled(job)
    finally:
        spark.streams.removeListener(listener)
    rows = monitors.LateRowLog.total(spark, log).collect()
    assert [(r["query_id"], r["late_rows"]) for r in rows] == [(str(job.id), injected)]
    again = spark.read.parquet(log).limit(1)  # a batch that reports twice counts once
    again.write.mode("append").parquet(log)
    assert monitors.LateRowLog.total(spark, log).first()["late_rows"] == injected


def test_flips_equal_the_batch_after_a_restart(spark, folder):
    """Epochs 1 and 2 come as a batch table, 3 to 6 in two runs of the stream; flips are those of the batch operator."""
    schema = "run_id bigint, sample_id bigint, epoch bigint, pred bigint"
    rows = [(r, s, e, (s * e + r) % 3 % 2) for r in (1, 2) for s in range(6) for e in range(1, 7)]
    own = monitors.state_session(spark)
    initial = own.createDataFrame([r for r in rows if r[2] <= 2], schema)
    src, out, ckpt = str(folder / "in"), str(folder / "out"), str(folder / "ckpt")
    for number, epochs in enumerate([(3, 4), (5, 6)]):
        put(spark, src, [r for r in rows if r[2] in epochs], schema, number)
        monitors.run_available(monitors.monitor_churn(own.readStream.schema(schema).parquet(src), initial=initial), out, ckpt)
    got = {(r["run_id"], r["epoch"]): r["share"] for r in spark.read.parquet(out).groupBy("run_id", "epoch").agg(F.avg(F.col("flipped").cast("double")).alias("share")).collect()}
    want = churn(spark.createDataFrame(rows, schema), ["run_id"], "sample_id", "epoch", "pred").where("epoch > 2")
    assert got == {(r["run_id"], r["epoch"]): r["churn"] for r in want.collect()}
    held = {(r["run_id"], r["sample_id"]): (r["epoch"], r["pred"], r["late_rows"]) for r in monitors.held_predictions(own, ckpt).collect()}
    assert held == {(r, s): (6, (s * 6 + r) % 3 % 2, 0) for r in (1, 2) for s in range(6)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != monitors.ROCKSDB


def test_idle_samples_are_forgotten(spark, folder):
    schema = "run_id bigint, sample_id bigint, epoch bigint, pred bigint"
    own = monitors.state_session(spark)
    src, out, ckpt = str(folder / "in"), str(folder / "out"), str(folder / "ckpt")
    put(spark, src, [(1, 1, 1, 0), (1, 2, 1, 1)], schema, 1)
    watched = monitors.monitor_churn(own.readStream.schema(schema).parquet(src), idle_ms=4000)
    job = watched.writeStream.outputMode("append").option("checkpointLocation", ckpt).trigger(processingTime="500 milliseconds").format("parquet").start(out)
    held = lambda: {(r["run_id"], r["sample_id"]) for r in monitors.held_predictions(own, ckpt).collect()}

    def until(want, seconds=60):
        end = time.time() + seconds
        seen = None
        while time.time() < end and job.isActive:
            try:
                seen = held()
            except Exception:  # no batch is committed yet
                pass
            if seen == want:
                return True
            time.sleep(0.3)
        return False

    try:
        assert until({(1, 1), (1, 2)}) and until(set())
        put(spark, src, [(2, 7, 1, 0)], schema, 2)
        assert until({(2, 7)})
    finally:
        job.stop()
