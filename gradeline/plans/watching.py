"""Registered queries that run the streaming monitors and the scoring hook over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import predictions
from ..session import scratch_path
from ..sources import tables
from ..streaming import monitors
from .registry import query, rounded


def _event_stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    p0 = (F.col("event_id") % 1024) / F.lit(1024.0)
    return stream.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"), "event_id", "event_type", p0.alias("p0"), (F.lit(1.0) - p0).alias("p1")
    )


@query("monitor_runs", """select * from (
with e as (select user_id % 10 as run_group, event_id % 40 + 1 as epoch, cast(floor(epoch(ts) / 31536000) as bigint) as window_no, event_id % 101 = 0 as bad, event_id % 1024 / 1024e0 as p from events),
c as (select *, case when bad then 1e0 else greatest(p, 1e-12) end as a, case when bad then 1e0 else greatest(1 - p, 1e-12) end as b from e),
g as (select run_group, epoch, window_no, sum(case when bad or p >= 0.5 then 1 else 0 end)::bigint as n0, sum(case when bad or p >= 0.5 then 0 else 1 end)::bigint as n1,
             round(avg(-a * ln(a) - b * ln(b)), 9) as mean_entropy, bool_or(bad) as has_nan from c group by 1, 2, 3)
select *, n0 / (n0 + n1) <= 0.02e0 or n0 / (n0 + n1) >= 0.60e0 as collapsed from g)""")
def _(spark, folder):
    out = scratch_path(spark, "monitor")
    bad = F.col("event_id") % 101 == 0
    stream = _event_stream(spark, folder).select(
        "ts", (F.col("run_id") % 10).alias("run_group"), (F.col("event_id") % 40 + 1).alias("epoch"),
        *[F.when(bad, F.lit(float("nan"))).otherwise(F.col(p)).alias(p) for p in ("p0", "p1")])
    watched = monitors.monitor_runs(stream, ["run_group", "epoch"], delay="30 days", window="365 days")
    # complete results of every window: update mode into a per-batch table
    def keep_latest(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    job = (
        watched.writeStream.outputMode("update").foreachBatch(keep_latest).option("checkpointLocation", scratch_path(spark, "ckpt"))
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    values = ["n0", "n1", "mean_entropy", "has_nan", "collapsed"]
    latest = spark.read.parquet(out).groupBy("window_start", "run_group", "epoch").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    number = F.floor(F.unix_timestamp("window_start") / 31536000).cast("bigint")
    return rounded(latest.select("run_group", "epoch", number.alias("window_no"), *[F.col(f"v.{v}").alias(v) for v in values]), "mean_entropy")


@query("monitor_churn", """
select run_id, epoch, count(*) as n, sum(case when p <> q then 1 else 0 end)::bigint as flips from (
  select c_nationkey as run_id, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as epoch,
         o_orderkey % 3 % 2 as q, lag(o_orderkey % 3 % 2) over (partition by o_custkey order by o_orderkey) as p from orders join customer on c_custkey = o_custkey)
where p is not null group by 1, 2""")
def _(spark, folder):
    from pyspark.sql import Window

    orders = tables.table(spark, folder, "orders").join(
        tables.table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey")
    )
    along = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = orders.select(
        F.col("c_nationkey").cast("bigint").alias("run_id"), F.col("o_custkey").alias("sample_id"),
        F.row_number().over(along).cast("bigint").alias("epoch"), (F.col("o_orderkey") % 3 % 2).alias("pred"),
    )
    path, out = scratch_path(spark, "preds"), scratch_path(spark, "flips")
    rows.write.parquet(path)
    own = monitors.state_session(spark)
    monitors.run_available(monitors.monitor_churn(own.readStream.schema(rows.schema).parquet(path)), out, scratch_path(spark, "ckpt"))
    return spark.read.parquet(out).groupBy("run_id", "epoch").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("flipped").alias("flips")
    )


@query("monitor_label_access", """
select a.run_id, a.ts, e.training_end from access_log a left join (select run_id, max(ts) as training_end from access_log where kind = 'train_step' group by 1) e using (run_id)
where kind = 'label_read' and (training_end is null or a.ts <= training_end)""")
def _(spark, folder):
    out = scratch_path(spark, "alerts")
    ends = tables.access_log(spark, folder).where("kind = 'train_step'").groupBy("run_id").agg(F.max("ts").alias("training_end"))
    stream = _event_stream(spark, folder).withColumn("kind", F.when(F.col("event_type") == "error", "label_read").otherwise("train_step"))
    monitors.run_available(monitors.monitor_label_access(stream, ends), out, scratch_path(spark, "ckpt"))
    return spark.read.parquet(out).select("run_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("training_end").cast("timestamp_ntz").alias("training_end"))


def _linear_model(scale: float):
    """Factory of a two-class linear scorer over a feature vector; stands in for a caller's network."""

    def factory():
        def predict(batch: np.ndarray) -> np.ndarray:
            x = batch.astype(np.float64) * scale
            return np.stack([x[:, :32].sum(axis=1), x[:, 32:].sum(axis=1)], axis=1)

        return predict

    return factory


@query("scoring_hook", """select * from (
with z as (select vec_id, list_sum([cast(x as double) for x in embedding[1:32]]) as a, list_sum([cast(x as double) for x in embedding[33:64]]) as b, k from embeddings, (select unnest([1e0, 2e0, 3e0]) as k)),
s as (select vec_id, 1e0 / (1e0 + exp((b - a) * k)) as p from z)
select vec_id, round(avg(p), 9) as p0, count(*) as n_checkpoints from s group by 1)""")
def _(spark, folder):
    rows = tables.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    scored = predictions.score_checkpoints(rows, "x", {38: _linear_model(1.0), 39: _linear_model(2.0), 40: _linear_model(3.0)}, 2, 64)
    out = predictions.mean_checkpoints(scored, ["vec_id"], carry=(), expected_k=3)
    return rounded(out.select("vec_id", "p0", "n_checkpoints"), "p0")


