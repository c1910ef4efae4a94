"""The given tables and the evaluation-shaped tables derived from them.

Each derived table exists twice: as a DataFrame here and as portable SQL in `VIEWS`, so a query and
its SQL counterpart start from equal rows. Probabilities are multiples of 1/1024, which keeps sums
exact in any order.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, task_count


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _span(first: int, last: int):
    return F.explode(F.sequence(F.lit(first), F.lit(last)))


def _fan_out(*spans: tuple[int, int]) -> int:
    return math.prod(last - first + 1 for first, last in spans)


def prediction_tasks(spark: SparkSession, folder: str, arms=(0, 4), seeds=(0, 4), epochs=(36, 40)) -> int:
    """Partitions in which `predictions` deals its rows."""
    return task_count(table(spark, folder, "orders"), _fan_out(arms, seeds, epochs))


def predictions(spark: SparkSession, folder: str, arms=(0, 4), seeds=(0, 4), epochs=(36, 40), tasks: int | None = None) -> DataFrame:
    """Per (arm, seed, fold, epoch, sample) class probabilities.

    Partitioned by sample before the fan-out, as a prediction store bucketed by sample would be.
    """
    orders = spread(
        table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey",
        fan_out=_fan_out(arms, seeds, epochs), tasks=tasks,
    )
    first_class = F.col("o_orderpriority").startswith("1")
    grid = (
        orders.withColumn("y_true", F.when(first_class, 0).otherwise(1))
        .withColumn("arm", _span(*arms))
        .withColumn("seed", _span(*seeds))
        .withColumn("epoch", _span(*epochs))
    )
    noise = (
        F.col("o_orderkey") * 7919
        + F.col("seed").cast("bigint") * 104729
        + F.col("arm").cast("bigint") * 12997
        + F.col("epoch").cast("bigint") * 15485863
    ) % 769
    lift = F.when(F.col("y_true") == 0, F.lit(200) + F.col("arm") * 12).otherwise(F.lit(0))
    p0 = F.least(F.lit(1024).cast("bigint"), noise + lift).cast("double") / F.lit(1024.0)
    return grid.select(
        "arm",
        "seed",
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
        "epoch",
        F.col("o_orderkey").alias("sample_id"),
        "y_true",
        p0.alias("p0"),
        F.col("o_custkey").alias("group_id"),
    ).withColumn("p1", F.lit(1.0) - F.col("p0"))


def part_sum(vector: str, start: int, n: int):
    """Sum of `n` consecutive entries of a vector, the first being 1."""
    return F.aggregate(F.slice(F.col(vector).cast("array<double>"), start, n), F.lit(0.0), lambda a, x: a + x)


def covariate(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("sample_id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("cov"),
    )


def shift(spark: SparkSession, folder: str) -> DataFrame:
    one_run = predictions(spark, folder, arms=(0, 0), seeds=(0, 0), epochs=(40, 40))
    return one_run.select(
        F.when(F.col("group_id") % 2 == 0, "source").otherwise("target").alias("domain"),
        "sample_id",
        "y_true",
        "p0",
        "p1",
    )


def features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id", F.when(F.col("label") < 5, "source").otherwise("target").alias("domain"), "embedding"
    )


def views(spark: SparkSession, folder: str) -> DataFrame:
    """Original (view 0) and three augmented views per sample."""
    four = predictions(spark, folder, arms=(1, 1), seeds=(0, 0), epochs=(36, 39))
    return four.select("sample_id", "y_true", (F.col("epoch") - 36).alias("view_id"), "p0", "p1")


def bank(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    return part.select(
        key.alias("entry_id"),
        F.when(key % 29 != 0, size / F.lit(4.0)).alias("hl_c"),
        ((key % 1201) - F.lit(600.0)).alias("hl_loc"),
        ((key % 523) * F.lit(1.0)).alias("hl_scale"),
        (size * F.lit(1.5)).alias("sh_c"),
        ((key % 7001) - F.lit(3500.0)).alias("sh_loc"),
        ((key % 3301) * F.lit(1.0)).alias("sh_scale"),
        F.when(key % 17 == 0, 0).otherwise(32).alias("hl_psd_size"),
        F.when(key % 41 == 0, 0).otherwise(16).alias("sh_psd_size"),
    )


def frames(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("frame_id"),
        (F.col("p_size") % 2).alias("strict_clear"),
        F.col("p_brand").alias("site"),
        F.col("p_type").alias("grp"),
    )


def raster(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    x = (F.col("l_orderkey") % 200).cast("int")
    dark = x.between(80, 99) | x.between(10, 14)
    return items.select(
        F.col("l_suppkey").alias("image_id"),
        x.alias("x"),
        F.col("l_linenumber").alias("y"),
        F.when(dark, F.col("l_quantity") / F.lit(25.0)).otherwise(F.col("l_quantity")).alias("v"),
    )


def strip(spark: SparkSession, folder: str) -> DataFrame:
    """Dense grey grid per image: 40 columns, one row per 8 pixels of the id order, values 0..255."""
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice")
    return items.select(
        (F.col("l_suppkey") % 10).alias("image_id"),
        (F.col("l_orderkey") % 40).cast("int").alias("x"),
        (F.floor(F.col("l_orderkey") / 40) % 40).cast("int").alias("y"),
        (F.floor(F.col("l_extendedprice")).cast("bigint") % 256).cast("int").alias("v"),
    )


def snapshot_a(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("cls"), F.md5("text").alias("digest")
    )


def snapshot_b(spark: SparkSession, folder: str) -> DataFrame:
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text"))
    return (
        table(spark, folder, "documents")
        .where(F.col("doc_id") % 97 != 0)
        .select("doc_id", F.col("source").alias("cls"), F.md5(changed).alias("digest"))
    )


def step_log(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    progress = (F.col("event_id") % 240) / F.lit(240.0)
    bad = F.when(F.col("event_id") % 1000 == 7, F.lit(2.0)).otherwise(F.lit(1.0))
    lr = bad * F.lit(1e-3) * F.pow(F.lit(1.0) + F.lit(10.0) * progress, F.lit(-0.75))
    coeff = F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(-10.0) * progress)) - F.lit(1.0)
    return events.select(
        F.col("event_id").alias("step"),
        F.col("user_id").alias("run_id"),
        progress.alias("progress"),
        F.lit(1e-3).alias("base_lr"),
        lr.alias("lr"),
        coeff.alias("coeff"),
    )


def access_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") == "error", "label_read").otherwise("train_step").alias("kind"),
        "value",
    )


def epoch_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Training-curve rows per (run, epoch) from the event stream; runs differ in length."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    return (
        events.groupBy(F.col("user_id").alias("run_id"), (F.col("event_id") % 40 + 1).cast("int").alias("epoch"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.max("event_id").alias("last_event"),
            F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("n_a"),
            F.sum(F.when(F.col("event_type") != "click", 1).otherwise(0)).alias("n_b"),
        )
        .select(
            "run_id",
            "epoch",
            "n_a",
            "n_b",
            ((F.col("last_event") % 512) / F.lit(256.0)).alias("train_loss"),
            ((F.col("last_event") % 1024) / F.lit(512.0)).alias("val_loss"),
            ((F.col("last_event") % 101) / F.lit(100.0)).alias("src_acc"),
        )
    )


# ---------------------------------------------------------------------------------------------
# The same tables as portable SQL.

VIEWS: dict[str, str] = {
    "preds": """
select a.arm, sd.seed, cast(o_orderkey % 5 as int) as fold, e.epoch, o_orderkey as sample_id, o_custkey as group_id,
       case when o_orderpriority like '1%' then 0 else 1 end as y_true,
       least(1024, ((o_orderkey * 7919 + sd.seed * 104729 + a.arm * 12997 + e.epoch * 15485863) % 769)
             + case when o_orderpriority like '1%' then 200 + 12 * a.arm else 0 end) / cast(1024 as double) as p0,
       1e0 - least(1024, ((o_orderkey * 7919 + sd.seed * 104729 + a.arm * 12997 + e.epoch * 15485863) % 769)
             + case when o_orderpriority like '1%' then 200 + 12 * a.arm else 0 end) / cast(1024 as double) as p1
from orders
cross join (select unnest([0, 1, 2, 3, 4]) as arm) a
cross join (select unnest([0, 1, 2, 3, 4]) as seed) sd
cross join (select unnest([36, 37, 38, 39, 40]) as epoch) e""",
    "avgp": """
select arm, seed, fold, sample_id, min(y_true) as y_true, avg(p0) as p0, avg(p1) as p1
from preds group by arm, seed, fold, sample_id""",
    "scored": "select *, case when p0 >= p1 then 0 else 1 end as y_pred from avgp",
    "conf": """
select arm, seed, fold,
       sum(case when y_true = 0 and y_pred = 0 then 1 else 0 end)::bigint as c00,
       sum(case when y_true = 0 and y_pred = 1 then 1 else 0 end)::bigint as c01,
       sum(case when y_true = 1 and y_pred = 0 then 1 else 0 end)::bigint as c10,
       sum(case when y_true = 1 and y_pred = 1 then 1 else 0 end)::bigint as c11
from scored group by arm, seed, fold""",
    "prf": """
select *, case when c00 + c10 = 0 then 0e0 else c00 / (c00 + c10) end as precision_0,
       case when c00 + c01 = 0 then 0e0 else c00 / (c00 + c01) end as recall_0,
       case when c11 + c01 = 0 then 0e0 else c11 / (c11 + c01) end as precision_1,
       case when c11 + c10 = 0 then 0e0 else c11 / (c11 + c10) end as recall_1
from conf""",
    "run_metrics": """
select *, (f1_0 + f1_1) / 2e0 as macro_f1 from (
  select *, case when precision_0 + recall_0 = 0 then 0e0 else 2e0 * precision_0 * recall_0 / (precision_0 + recall_0) end as f1_0,
         case when precision_1 + recall_1 = 0 then 0e0 else 2e0 * precision_1 * recall_1 / (precision_1 + recall_1) end as f1_1
  from prf)""",
    "ap_steps": """
select arm, seed, fold, p0, sum(case when y_true = 0 then 1 else 0 end) as pos, count(*) as n
from avgp group by arm, seed, fold, p0""",
    "run_ap": """
select arm, seed, fold, case when max(tp) = 0 or max(tp) = max(cn) then null
       else sum(pos / total * (tp / cn)) end as ap
from (select *, sum(pos) over (partition by arm, seed, fold order by p0 desc) as tp,
             sum(n) over (partition by arm, seed, fold order by p0 desc) as cn,
             sum(pos) over (partition by arm, seed, fold) as total from ap_steps)
group by arm, seed, fold""",
    "covariate": "select o_orderkey as sample_id, case when o_orderkey % 11 = 0 then null else o_totalprice end as cov from orders",
    "shift": """
select case when o_custkey % 2 = 0 then 'source' else 'target' end as domain, o_orderkey as sample_id,
       case when o_orderpriority like '1%' then 0 else 1 end as y_true,
       least(1024, ((o_orderkey * 7919 + 40 * 15485863) % 769)
             + case when o_orderpriority like '1%' then 200 else 0 end) / cast(1024 as double) as p0,
       1e0 - least(1024, ((o_orderkey * 7919 + 40 * 15485863) % 769)
             + case when o_orderpriority like '1%' then 200 else 0 end) / cast(1024 as double) as p1
from orders""",
    "feats": "select vec_id, case when label < 5 then 'source' else 'target' end as domain, embedding from embeddings",
    "feat_values": """
select vec_id, domain, d, cast(embedding[d] as double) as v
from feats, (select unnest(range(1, 65)) as d)""",
    "aug_views": "select sample_id, y_true, epoch - 36 as view_id, p0, p1 from preds where arm = 1 and seed = 0 and epoch < 40",
    "bank": """
select p_partkey as entry_id, case when p_partkey % 29 = 0 then null else p_size / 4e0 end as hl_c,
       (p_partkey % 1201) - 600e0 as hl_loc, (p_partkey % 523) * 1e0 as hl_scale, p_size * 1.5e0 as sh_c,
       (p_partkey % 7001) - 3500e0 as sh_loc, (p_partkey % 3301) * 1e0 as sh_scale,
       case when p_partkey % 17 = 0 then 0 else 32 end as hl_psd_size,
       case when p_partkey % 41 = 0 then 0 else 16 end as sh_psd_size from part""",
    "frames": "select p_partkey as frame_id, p_size % 2 as strict_clear, p_brand as site, p_type as grp from part",
    "raster": """
select l_suppkey as image_id, cast(l_orderkey % 200 as int) as x, l_linenumber as y,
       case when l_orderkey % 200 between 80 and 99 or l_orderkey % 200 between 10 and 14
            then l_quantity / 25e0 else l_quantity end as v from lineitem""",
    "strip": """
select l_suppkey % 10 as image_id, cast(l_orderkey % 40 as int) as x,
       cast((l_orderkey // 40) % 40 as int) as y,
       cast(cast(floor(l_extendedprice) as bigint) % 256 as int) as v from lineitem""",
    "snap_a": "select doc_id, source as cls, md5(text) as digest from documents",
    "snap_b": """
select doc_id, source as cls, md5(case when doc_id % 3 = 0 then concat(text, '#') else text end) as digest
from documents where doc_id % 97 <> 0""",
    "step_log": """
select event_id as step, user_id as run_id, (event_id % 240) / 240e0 as progress, 1e-3 as base_lr,
       case when event_id % 1000 = 7 then 2e0 else 1e0 end * 1e-3 * power(1e0 + 10e0 * ((event_id % 240) / 240e0), -0.75e0) as lr,
       2e0 / (1e0 + exp(-10e0 * ((event_id % 240) / 240e0))) - 1e0 as coeff
from events""",
    "access_log": """
select event_id, ts, user_id as run_id, case when event_type = 'error' then 'label_read' else 'train_step' end as kind, value
from events""",
    "curve": """
select run_id, epoch, n_a, n_b, (last_event % 512) / 256e0 as train_loss, (last_event % 1024) / 512e0 as val_loss,
       (last_event % 101) / 100e0 as src_acc
from (select user_id as run_id, cast(event_id % 40 + 1 as int) as epoch, max(event_id) as last_event,
             sum(case when event_type = 'click' then 1 else 0 end)::bigint as n_a,
             sum(case when event_type <> 'click' then 1 else 0 end)::bigint as n_b
      from events group by 1, 2)""",
}


def with_views(body: str) -> str:
    """Prefix `body` with the views it names, directly or through other views."""
    names: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in names and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in names:
                    names.append(name)

    visit(body)
    head = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
    return f"with {head}\n{body.strip()}" if names else body.strip()
