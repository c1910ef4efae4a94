"""Registered queries that write derived tables to shared storage and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..session import scratch_path
from ..sources import files, records, tables, writers
from .registry import query, rounded
from .run_health import epoch_histograms
from .sampling import _FOLDS, split_table
from .scoring import RUN, scored


def _splits(spark, folder):
    return split_table(spark, folder).select(
        "domain", "fold", "split", F.concat("label", F.lit("/"), "doc_id", F.lit(".png")).alias("filepath"), "label"
    )


@query("read_splits", f"""select * from (with {_FOLDS.strip()}
select domain, fold, split, label || '/' || doc_id || '.png' as filepath, label from sp where domain = 'en' and fold = 3 and split = 'test')""")
def _(spark, folder):
    path = scratch_path(spark, "splits")
    writers.write_splits(_splits(spark, folder), path)
    return records.read_splits(spark, path, "en", 3, "test").select("domain", "fold", "split", "filepath", "label")


@query("write_splits", f"""select * from (with {_FOLDS.strip()}, p as (select md5(concat_ws(',', domain, fold, split, label || '/' || doc_id || '.png', label)) as m from sp)
select count(*) as n, cast(sum(cast(cast('0x' || substr(m, 1, 15) as bigint) as hugeint)) as varchar) as h1, cast(sum(cast(cast('0x' || substr(m, 17, 15) as bigint) as hugeint)) as varchar) as h2 from p)""")
def _(spark, folder):
    path = scratch_path(spark, "splits-file")
    writers.write_splits_file(_splits(spark, folder), path)
    return writers.splits_hash(records.read_splits(spark, path, fmt="csv"))


@query("read_manifest", "select source || '/' || doc_id || '.txt' as path from documents")
def _(spark, folder):
    path = scratch_path(spark, "manifest")
    docs = tables.table(spark, folder, "documents")
    docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))).write.text(path)
    return files.read_manifest(spark, path)


@query("parse_sha256sums", "select source || '/' || doc_id || '.txt' as path, sha256(text) as digest from documents")
def _(spark, folder):
    path = scratch_path(spark, "sums")
    docs = tables.table(spark, folder, "documents")
    docs.select(F.concat(F.sha2("text", 256), F.lit("  "), "source", F.lit("/"), "doc_id", F.lit(".txt"))).write.text(path)
    return files.read_sha256sums(spark, path)


_CELL = "seed int, epochs int, c00 bigint, c01 bigint, c10 bigint, c11 bigint, macro_f1 double"


def _write_cells(spark, folder, path):
    runs = metrics.classification_metrics(scored(spark, folder), ["arm", "seed"])
    cell = F.concat(F.col("arm").cast("string"), F.lit("_seed"), F.col("seed").cast("string"))
    rows = runs.select(cell.alias("cell"), F.lit(40).alias("epochs"), "c00", "c01", "c10", "c11", "macro_f1")
    rows.write.partitionBy("cell").json(path)


_POOLED = """p as (select arm, seed, sum(c00)::bigint as c00, sum(c01)::bigint as c01, sum(c10)::bigint as c10, sum(c11)::bigint as c11 from conf group by 1, 2)"""


@query("read_run_records", f"""select * from (
with {_POOLED}
select arm, seed, 40 as epochs, c00, c01, c10, c11, round((2e0 * c00 / (2 * c00 + c01 + c10) + 2e0 * c11 / (2 * c11 + c01 + c10)) / 2, 9) as macro_f1 from p)""")
def _(spark, folder):
    path = scratch_path(spark, "records")
    _write_cells(spark, folder, path)
    return rounded(records.read_run_records(spark, path, _CELL, {"arm": range(5), "seed": range(5)}), "macro_f1")


@query("read_run_records_loose", f"select * from (with {_POOLED} select arm, seed, c00 + c11 as hits from p)")
def _(spark, folder):
    path = scratch_path(spark, "records")
    _write_cells(spark, folder, path)
    extra = metrics.confusion_counts(scored(spark, folder), ["arm", "seed"])
    extra.withColumn("cell", F.lit("notes")).write.mode("append").partitionBy("cell").json(path)
    return records.read_run_records(spark, path, _CELL).select("arm", "seed", (F.col("c00") + F.col("c11")).alias("hits"))


@query("read_records_envelope", "select user_id as run_id, event_id as epoch, event_id % 97 as airplane_count from events")
def _(spark, folder):
    record = F.struct(F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), (F.col("event_id") % 97).alias("airplane_count"))
    one = F.to_json(F.array(record))
    wrapped = F.to_json(F.struct(F.array(record).alias("epochs")))
    docs = tables.table(spark, folder, "events").select(F.when(F.col("event_id") % 2 == 0, one).otherwise(wrapped).alias("doc"))
    return records.read_records_envelope(docs, "doc", "struct<run_id: bigint, epoch: bigint, airplane_count: bigint>", "epochs")


@query("read_format_probes", """
select label as arm, 'arm' || label as arm_dir, class, round(avg(case when class = 'airplane' then list_sum([cast(x as double) for x in embedding[1:32]])
       else list_sum([cast(x as double) for x in embedding[33:64]]) end), 9) as auc_mean, count(*)::int as n_real
from embeddings, (select unnest(['airplane', 'ship']) as class) group by 1, 2, 3""")
def _(spark, folder):
    path = scratch_path(spark, "probes")
    emb = tables.table(spark, folder, "embeddings").withColumns({"a": tables.part_sum("embedding", 1, 32), "s": tables.part_sum("embedding", 33, 32)})
    side = lambda c: F.struct(F.avg(c).alias("auc_mean"), F.count(F.lit(1)).cast("int").alias("n_real"))
    docs = emb.groupBy(F.col("label").alias("arm")).agg(side("a").alias("airplane"), side("s").alias("ship"))
    docs.withColumn("arm_dir", F.concat(F.lit("arm"), "arm")).write.json(path)
    return rounded(records.read_format_probes(spark, path).select("arm", "arm_dir", "class", "auc_mean", "n_real"), "auc_mean")


@query("write_strict_json", """
select event_id, case when event_id % 50 = 0 then 'Infinity' when event_id % 50 = 1 then '-Infinity' else cast(event_id % 8 / 8e0 as varchar) end as t from events""")
def _(spark, folder):
    path = scratch_path(spark, "strict")
    e = F.col("event_id")
    t = F.when(e % 50 == 0, F.lit(float("inf"))).when(e % 50 == 1, F.lit(float("-inf"))).otherwise(e % 8 / F.lit(8.0))
    writers.write_strict_json(tables.table(spark, folder, "events").select("event_id", t.alias("t")), path)
    return spark.read.schema("event_id bigint, t string").json(path)


@query("append_log", "select run_id, count(*) as n, round(max(lr), 9) as max_lr from step_log group by 1")
def _(spark, folder):
    path = scratch_path(spark, "log")
    log = tables.step_log(spark, folder)
    writers.append_log(log.where("step % 2 = 0"), path)
    writers.append_log(log.where("step % 2 = 1"), path)
    return rounded(records.read_log(spark, path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("lr").alias("max_lr")), "max_lr")


@query("write_curve", "select run_id, epoch, case when epoch = 1 then null else val_loss end as churn, train_loss from curve")
def _(spark, folder):
    path = scratch_path(spark, "curve")
    curve = tables.epoch_curve(spark, folder)
    writers.write_curve(curve.select("run_id", "epoch", F.when(F.col("epoch") != 1, F.col("val_loss")).alias("churn"), "train_loss"), path)
    return spark.read.schema("run_id bigint, epoch int, churn double, train_loss double").option("header", True).csv(path)


@query("write_churn_matrix", """
select arm, epoch, seed as slot, max(case when n0 > n1 * 0.4e0 then 1 else 0 end) as pred from (
  select arm, seed, epoch, sum(case when p0 >= p1 then 1 else 0 end) as n0, sum(case when p0 < p1 then 1 else 0 end) as n1 from preds group by 1, 2, 3) group by 1, 2, 3""")
def _(spark, folder):
    path = scratch_path(spark, "matrix")
    hist = epoch_histograms(spark, folder).groupBy("arm", "seed", "epoch").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = hist.withColumn("pred", F.when(F.col("n0") > F.col("n1") * 0.4, 1).otherwise(0))
    writers.write_churn_matrix(rows, ["arm", "epoch"], "seed", "pred", 5, path)
    schema = "arm int, epoch int, " + ", ".join(f"a{i} int" for i in range(5))
    return writers.churn_long(spark.read.schema(schema).option("header", True).csv(path), ["arm", "epoch"], 5)


@query("write_labels_by_class", "select source as label, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1")
def _(spark, folder):
    path = scratch_path(spark, "labels")
    rows = tables.table(spark, folder, "documents").select("doc_id", "n_chars", F.col("source").alias("label"))
    writers.write_labels_by_class(rows, "label", path)
    return spark.read.schema("doc_id bigint, n_chars bigint, label string").parquet(path).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")
    )


@query("write_new_only", "select 'refused' as second_write, count(*) as n from labels")
def _(spark, folder):
    path = scratch_path(spark, "once")
    rows = tables.table(spark, folder, "labels")
    writers.write_new_only(rows, path)
    try:
        writers.write_new_only(rows, path)
        outcome = "overwrote"
    except Exception as exc:
        outcome = "refused" if "PATH_ALREADY_EXISTS" in str(exc) else "failed"
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(outcome).alias("second_write"), "n")


@query("read_access_log", """
select 'c' || event_id % 3 as caller, 'r' as reason, 'd' as domain, count(*) as n, sum(event_id % 10)::bigint as n_labels_read, min(ts)::varchar as first_read from events where event_type = 'error' group by 1""")
def _(spark, folder):
    path = scratch_path(spark, "access")
    e = F.col("event_id")
    line = F.concat_ws(
        "\t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.concat(F.lit("caller=c"), e % 3), F.lit("reason=r"), F.lit("csv=data/splits.csv"),
        F.lit("domain=d"), F.lit("fold=0"), F.lit("split=test"), F.concat(F.lit("n_labels_read="), e % 10),
    )
    tables.table(spark, folder, "events").where("event_type = 'error'").select(line).write.text(path)
    log = records.read_access_log(spark, path)
    out = log.groupBy("caller", "reason", "domain").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_labels_read").alias("n_labels_read"), F.min("ts").alias("t")
    )
    text = F.regexp_replace(F.date_format(F.to_utc_timestamp("t", F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return out.select("caller", "reason", "domain", "n", "n_labels_read", text.alias("first_read"))


@query("pending_after_write", "select arm, seed, fold, 'done' as state from conf")
def _(spark, folder):
    from ..operators import grid

    path = scratch_path(spark, "cells")
    metrics.confusion_counts(scored(spark, folder), RUN).withColumn("k", F.lit(5)).write.parquet(path)
    cells = grid.expected_grid(spark, {"arm": range(5), "seed": range(5), "fold": range(5)}).withColumn("k", F.lit(5))
    return grid.pending_cells(cells, spark.read.parquet(path), RUN, ["k"])




@query("scan_labeled_tree", "select 'cls=' || source as label, sum(octet_length(encode(text)) + 1)::bigint as n_bytes from documents group by 1")
def _(spark, folder):
    path = scratch_path(spark, "tree")
    docs = tables.table(spark, folder, "documents").select(F.col("source").alias("cls"), "text")
    docs.write.partitionBy("cls").text(path)
    tree = files.scan_labeled_tree(spark, path, ("txt",))
    return tree.groupBy("label").agg(F.sum("length").alias("n_bytes"))
