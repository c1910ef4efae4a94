"""Registered queries on record contracts, rosters, content and label access."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digests, scalars
from ..operators import audit, metrics, splits
from ..operators.predictions import blind
from ..operators.running import quantiles
from ..session import scratch_path
from ..sources import tables
from .registry import query, rounded
from .scoring import RUN, scored


def _labels(spark, folder):
    """Quality labels with every kind of defect injected by id."""
    d = F.col("doc_id")
    value = (
        F.when(d % 13 == 0, F.lit(None).cast("double")).when(d % 17 == 0, F.lit(float("nan"))).when(d % 19 == 0, F.lit(0.5))
        .when(d % 23 == 0, F.lit(7.0)).otherwise(F.col("quality").cast("double"))
    )
    return tables.table(spark, folder, "labels").select("doc_id", value.alias("label"))


@query("validate_labels", """
select doc_id, case when doc_id % 13 = 0 then 'label_missing' when doc_id % 17 = 0 then 'label_not_finite'
       when doc_id % 19 = 0 then 'label_not_integer' else 'label_unknown_class' end as rule
from labels where doc_id % 13 = 0 or doc_id % 17 = 0 or doc_id % 19 = 0 or doc_id % 23 = 0""")
def _(spark, folder):
    return audit.validate_labels(_labels(spark, folder), ["doc_id"], "label")


@query("quarantine_labels", """
select case when doc_id % 13 = 0 or doc_id % 17 = 0 or doc_id % 19 = 0 or doc_id % 23 = 0 then 'quarantined' else 'clean' end as state, count(*) as n from labels group by 1""")
def _(spark, folder):
    marked = audit.quarantine(_labels(spark, folder), audit.label_rules("label"))
    state = F.when(F.size("broken_rules") > 0, "quarantined").otherwise("clean")
    return marked.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("validate_probabilities", """
select sample_id, rule from (select sample_id,
  case when sample_id % 101 = 0 then 'wrong_width' when sample_id % 103 = 0 then 'not_finite' when sample_id % 107 = 0 then 'outside_unit_interval'
       when sample_id % 109 = 0 then 'row_sum' end as rule from shift) where rule is not null""")
def _(spark, folder):
    s = F.col("sample_id")
    p = (
        F.when(s % 101 == 0, F.array("p0"))
        .when(s % 103 == 0, F.array(F.lit(float("inf")), F.col("p1")))
        .when(s % 107 == 0, F.array(F.lit(1.5), F.lit(-0.5)))
        .when(s % 109 == 0, F.array(F.lit(0.25), F.lit(0.5)))
        .otherwise(F.array("p0", "p1"))
    )
    return audit.validate_probabilities(tables.shift(spark, folder).withColumn("probs", p), ["sample_id"], "probs")


def _run_records(spark, folder):
    """Run records per (arm, seed) with the confusion matrix over all folds; some records are corrupted."""
    counts = metrics.confusion_counts(scored(spark, folder), ["arm", "seed"])
    m = metrics.metrics_from_confusion(counts)
    arm, seed = F.col("arm"), F.col("seed")
    loss = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.lit(1.0) / (i + arm))
    macro = F.when((arm == 1) & (seed == 2), F.col("macro_f1") + 0.01).otherwise(F.col("macro_f1"))
    return m.select(
        "arm", "seed",
        F.when((arm == 2) & (seed == 0), 39).otherwise(40).alias("epochs"),
        F.lit("full").alias("train_subset"),
        F.array(F.array("c00", "c01"), F.array("c10", F.when((arm == 3) & (seed == 3), F.col("c11") + 1).otherwise(F.col("c11")))).alias("matrix"),
        F.struct("accuracy", macro.alias("macro_f1"), "balanced_accuracy").alias("metrics"),
        (F.lit(0.89) - macro).alias("gap"),
        loss.alias("losses"),
        F.when((arm == 4) & (seed == 4), F.array(F.lit(9.0), F.element_at(loss, -1))).otherwise(F.array(F.element_at(loss, 1), F.element_at(loss, -1))).alias("ends"),
        F.when((arm == 0) & (seed == 1), "xyz").otherwise(F.sha2(F.concat_ws("|", "arm", "seed"), 256)).alias("signature"),
        F.when((arm == 0) & (seed == 4), F.lit(None)).otherwise(F.md5(F.lit("target"))).alias("target_md5"),
    )


@query("validate_run_record", """select * from (
with p as (select arm, seed, sum(c00) as c00, sum(c01) as c01, sum(c10) as c10, sum(c11) as c11, sum(c11) + max(case when arm = 3 and seed = 3 then 1 else 0 end) as d11 from conf group by 1, 2),
m as (select *, (c00 + c11) / (c00 + c01 + c10 + c11) as acc, (c00 + d11) / (c00 + c01 + c10 + d11) as acc2,
             (c00 / (c00 + c01) + c11 / (c10 + c11)) / 2 as bal, (c00 / (c00 + c01) + d11 / (c10 + d11)) / 2 as bal2,
             (2e0 * c00 / (2 * c00 + c01 + c10) + 2e0 * c11 / (2 * c11 + c01 + c10)) / 2 + case when arm = 1 and seed = 2 then 0.01e0 else 0e0 end as mac,
             (2e0 * c00 / (2 * c00 + c01 + c10) + 2e0 * d11 / (2 * d11 + c01 + c10)) / 2 as mac2,
             case when arm = 2 and seed = 0 then 39 else 40 end as epochs,
             case when arm = 0 and seed = 1 then 'xyz' else sha256(arm || '|' || seed) end as signature,
             case when arm = 0 and seed = 4 then null else md5('target') end as target_md5,
             [1e0 / (i + arm) for i in range(1, 41)] as losses from p),
e as (select *, case when arm = 4 and seed = 4 then [9e0, losses[40]] else [losses[1], losses[40]] end as ends from m),
n as (select sum(case when y_true = 0 then 1 else 0 end) as n0, sum(case when y_true = 1 then 1 else 0 end) as n1 from shift)
select arm, seed, 'protocol_epochs' as rule from e where epochs <> 40
union all select arm, seed, 'digest_signature' from e where not regexp_full_match(signature, '[0-9a-f]{64}')
union all select arm, seed, 'digest_target_md5' from e where target_md5 is null or not regexp_full_match(target_md5, '[0-9a-f]{32}')
union all select arm, seed, 'matrix_row_0' from e, n where c00 + c01 <> n0 union all select arm, seed, 'matrix_row_1' from e, n where c10 + d11 <> n1
union all select arm, seed, 'metric_recomputed_accuracy' from e where abs(acc - acc2) > 1e-12
union all select arm, seed, 'metric_recomputed_macro_f1' from e where abs(mac - mac2) > 1e-12
union all select arm, seed, 'metric_recomputed_balanced_accuracy' from e where abs(bal - bal2) > 1e-12
union all select arm, seed, 'loss_endpoints' from e where abs(ends[1] - losses[1]) > 1e-12 or abs(ends[2] - losses[40]) > 1e-12
union all select arm, seed, 'loss_decreased' from e where losses[40] >= losses[1])""")
def _(spark, folder):
    records = _run_records(spark, folder)
    sizes = tables.shift(spark, folder).groupBy().agg(
        F.count_if(F.col("y_true") == 0).alias("n0"), F.count_if(F.col("y_true") == 1).alias("n1")
    ).first()
    cells = records.withColumns({f"c{i}{j}": F.col("matrix")[i][j] for i in (0, 1) for j in (0, 1)})
    again = metrics.metrics_from_confusion(cells)
    rules = audit.run_record_rules(
        {"epochs": 40, "train_subset": "full"}, "matrix", [sizes["n0"], sizes["n1"]],
        {f"metrics.{m}": F.col(m) for m in ("accuracy", "macro_f1", "balanced_accuracy")},
        "losses", 40, "ends", 0.89, "gap", ["signature"], ["target_md5"],
    )
    return audit.violations(again, ["arm", "seed"], rules)


@query("validate_score_record", """select * from (
with r as (select arm, seed, fold, c00 + c10 as n0, c01 + c11 as n1, (c00 + c10) / (c00 + c01 + c10 + c11) <= 0.02e0 or (c00 + c10) / (c00 + c01 + c10 + c11) >= 0.60e0 as again from conf)
select arm, seed, fold, 'authorization' as rule from r where arm = 1 and fold = 0
union all select arm, seed, fold, 'checkpoint_count' from r where seed = 3 and fold = 2
union all select arm, seed, fold, 'prediction_rule' from r where arm = 4 and seed = 0
union all select arm, seed, fold, 'stored_route' from r where arm = 2 and fold = 3
union all select arm, seed, fold, 'same_totals' from r where arm = 0 and seed = 4
union all select arm, seed, fold, 'stored_verdict' from r where cast(again as int) + cast(again as int) >= 2 and arm = 3)""")
def _(spark, folder):
    counts = metrics.confusion_counts(scored(spark, folder), RUN)
    n0, n1 = F.col("c00") + F.col("c10"), F.col("c01") + F.col("c11")
    share = n0 / (n0 + n1)
    flag = (share <= 0.02) | (share >= 0.60)
    arm, seed, fold = (F.col(c) for c in RUN)
    records = counts.select(
        *RUN,
        F.lit("contract-v1").alias("analysis_contract"),
        F.array(F.lit("airplane"), F.lit("ship")).alias("class_order"),
        (~((arm == 1) & (fold == 0))).alias("authorized"),
        F.lit("final scoring").alias("reason"),
        F.when((seed == 3) & (fold == 2), 4).otherwise(5).alias("n_checkpoints"),
        F.when((arm == 4) & (seed == 0), "threshold").otherwise("argmax").alias("mode"),
        n0.alias("last_k_n0"), n1.alias("last_k_n1"),
        F.when((arm == 2) & (fold == 3), ~flag).otherwise(flag).alias("last_k_collapsed"),
        flag.alias("last_epoch_collapsed"), F.lit(False).alias("any_epoch_collapsed"),
        (n0 + n1 + F.when((arm == 0) & (seed == 4), 1).otherwise(0)).alias("epoch_total"),
        F.when(arm == 3, F.lit(False)).otherwise(flag).alias("collapsed"),
    )
    return audit.violations(records, RUN, audit.score_record_rules("contract-v1", ["airplane", "ship"], 5))


@query("validate_probe_record", """select * from (
with p as (select label as arm, case when vec_id % 2 = 0 then 'airplane' else 'ship' end as class, count(*) as n, avg(embedding[1]) as a from embeddings group by 1, 2)
select arm, class, 'n_resamples' as rule from p where arm = 3 union all select arm, class, 'auc_mean' from p where arm = 7
union all select arm, class, 'n_balanced' from p where arm = 5 and class = 'ship')""")
def _(spark, folder):
    emb = tables.table(spark, folder, "embeddings")
    cls = F.when(F.col("vec_id") % 2 == 0, "airplane").otherwise("ship")
    rows = emb.groupBy(F.col("label").alias("arm"), cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    arm, air = F.col("arm"), F.col("class") == "airplane"
    records = rows.select(
        "arm", "class",
        F.when(air, 90).otherwise(400).alias("n_synthetic"), F.when(air, 66).otherwise(487).alias("n_real"),
        F.when(air, 66).when(arm == 5, 399).otherwise(400).alias("n_balanced_per_domain"),
        F.when(arm == 3, 19).otherwise(20).alias("n_resamples"), F.lit(5).alias("folds_per_resample"), F.lit(100).alias("n_auc_values"),
        F.when(arm == 7, 1.2).otherwise(0.8).alias("auc_mean"), F.lit(0.02).alias("auc_std"),
    )
    # Synthetic, real and balanced counts per class.
    rules = audit.probe_record_rules({"airplane": (90, 66, 66), "ship": (400, 487, 400)})
    return audit.violations(records, ["arm", "class"], rules)


@query("validate_cross_record_consistency", """select * from (
with g as (select source, count(*) as n, count(distinct lang) as dl, count(lang) as nl, count(case when doc_id % 10 <> 0 then 1 end) as np,
                  count(distinct case when doc_id % 10 <> 0 then 'v1' end) as dp from documents group by 1)
select source, 'lang_not_shared' as rule from g where not (dl = 1 and nl = n) union all select source, 'runner_partly_present' from g where np not in (0, n)
union all select source, 'runner_not_common' from g where dp > 1)""")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents").select("source", "lang", F.when(F.col("doc_id") % 10 != 0, "v1").alias("runner"))
    return audit.validate_cross_record_consistency(docs, ["source"], ["lang"], ["runner"])


# --- joins and matching ---------------------------------------------------------------------------


@query("align_labels", "select p.sample_id, p.p0, l.y_true from shift p join (select sample_id, y_true from shift) l using (sample_id)")
def _(spark, folder):
    rows = tables.shift(spark, folder)
    return audit.align_labels(rows.select("sample_id", "p0"), rows.select("sample_id", "y_true"), "sample_id")


@query("align_violations", """select * from (
with p as (select doc_id, 1 as n from documents where doc_id % 7 <> 0 union all select doc_id, 1 from documents where doc_id % 31 = 5),
a as (select doc_id, count(*) as n_pred from p group by 1), b as (select doc_id, count(*) as n_label from labels group by 1)
select doc_id, coalesce(n_pred, 0) as n_pred, coalesce(n_label, 0) as n_label,
       case when n_label is null then 'missing_label' when n_pred is null then 'extra_label' else 'duplicate_id' end as rule
from a full join b using (doc_id) where n_label is null or n_pred is null or n_pred > 1 or n_label > 1)""")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id")
    pred = docs.where("doc_id % 7 <> 0").unionByName(docs.where("doc_id % 31 = 5"))
    return audit.align_violations(pred, tables.table(spark, folder, "labels"), "doc_id")


@query("roster_diff", """
select doc_id, cls, 'a' as only_in from snap_a where doc_id not in (select doc_id from snap_b)
union all select doc_id + 1000000000, cls, 'b' from snap_b where doc_id % 89 = 1""")
def _(spark, folder):
    b = tables.snapshot_b(spark, folder).select("doc_id", "cls")
    extra = b.where("doc_id % 89 = 1").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
    return audit.roster_diff(tables.snapshot_a(spark, folder), b.unionByName(extra), ["doc_id", "cls"])


@query("content_diff", "select a.doc_id, case when a.digest = b.digest then 'unchanged' else 'changed' end as state from snap_a a join snap_b b using (doc_id)")
def _(spark, folder):
    return audit.content_diff(tables.snapshot_a(spark, folder), tables.snapshot_b(spark, folder), ["doc_id"], "digest", strict=False)


@query("control_equal", """
select doc_id, count(distinct digest) as n_digests, count(distinct arm) as n_arms
from (select doc_id, digest, 1 as arm from snap_a union all select doc_id, digest, 2 from snap_b union all select doc_id, digest, 3 from snap_a)
group by 1 having count(distinct digest) <> 1 or count(distinct arm) <> 3""")
def _(spark, folder):
    a, b = tables.snapshot_a(spark, folder), tables.snapshot_b(spark, folder)
    arms = a.withColumn("arm", F.lit(1)).unionByName(b.withColumn("arm", F.lit(2))).unionByName(a.withColumn("arm", F.lit(3)))
    return audit.control_equal(arms, ["doc_id"], "arm", "digest", 3)


@query("restrict_to", """
select doc_id, cls from snap_a where cls <> 'src7' or doc_id in (select doc_id from snap_b where doc_id % 3 = 0)""")
def _(spark, folder):
    changed = tables.snapshot_b(spark, folder).where("doc_id % 3 = 0").select("doc_id")
    return audit.restrict_to(tables.snapshot_a(spark, folder).select("doc_id", "cls"), "cls", "src7", changed, "doc_id")


@query("cache_lookup", """
select d.doc_id, l.s as score, case when l.s is null then 'cache_miss' end as error from documents d left join (select doc_id, cast(quality * 2 + toxic as double) as s from labels) l using (doc_id)""")
def _(spark, folder):
    cache = tables.table(spark, folder, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("double").alias("score"))
    return audit.cache_lookup(tables.table(spark, folder, "documents").select("doc_id"), cache, "doc_id", "score")


@query("cache_summary", """
select count(*) as n, count(s) as n_scored, count(*) - count(s) as n_missed, round(avg(s), 9) as mean, round(stddev_pop(s), 9) as std
from documents left join (select doc_id, quality * 2e0 + toxic as s from labels) using (doc_id)""")
def _(spark, folder):
    cache = tables.table(spark, folder, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("double").alias("score"))
    looked = audit.cache_lookup(tables.table(spark, folder, "documents").select("doc_id"), cache, "doc_id", "score")
    return rounded(audit.cache_summary(looked, "score"), "mean", "std")


@query("merge_verified", """
select doc_id, cls, digest from snap_a where cls = 'src7' union all select doc_id, cls, digest from snap_b where cls <> 'src7'""")
def _(spark, folder):
    a = tables.snapshot_a(spark, folder).where("cls = 'src7'")
    b = tables.snapshot_b(spark, folder).where("cls <> 'src7'")
    return splits.merge_verified(a, b, "doc_id", "digest", [tables.snapshot_a(spark, folder)])


@query("partition_of", """
select doc_id, case when doc_id % 97 = 0 and doc_id % 3 <> 0 then 'uncovered' else 'in_both' end as rule from documents
where (doc_id % 97 = 0 and doc_id % 3 <> 0) or (doc_id % 3 = 0 and doc_id % 97 <> 0 and doc_id % 2 = 0)""")
def _(spark, folder):
    a = tables.snapshot_a(spark, folder).where("doc_id % 3 = 0").select("doc_id")
    b = tables.snapshot_b(spark, folder).where("doc_id % 3 <> 0 or doc_id % 2 = 0").select("doc_id")
    return splits.partition_of(a, b, tables.snapshot_a(spark, folder).select("doc_id"), "doc_id")


@query("event_order_check", """
select event_id, a.run_id, ts <= training_end as early from access_log a join (select run_id, max(ts) as training_end from access_log where kind = 'train_step' group by 1) e using (run_id)
where kind = 'label_read' and ts <= training_end""")
def _(spark, folder):
    out = audit.event_order_check(tables.access_log(spark, folder), ["run_id"], "ts", "kind")
    return out.select("event_id", "run_id", (F.col("ts") <= F.col("training_end")).alias("early"))


@query("dataset_contract", """select * from (
with f as (select source as cls, count(*) as n, sum(case when n_chars % 300 + 100 <> 224 or doc_id % 200 + 50 <> 224 then 1 else 0 end)::bigint as n_other_size from documents group by 1),
x as (select coalesce(f.cls, e.cls) as cls, coalesce(n, 0) as n, coalesce(n_other_size, 0) as n_other_size, e.want from f full join (values ('src7', 100), ('missing', 5)) e(cls, want) on f.cls = e.cls)
select cls, n, n_other_size, 'class_count' as rule from x where want is null or n <> want
union all select cls, n, n_other_size, 'native_size' from x where cls = 'missing' and n_other_size = 0)""")
def _(spark, folder):
    files = tables.table(spark, folder, "documents").select(
        F.col("source").alias("cls"), (F.col("n_chars") % 300 + 100).alias("w"), (F.col("doc_id") % 200 + 50).alias("h")
    )
    return audit.dataset_contract(files, "cls", {"src7": 100, "missing": 5}, "w", "h", 224, "missing")


# --- label access -----------------------------------------------------------------------------------


@query("blind", "select sample_id, p0 from shift")
def _(spark, folder):
    return blind(tables.shift(spark, folder), ["sample_id", "p0"])


@query("authorized_labels", """
select 'scorer' as caller, 'final scoring' as reason, 'domain=target' as scope, count(*) as n_labels_read from shift where domain = 'target'""")
def _(spark, folder):
    path = scratch_path(spark, "label-access")
    rows, access = audit.authorized_labels(tables.shift(spark, folder), "y_true", "final scoring", "scorer", path, {"domain": "target"})
    rows.agg(F.avg("y_true")).collect()
    access.record()
    return spark.read.json(path, schema="caller string, reason string, scope string, n_labels_read bigint, timestamp string").drop("timestamp")


# --- digests ------------------------------------------------------------------------------------------


@query("canonical_json_sha256", """
select doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') as digest from documents""")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents")
    return docs.select("doc_id", digests.canonical_json_sha256(["source", "doc_id", "lang"]).alias("digest"))


@query("file_digest", "select doc_id, sha256(text) as sha, md5(text) as md from documents")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents")
    return docs.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), F.md5(F.encode("text", "UTF-8")).alias("md"))


@query("manifest_fingerprint", """
select source, md5(string_agg(lang || '/' || doc_id || ':' || md5(text), '|' order by lang, cast(doc_id as varchar))) as fingerprint, count(*) as n_entries
from documents group by 1""")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents").select("source", "lang", "doc_id", F.md5("text").alias("digest"))
    return digests.manifest_fingerprint(docs, ["source"], "lang", "doc_id", "digest")


@query("name_set_signature", """
select source, sha256(string_agg(chr(0) || chr(0) || chr(0) || chr(octet_length(encode(n))::int) || n, '' order by n)) as signature, count(*) as n_names
from (select source, 'doc_' || lang || '_' || doc_id || '.txt' as n from documents) group by 1""")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents")
    names = docs.select("source", F.concat(F.lit("doc_"), "lang", F.lit("_"), "doc_id", F.lit(".txt")).alias("name"))
    return digests.name_set_signature(names, ["source"], "name")


@query("tree_signature", """select * from (
with a as (select lang, substr(md5(cast(doc_id as varchar)), 1, 6) as k, source || '/' || doc_id || ':' || md5(text) as e from documents),
b as (select lang, k, sha256(string_agg(e, chr(10) order by e)) as e, count(*) as n from a group by 1, 2),
c as (select lang, substr(k, 1, 3) as k, sha256(string_agg(k || ':' || e, chr(10) order by k || ':' || e)) as e, sum(n) as n from b group by 1, 2)
select lang, sha256(string_agg(k || ':' || e, chr(10) order by k || ':' || e)) as root, sum(n)::bigint as n_entries from c group by 1)""")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents").select("lang", "source", "doc_id", F.md5("text").alias("digest"))
    return digests.tree_signature(docs, ["lang"], "source", "doc_id", "digest")


@query("path_checks", """select * from (
with p as (select page_id, case when page_id % 5 = 0 then '../' || page_id when page_id % 5 = 1 then 'a/../../' || page_id when page_id % 5 = 2 then '/abs/' || page_id
                  when page_id % 5 = 3 then 'a\\b\\' || page_id else 'a/./b/../' || page_id end as path, url from pages)
select page_id, replace(path, '\\', '/') as path, page_id % 5 >= 3 as inside, regexp_matches(url, '([A-Za-z]:[\\\\/][^\\\\/]|/home/|/Users/|\\\\\\\\[A-Za-z0-9])') as leaks from p)""")
def _(spark, folder):
    i = F.col("page_id")
    path = (
        F.when(i % 5 == 0, F.concat(F.lit("../"), i)).when(i % 5 == 1, F.concat(F.lit("a/../../"), i)).when(i % 5 == 2, F.concat(F.lit("/abs/"), i))
        .when(i % 5 == 3, F.concat(F.lit("a\\b\\"), i)).otherwise(F.concat(F.lit("a/./b/../"), i))
    )
    pages = tables.table(spark, folder, "pages").select("page_id", "url", path.alias("path"))
    return pages.select(
        "page_id", digests.normalise_path("path").alias("path"), digests.stays_inside("path").alias("inside"), digests.leaks_local_path("url").alias("leaks")
    )


@query("local_path_leak_scan", """
with d as (select doc_id, text || case doc_id % 9 when 1 then ' /home/x' when 2 then ' C:\\x' when 3 then ' \\\\host' when 4 then ' D:/y' when 5 then ' /homes/x'
  when 6 then ' C:\\\\' when 7 then ' \\host' when 8 then ' http://home' else '' end as text from documents)
select doc_id from d where regexp_matches(text, '/home/|/Users/') or regexp_matches(text, '[A-Za-z]:[\\\\/]([^\\\\/]|$)') or regexp_matches(text, '\\\\\\\\[A-Za-z0-9]')""")
def _(spark, folder):
    # hits and near misses by id, after the whole text
    ends = [" /home/x", " C:\\x", " \\\\host", " D:/y", " /homes/x", " C:\\\\", " \\host", " http://home"]
    tail = F.lit("")
    for i, end in enumerate(ends, 1):
        tail = F.when(F.col("doc_id") % 9 == i, F.lit(end)).otherwise(tail)
    documents = tables.table(spark, folder, "documents").withColumn("text", F.concat("text", tail))
    return documents.where(digests.leaks_local_path("text")).select("doc_id")


@query("verify_sha256sums", """
select source || '/' || doc_id || '.txt' as path, case when doc_id % 97 = 0 then 'missing_file' else 'digest_mismatch' end as rule from documents where doc_id % 97 = 0 or doc_id % 3 = 0""")
def _(spark, folder):
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))
    docs = tables.table(spark, folder, "documents")
    lines = docs.select(F.concat(F.sha2("text", 256), F.lit("  "), path).alias("value"))
    found = docs.where("doc_id % 97 <> 0").select(
        path.alias("path"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text")), 256).alias("digest")
    )
    return audit.verify_sha256sums(audit.parse_sha256sums(lines), found)


# --- scalar functions -----------------------------------------------------------------------------------


@query("scalar_functions", """
select event_id, case when event_id % 4 = 0 then 0e0 else value / (event_id % 4) end as div, round(case when value >= 60 then value else 60 * exp((value - 60) / 60) end, 9) as floor_knee,
       round(case when value <= 255 - 200 then value else 255 - 200 * exp((55 - value) / 200e0) end, 9) as ceil_knee,
       case event_type when 'click' then 0 when 'view' then 1 when 'error' then 2 end as class_id from events""")
def _(spark, folder):
    return tables.table(spark, folder, "events").select(
        "event_id", scalars.safe_div("value", F.col("event_id") % 4).alias("div"),
        F.round(scalars.soft_floor("value", 60.0), 9).alias("floor_knee"), F.round(scalars.soft_ceil("value", 200.0), 9).alias("ceil_knee"),
        scalars.class_index("event_type", ["click", "view", "error"]).alias("class_id"),
    )


@query("softmax_entropy", """select * from (
with z as (select vec_id, [list_sum([cast(x as double) for x in embedding[1:22]]) / 8, list_sum([cast(x as double) for x in embedding[23:43]]) / 8,
                           list_sum([cast(x as double) for x in embedding[44:64]]) / 8] as z from embeddings),
e as (select vec_id, list_transform(z, lambda x: exp((x - list_max(z)) / 0.25e0)) as e from z), p as (select vec_id, list_transform(e, lambda x: x / list_sum(e)) as p from e)
select vec_id, round(p[1], 9) as p0, round(p[2], 9) as p1, round(p[3], 9) as p2, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 9) as h_skip,
       round(-list_sum(list_transform(p, lambda x: greatest(x, 1e-12) * ln(greatest(x, 1e-12)))), 9) as h_clip, round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-5))), 9) as h_offset from p)""")
def _(spark, folder):
    z = [tables.part_sum("embedding", start, n) / 8 for start, n in ((1, 22), (23, 21), (44, 21))]
    probs = tables.table(spark, folder, "embeddings").select("vec_id", *[p.alias(f"p{i}") for i, p in enumerate(scalars.softmax(z, 0.25))])
    cols = ["p0", "p1", "p2"]
    out = probs.withColumns({f"h_{g}": scalars.entropy(cols, g) for g in ("skip", "clip", "offset")})
    return rounded(out, *cols, "h_skip", "h_clip", "h_offset")


@query("conditional_features", """
select sample_id, p0 * f1 as a, p0 * f2 as b, p1 * f1 as c, p1 * f2 as d
from (select *, sample_id % 10 / 4e0 as f1, sample_id % 7 / 8e0 as f2 from shift)""")
def _(spark, folder):
    s = F.col("sample_id")
    feats = F.array((s % 10) / F.lit(4.0), (s % 7) / F.lit(8.0))
    out = tables.shift(spark, folder).select("sample_id", scalars.conditional_features(["p0", "p1"], feats).alias("f"))
    return out.select("sample_id", *[F.col("f")[i].alias(n) for i, n in enumerate("abcd")])


@query("class_id_map", "select source, idx, count(*) as n from (select source, case source when 'src7' then 0 when 'src1' then 1 when 'src2' then 2 end as idx from documents) group by 1, 2")
def _(spark, folder):
    docs = tables.table(spark, folder, "documents")
    return docs.select("source", scalars.class_index("source", ["src7", "src1", "src2"]).alias("idx")).groupBy("source", "idx").agg(F.count(F.lit(1)).alias("n"))


@query("quantile_summary", """
select event_type, round(quantile_cont(value, 0.025), 6) as q025, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.975), 6) as q975 from events group by 1""")
def _(spark, folder):
    events = tables.table(spark, folder, "events")
    out = quantiles(events, ["event_type"], "value", {"q025": 0.025, "q50": 0.5, "q975": 0.975})
    return rounded(out.drop("n"), "q025", "q50", "q975", digits=6)


@query("timestamp_parse", "select event_id, ts from events")
def _(spark, folder):
    text = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    events = tables.table(spark, folder, "events").select("event_id", text.alias("iso"))
    return events.select("event_id", F.to_timestamp_ntz("iso", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("ts"))


