"""Registered queries over prediction tables: averaging, metrics, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration, metrics, predictions, ranking
from ..session import scratch_path
from ..sources import tables
from ..sources.writers import store_predictions
from .registry import off_tie, query, rnd, rounded

RUN = ["arm", "seed", "fold"]
SAMPLE = [*RUN, "sample_id"]


def averaged(spark, folder):
    return predictions.mean_checkpoints(tables.predictions(spark, folder), SAMPLE, expected_k=5)


def scored(spark, folder):
    return predictions.predict(averaged(spark, folder))


def run_counts(spark, folder):
    return metrics.confusion_counts(scored(spark, folder), RUN)


@query("mean_checkpoints", """
select arm, seed, fold, sample_id, min(y_true) as y_true, avg(p0) as p0, avg(p1) as p1, count(*) as n_checkpoints
from preds group by arm, seed, fold, sample_id""")
def _(spark, folder):
    return averaged(spark, folder)


@query("mean_checkpoints_stored", """
select arm, seed, fold, sample_id, min(y_true) as y_true, avg(p0) as p0, avg(p1) as p1, count(*) as n_checkpoints
from preds group by arm, seed, fold, sample_id""")
def _(spark, folder):
    path = scratch_path(spark, "predictions")
    buckets = tables.prediction_tasks(spark, folder)
    rows = tables.predictions(spark, folder, tasks=buckets).select(*RUN, "sample_id", "epoch", "y_true", "p0", "p1")
    stored = store_predictions(rows, path.rsplit("/", 1)[1].replace("-", "_"), path, buckets=buckets, sort=[*RUN, "epoch"])
    return predictions.mean_checkpoints(stored, [*RUN, "sample_id"])


@query("predict_argmax", "select arm, seed, fold, y_pred, count(*) as n from scored group by arm, seed, fold, y_pred")
def _(spark, folder):
    return scored(spark, folder).groupBy(*RUN, "y_pred").agg(F.count(F.lit(1)).alias("n"))


@query("predict_threshold", """
select arm, seed, fold, case when p0 >= 0.6e0 then 0 else 1 end as y_pred, count(*) as n
from avgp group by 1, 2, 3, 4""")
def _(spark, folder):
    out = predictions.predict(averaged(spark, folder), mode="threshold", threshold=0.6)
    return out.groupBy(*RUN, "y_pred").agg(F.count(F.lit(1)).alias("n"))


@query("confusion_matrix", """
select arm, seed, fold, t as true, q as pred,
       case when t = 0 and q = 0 then c00 when t = 0 then c01 when q = 0 then c10 else c11 end as n
from conf, (select unnest([0, 1]) as t), (select unnest([0, 1]) as q)""")
def _(spark, folder):
    return metrics.confusion_matrix(scored(spark, folder), RUN)


@query("classification_metrics", """
select arm, seed, fold, c00, c01, c10, c11, c00 + c01 as support_0, c10 + c11 as support_1,
       round(precision_0, 9) as precision_0, round(recall_0, 9) as recall_0, round(f1_0, 9) as f1_0,
       round(precision_1, 9) as precision_1, round(recall_1, 9) as recall_1, round(f1_1, 9) as f1_1,
       round(macro_f1, 9) as macro_f1 from run_metrics""")
def _(spark, folder):
    out = metrics.classification_metrics(scored(spark, folder), RUN)
    return rounded(out, "precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1", "macro_f1")


@query("metrics_from_confusion", """
select arm, seed, fold, round(precision_0, 9) as precision_airplane, round(recall_0, 9) as recall_airplane,
       round(f1_0, 9) as f1_airplane, round(precision_1, 9) as precision_ship, round(recall_1, 9) as recall_ship,
       round(f1_1, 9) as f1_ship, round(macro_f1, 9) as macro_f1, round((recall_0 + recall_1) / 2e0, 9) as balanced_accuracy,
       round(recall_0, 9) as aircraft_recall, round((c00 + c11) / (c00 + c01 + c10 + c11), 9) as accuracy
from run_metrics""")
def _(spark, folder):
    out = metrics.metrics_from_confusion(run_counts(spark, folder))
    return out.select(*RUN, *[rnd(m).alias(m) for m in metrics.SCALAR_METRICS])


@query("average_precision", """
select arm, seed, fold, round(ap, 9) as average_precision from run_ap""")
def _(spark, folder):
    out = ranking.average_precision(averaged(spark, folder), RUN)
    return out.select(*RUN, rnd("average_precision").alias("average_precision"))


@query("average_precision_histogram", """
with lv as (select arm, seed, fold, floor(p0 * 4096) / 4096e0 as level, y_true from avgp),
st as (select arm, seed, fold, level, sum(case when y_true = 0 then 1 else 0 end) as pos, count(*) as n from lv group by 1, 2, 3, 4),
cu as (select *, sum(pos) over (partition by arm, seed, fold order by level desc) as tp,
              sum(n) over (partition by arm, seed, fold order by level desc) as cn,
              sum(pos) over (partition by arm, seed, fold) as total from st)
select arm, seed, fold, round(sum(pos / total * (tp / cn)), 9) as average_precision from cu group by 1, 2, 3"""
       .replace("with lv as", "select * from (with lv as", 1) + ")")
def _(spark, folder):
    out = ranking.average_precision_histogram(averaged(spark, folder), RUN)
    return out.select(*RUN, rnd("average_precision").alias("average_precision"))


@query("roc_auc", """
select arm, seed, fold,
       round((sum(case when y_true = 0 then r else 0 end) - n0 * (n0 + 1) / 2e0) / (n0 * n1), 9) as roc_auc
from (select arm, seed, fold, y_true,
             (rank() over (partition by arm, seed, fold order by p0)
              + (count(*) over (partition by arm, seed, fold, p0) - 1) / 2e0) as r,
             cast(sum(case when y_true = 0 then 1 else 0 end) over (partition by arm, seed, fold) as double) as n0,
             cast(sum(case when y_true = 1 then 1 else 0 end) over (partition by arm, seed, fold) as double) as n1
      from avgp) group by arm, seed, fold, n0, n1""")
def _(spark, folder):
    out = ranking.roc_auc(averaged(spark, folder), RUN)
    return out.select(*RUN, rnd("roc_auc").alias("roc_auc"))


@query("imbalance_metrics", """
select arm, seed, fold,
       round(case when t0 * t1 * q0 * q1 > 0 then (c00 * c11 - c01 * c10) / sqrt(t0 * t1 * q0 * q1) else 0e0 end, 9) as mcc,
       round(case when n * n <> t0 * q0 + t1 * q1 then (n * (c00 + c11) - (t0 * q0 + t1 * q1)) / (n * n - (t0 * q0 + t1 * q1)) end, 9) as cohen_kappa,
       round(case when t0 > 0 and t1 > 0 then (c00 / t0 + c11 / t1) / 2e0 end, 9) as balanced_accuracy,
       round(case when t0 > 0 and t1 > 0 then sqrt((c00 / t0) * (c11 / t1)) end, 9) as gmean,
       case when t0 = 0 or t1 = 0 then 'undefined_class_recall' else 'ok' end as status
from (select *, cast(c00 + c01 as double) as t0, cast(c10 + c11 as double) as t1, cast(c00 + c10 as double) as q0,
             cast(c01 + c11 as double) as q1, cast(c00 + c01 + c10 + c11 as double) as n from conf)""")
def _(spark, folder):
    out = metrics.imbalance_metrics(run_counts(spark, folder)).drop("c00", "c01", "c10", "c11")
    return rounded(out, "mcc", "cohen_kappa", "balanced_accuracy", "gmean")


@query("directed_confusion", """
select arm, seed, fold, round(case when c00 + c01 > 0 then c01 / (c00 + c01) end, 9) as rate_0_to_1,
       round(case when c10 + c11 > 0 then c10 / (c10 + c11) end, 9) as rate_1_to_0 from conf""")
def _(spark, folder):
    out = metrics.directed_confusion(run_counts(spark, folder)).drop("c00", "c01", "c10", "c11")
    return rounded(out, "rate_0_to_1", "rate_1_to_0")


@query("brier", """
select arm, seed, fold, round(avg(b), 9) as brier, round(avg(case when y_true = 0 then b end), 9) as brier_0,
       round(avg(case when y_true = 1 then b end), 9) as brier_1
from (select *, power(p0 - case when y_true = 0 then 1e0 else 0e0 end, 2)
             + power(p1 - case when y_true = 1 then 1e0 else 0e0 end, 2) as b from avgp) group by 1, 2, 3""")
def _(spark, folder):
    return rounded(calibration.brier(averaged(spark, folder), RUN), "brier", "brier_0", "brier_1")


_BINS = """
with t as (
  select arm, seed, fold, 'top_label' as target, greatest(p0, p1) as s, case when y_pred = y_true then 1 else 0 end as e from scored
  union all select arm, seed, fold, '0', p0, case when y_true = 0 then 1 else 0 end from scored
  union all select arm, seed, fold, '1', p1, case when y_true = 1 then 1 else 0 end from scored),
b as (select arm, seed, fold, target, len(list_filter(range(1, 15), lambda i: i * (1e0 / 15) <= s)) as bin, s, e from t),
g as (select arm, seed, fold, target, bin, count(*) as n, avg(e) as o, avg(s) as x from b group by 1, 2, 3, 4, 5),
err as (select arm, seed, fold, target, sum(n * abs(o - x)) / sum(n) as ce, count(*) as n_bins_used, min(n) as smallest_bin
        from g group by 1, 2, 3, 4)
"""


@query("calibration_error", f"""select * from ({_BINS}
select arm, seed, fold, target, round(ce + 3.7e-12, 9) as calibration_error, n_bins_used, smallest_bin, smallest_bin < 10 as sparse from err)""")
def _(spark, folder):
    return off_tie(calibration.calibration_error(averaged(spark, folder), RUN), "calibration_error")


@query("classwise_calibration_error", f"""select * from ({_BINS}
select arm, seed, fold, round(max(case when target = 'top_label' then ce end) + 3.7e-12, 9) as ece,
       round(avg(case when target <> 'top_label' then ce end) + 3.7e-12, 9) as classwise_error from err group by 1, 2, 3)""")
def _(spark, folder):
    errors = calibration.calibration_error(averaged(spark, folder), RUN)
    return off_tie(calibration.classwise_calibration_error(errors, RUN), "ece", "classwise_error")


@query("confidence_entropy", """select * from (
with t as (select *, greatest(p0, p1) as c, case when p0 > 0 then -p0 * ln(p0) else 0e0 end
                  + case when p1 > 0 then -p1 * ln(p1) else 0e0 end as h from scored)
select arm, seed, fold, 'overall' as view, 'all' as value, round(avg(c) + 3.7e-12, 9) as mean_confidence, round(avg(h), 9) as mean_entropy, count(*) as n from t group by 1, 2, 3
union all select arm, seed, fold, 'true_class', cast(y_true as varchar), round(avg(c) + 3.7e-12, 9), round(avg(h), 9), count(*) from t group by 1, 2, 3, y_true
union all select arm, seed, fold, 'correctness', case when y_pred = y_true then 'correct' else 'wrong' end, round(avg(c) + 3.7e-12, 9), round(avg(h), 9), count(*) from t group by 1, 2, 3, 5)""")
def _(spark, folder):
    out = calibration.confidence_entropy(averaged(spark, folder), RUN)
    return off_tie(rounded(out, "mean_entropy"), "mean_confidence")


@query("stratified_metrics", """select * from (
with e as (select quantile_cont(cov, 0e0) as e0, quantile_cont(cov, 1 / 3e0) as e1, quantile_cont(cov, 2 / 3e0) as e2, quantile_cont(cov, 1e0) as e3 from covariate),
b as (select s.*, case when cov >= e2 then 2 when cov >= e1 then 1 else 0 end as bin,
             case when cov >= e2 then e2 when cov >= e1 then e1 else e0 end as lo,
             case when cov >= e2 then e3 when cov >= e1 then e2 else e1 end as hi
      from scored s join covariate c using (sample_id), e where cov is not null),
k as (select arm, seed, bin, lo, hi, sum(case when y_true = 0 and y_pred = 0 then 1 else 0 end)::bigint as c00,
             sum(case when y_true = 0 and y_pred = 1 then 1 else 0 end)::bigint as c01,
             sum(case when y_true = 1 and y_pred = 0 then 1 else 0 end)::bigint as c10,
             sum(case when y_true = 1 and y_pred = 1 then 1 else 0 end)::bigint as c11 from b group by 1, 2, 3, 4, 5),
m as (select *, c00 / (c00 + c10) as p0, c00 / (c00 + c01) as r0, c11 / (c11 + c01) as p1, c11 / (c11 + c10) as r1 from k)
select arm, seed, bin, round(lo, 6) as lo, round(hi, 6) as hi, c00 + c01 as support_0, c10 + c11 as support_1,
       round(2 * p0 * r0 / (p0 + r0), 9) as f1_0, round(2 * p1 * r1 / (p1 + r1), 9) as f1_1,
       (select count(*) from covariate where cov is null) as excluded, 'ok' as status, least(c00 + c01, c10 + c11) < 10 as sparse
from m)""")
def _(spark, folder):
    values = tables.covariate(spark, folder)
    # a hash join leaves the predictions where they are and unsorted; a task holds the covariates of its samples alone
    joined = scored(spark, folder).join(values.hint("shuffle_hash"), "sample_id")
    out = calibration.stratified_metrics(joined, "cov", 3, ["arm", "seed"], edges=calibration.quantile_edges(values, "cov", 3))
    return out.select(
        "arm", "seed", "bin", rnd("lo", 6).alias("lo"), rnd("hi", 6).alias("hi"), "support_0", "support_1",
        rnd("f1_0").alias("f1_0"), rnd("f1_1").alias("f1_1"), "excluded", "status", "sparse",
    )


@query("threshold_sweep", """select * from (
with t as (select unnest([0.1e0, 0.3e0, 0.45e0, 0.5e0, 0.55e0, 0.7e0, 0.9e0]) as threshold),
k as (select arm, seed, fold, threshold, sum(case when y_true = 0 and p0 >= threshold then 1 else 0 end)::bigint as c00,
             sum(case when y_true = 0 and p0 < threshold then 1 else 0 end)::bigint as c01,
             sum(case when y_true = 1 and p0 >= threshold then 1 else 0 end)::bigint as c10,
             sum(case when y_true = 1 and p0 < threshold then 1 else 0 end)::bigint as c11
      from avgp, t group by 1, 2, 3, 4),
m as (select *, case when c00 + c10 = 0 then 0e0 else c00 / (c00 + c10) end as a, case when c00 + c01 = 0 then 0e0 else c00 / (c00 + c01) end as b,
             case when c11 + c01 = 0 then 0e0 else c11 / (c11 + c01) end as c, case when c11 + c10 = 0 then 0e0 else c11 / (c11 + c10) end as d from k)
select arm, seed, fold, threshold, round((case when a + b = 0 then 0e0 else 2 * a * b / (a + b) end
       + case when c + d = 0 then 0e0 else 2 * c * d / (c + d) end) / 2, 9) as macro_f1, round(a, 9) as precision_0, round(b, 9) as recall_0,
       round((c00 + c10) / (c00 + c01 + c10 + c11), 9) as class0_fraction from m)""")
def _(spark, folder):
    out = metrics.threshold_sweep(averaged(spark, folder), RUN, [0.1, 0.3, 0.45, 0.5, 0.55, 0.7, 0.9], authorized=True, reason="registered diagnostic")
    return rounded(
        out.select(*RUN, "threshold", "macro_f1", "precision_0", "recall_0", "class0_fraction"),
        "macro_f1", "precision_0", "recall_0", "class0_fraction",
    )


@query("weighted_log_loss", """
select arm, seed, fold, round(sum(w * -ln(greatest(case when y_true = 0 then p0 else p1 end, 1e-12))) / sum(w), 9) as log_loss,
       round(avg(case when y_true = y_pred then 1e0 else 0e0 end), 9) as accuracy, count(*) as n
from (select *, case when y_true = 0 then 1.6e0 else 0.4e0 end as w from scored) group by 1, 2, 3""")
def _(spark, folder):
    return rounded(metrics.weighted_log_loss(scored(spark, folder), RUN, [1.6, 0.4]), "log_loss", "accuracy")


@query("class_weights_inverse", """
select y_true as cls, count(*) as n, round(sum(count(*)) over () / (count(*) over () * count(*)), 9) as weight from shift group by y_true""")
def _(spark, folder):
    counts = tables.shift(spark, folder).groupBy(F.col("y_true").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(metrics.class_weights(counts, "cls", "n", classes=[0, 1]), "weight")


@query("class_weights_effective", """
select cls, n, round(w / sum(w) over () * count(*) over (), 9) as weight
from (select y_true as cls, count(*) as n, (1 - 0.999e0) / (1 - power(0.999e0, count(*))) as w from shift group by y_true)""")
def _(spark, folder):
    counts = tables.shift(spark, folder).groupBy(F.col("y_true").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(metrics.class_weights(counts, "cls", "n", "effective_number", classes=[0, 1]), "weight")


@query("oof_summary", """
select arm, seed, round(avg(macro_f1), 9) as macro_f1_mean, round(stddev_samp(macro_f1), 9) as macro_f1_std,
       round(avg(f1_0), 9) as f1_0_mean, round(stddev_samp(f1_0), 9) as f1_0_std, sum(c00)::bigint as oof_c00, sum(c01)::bigint as oof_c01,
       sum(c10)::bigint as oof_c10, sum(c11)::bigint as oof_c11, count(*) as n_folds from run_metrics group by 1, 2""")
def _(spark, folder):
    folds = metrics.classification_metrics(scored(spark, folder), RUN)
    out = metrics.oof_summary(folds, ["arm", "seed"], ["macro_f1", "f1_0"])
    return rounded(out, "macro_f1_mean", "macro_f1_std", "f1_0_mean", "f1_0_std")


@query("extract_metric", """
select arm, seed, fold, 'per_class.class0.f1' as metric, round(f1_0, 9) as value from run_metrics""")
def _(spark, folder):
    records = score_records(spark, folder)
    return rounded(metrics.extract_metric(records, RUN, "per_class.class0.f1"), "value")


def score_records(spark, folder):
    """Nested score records as the record store holds them."""
    out = metrics.classification_metrics(scored(spark, folder), RUN)
    cls = lambda i: F.struct(*[F.col(f"{m}_{i}").alias(m) for m in ("precision", "recall", "f1", "support")])
    return out.select(
        *RUN,
        F.struct(
            "macro_f1",
            F.struct(cls(0).alias("class0"), cls(1).alias("class1")).alias("per_class"),
            F.array(F.array("c00", "c01"), F.array("c10", "c11")).alias("confusion_matrix"),
        ).alias("metrics"),
    )


@query("flatten_metrics", """
select arm, seed, fold, metric, round(value, 9) as value from (
  unpivot (select arm, seed, fold, macro_f1, precision_0, recall_0, f1_0, precision_1, recall_1, f1_1 from run_metrics)
  on macro_f1, precision_0, recall_0, f1_0, precision_1, recall_1, f1_1 into name metric value value)""")
def _(spark, folder):
    paths = {"macro_f1": "metrics.macro_f1"}
    for i in (0, 1):
        for m in ("precision", "recall", "f1"):
            paths[f"{m}_{i}"] = f"metrics.per_class.class{i}.{m}"
    return rounded(metrics.flatten_metrics(score_records(spark, folder), RUN, paths), "value")


@query("metric_plugin", """
select arm, seed, fold, round(sqrt(avg(power(p0 - case when y_true = 0 then 1e0 else 0e0 end, 2))), 9) as rmse from avgp group by 1, 2, 3""")
def _(spark, folder):
    error = F.pow(F.col("p0") - F.when(F.col("y_true") == 0, 1.0).otherwise(0.0), 2)
    metrics.register_metric("rmse", F.avg(error), F.sqrt("rmse"))
    return rounded(metrics.apply_metrics(averaged(spark, folder), RUN, ["rmse"]), "rmse")
