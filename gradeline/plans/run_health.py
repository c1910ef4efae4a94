"""Registered queries on run health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health, metrics, predictions
from ..sources import tables
from .registry import off_tie, query, rounded
from .scoring import RUN, averaged, scored

EPOCH = [*RUN, "epoch"]


def epoch_histograms(spark, folder):
    rows = predictions.predict(tables.predictions(spark, folder))
    return rows.groupBy(*EPOCH).agg(
        F.count_if(F.col("y_pred") == 0).alias("n0"), F.count_if(F.col("y_pred") == 1).alias("n1")
    )


_HIST = """
hist as (select arm, seed, fold, epoch, sum(case when p0 >= p1 then 1 else 0 end)::bigint as n0,
                sum(case when p0 < p1 then 1 else 0 end)::bigint as n1 from preds group by 1, 2, 3, 4)"""


@query("select_last_k", """
select user_id as run_id, name, epoch from (
  select user_id, 'run_epoch' || (event_id % 41) || '.pth' as name, event_id % 41 as epoch,
         row_number() over (partition by user_id order by event_id % 41 desc) as k
  from (select distinct user_id, event_id % 41 as event_id from events where event_type <> 'error')) where k <= 5""")
def _(spark, folder):
    events = tables.table(spark, folder, "events")
    stem = F.when(F.col("event_type") == "error", "other_epoch").otherwise("run_epoch")
    names = events.select(
        F.col("user_id").alias("run_id"), F.concat(stem, F.col("event_id") % 41, F.lit(".pth")).alias("name")
    ).distinct()
    return predictions.select_last_k(names, ["run_id"], "name", "run", 5)


@query("last_k_violations", """select * from (
with n as (select user_id as run_id, case when event_type = 'error' then 'x' else 'run' end || '_epoch' || (event_id % 11) || '.pth' as name,
                  event_type, event_id % 11 as epoch from events)
select run_id, 'duplicate_epoch' as rule, epoch from n where event_type <> 'error' group by run_id, epoch having count(*) > 1
union all select run_id, 'no_checkpoint', null from n group by run_id having sum(case when event_type <> 'error' then 1 else 0 end) = 0)""")
def _(spark, folder):
    events = tables.table(spark, folder, "events")
    stem = F.when(F.col("event_type") == "error", "x_epoch").otherwise("run_epoch")
    names = events.select(F.col("user_id").alias("run_id"), F.concat(stem, F.col("event_id") % 11, F.lit(".pth")).alias("name"))
    return predictions.last_k_violations(names, ["run_id"], "name", "run")


@query("churn", """
select arm, seed, epoch, round(avg(case when prev is null then null when prev <> q then 1e0 else 0e0 end), 9) as churn, count(*) as n_samples
from (select *, lag(q) over (partition by arm, seed, sample_id order by epoch) as prev
      from (select *, case when p0 >= p1 then 0 else 1 end as q from preds)) group by 1, 2, 3""")
def _(spark, folder):
    rows = predictions.predict(tables.predictions(spark, folder))
    return rounded(predictions.churn(rows, ["arm", "seed"], "sample_id", "epoch", "y_pred"), "churn")


@query("collapse_from_counts", f"""select * from (with {_HIST.strip()}
select arm, seed, fold, epoch, n0, n1, round(n0 / (n0 + n1), 9) as class0_fraction, n0 + n1 as total,
       n0 / (n0 + n1) <= 0.02e0 or n0 / (n0 + n1) >= 0.60e0 as collapsed from hist)""")
def _(spark, folder):
    return rounded(health.collapse_from_counts(epoch_histograms(spark, folder), "n0", "n1"), "class0_fraction")


@query("collapse_from_predictions", """
select arm, seed, fold, n0, n1, round(n0 / (n0 + n1), 9) as class0_fraction, n0 + n1 as total, n0 / (n0 + n1) <= 0.02e0 or n0 / (n0 + n1) >= 0.60e0 as collapsed
from (select arm, seed, fold, c00 + c10 as n0, c01 + c11 as n1 from conf)""")
def _(spark, folder):
    return rounded(health.collapse_from_predictions(scored(spark, folder), RUN), "class0_fraction")


_ROUTES = """
rt as (select arm, seed, fold, max(epoch) as last_epoch, arg_max(n0, epoch) as last_n0, arg_max(n1, epoch) as last_n1,
              bool_or(n0 = 0 or n1 = 0) as any_epoch_single_class, count(*) as n_epochs, max(n0 + n1) as total from hist group by 1, 2, 3),
rs as (select *, last_n0 / (last_n0 + last_n1) <= 0.02e0 or last_n0 / (last_n0 + last_n1) >= 0.60e0 as last_epoch_collapsed from rt)"""


@query("epoch_collapse_routes", f"""select * from (with {_HIST.strip()}, {_ROUTES.strip()}
select arm, seed, fold, last_epoch, last_n0, last_n1, last_epoch_collapsed, any_epoch_single_class, n_epochs, total from rs)""")
def _(spark, folder):
    return health.epoch_collapse_routes(epoch_histograms(spark, folder), RUN, "epoch", "n0", "n1").drop("collapsed_epochs")


@query("triangulate", """
select event_id, r1, r2, r3, t as true_votes, f as false_votes, t + f as n_valid_routes, (t + f > 0) and (t = 0 or f = 0) as unanimous,
       case when t + f >= 2 and t <> f then t > f end as verdict, t + f < 2 or not ((t + f > 0) and (t = 0 or f = 0)) as disagreement_warning
from (select *, case when r1 then 1 else 0 end + case when r2 then 1 else 0 end + case when r3 then 1 else 0 end as t,
             case when not r1 then 1 else 0 end + case when not r2 then 1 else 0 end + case when not r3 then 1 else 0 end as f
      from (select event_id, case when event_id % 3 = 0 then null else event_id % 3 = 1 end as r1,
                   case when event_id % 5 = 0 then null else event_id % 5 > 2 end as r2,
                   case when event_id % 7 < 3 then null else event_id % 7 < 5 end as r3 from events))""")
def _(spark, folder):
    e = F.col("event_id")
    routes = tables.table(spark, folder, "events").select(
        "event_id",
        F.when(e % 3 != 0, e % 3 == 1).alias("r1"),
        F.when(e % 5 != 0, e % 5 > 2).alias("r2"),
        F.when(e % 7 >= 3, e % 7 < 5).alias("r3"),
    )
    return health.triangulate(routes, ["r1", "r2", "r3"])


@query("collapse_enrich", f"""select * from (with {_HIST.strip()}, {_ROUTES.strip()},
lk as (select arm, seed, fold, (c00 + c10) / (c00 + c01 + c10 + c11) <= 0.02e0 or (c00 + c10) / (c00 + c01 + c10 + c11) >= 0.60e0 as last_k_collapsed from conf),
vt as (select *, cast(last_epoch_collapsed as int) + cast(last_k_collapsed as int) + cast(any_epoch_single_class as int) as t from rs join lk using (arm, seed, fold))
select arm, seed, fold, last_epoch_collapsed, last_k_collapsed, any_epoch_single_class, total, t as true_votes, t >= 2 as collapsed, t not in (0, 3) as disagreement_warning from vt)""")
def _(spark, folder):
    last_k = health.collapse_from_predictions(scored(spark, folder), RUN).select(*RUN, "n0", "n1")
    out = health.collapse_enrich(last_k, epoch_histograms(spark, folder), RUN)
    return out.select(*RUN, "last_epoch_collapsed", "last_k_collapsed", "any_epoch_single_class", "total", "true_votes", "collapsed", "disagreement_warning")


@query("pseudo_label_health", """
select arm, seed, fold, epoch, sum(case when p0 >= p1 then 1 else 0 end)::bigint as n0, sum(case when p0 < p1 then 1 else 0 end)::bigint as n1,
       round(avg(-greatest(p0, 1e-12) * ln(greatest(p0, 1e-12)) - greatest(p1, 1e-12) * ln(greatest(p1, 1e-12))), 9) as mean_entropy,
       false as has_nan, count(*) as n, sum(case when p0 >= p1 then 1 else 0 end) in (0, count(*)) as all_one_class from preds group by 1, 2, 3, 4""")
def _(spark, folder):
    return rounded(health.pseudo_label_health(tables.predictions(spark, folder), EPOCH), "mean_entropy")


@query("dominant_share", """
select arm, seed, fold, case when c00 + c10 >= c01 + c11 then 0 else 1 end as dominant_class,
       round(greatest(c00 + c10, c01 + c11) / (c00 + c01 + c10 + c11), 9) as dominant_share from conf""")
def _(spark, folder):
    return rounded(health.dominant_share(scored(spark, folder), RUN, "y_pred"), "dominant_share")


_TAIL = "tl as (select *, row_number() over (partition by run_id order by epoch desc) as k from curve)"


@query("tail_stats", f"""select * from (with {_TAIL}
select run_id, round(avg(train_loss), 9) as tail_mean, round(stddev_pop(train_loss), 9) as tail_std, count(*) as n_tail from tl where k <= 5 group by 1)""")
def _(spark, folder):
    return rounded(health.tail_stats(tables.epoch_curve(spark, folder), ["run_id"], "epoch", "train_loss"), "tail_mean", "tail_std")


@query("convergence_check", f"""select * from (with {_TAIL},
g as (select run_id, arg_min(train_loss, epoch) as loss_first, arg_max(train_loss, epoch) as loss_last, false as nan_seen,
             avg(case when k <= 5 then train_loss end) as tail_mean, stddev_pop(case when k <= 5 then train_loss end) as tail_std from tl group by 1)
select run_id, loss_first, loss_last, nan_seen, round(tail_mean, 9) as tail_mean, round(tail_std, 9) as tail_std, loss_last < loss_first as loss_decreased,
       round(case when tail_mean > 1e-9 then tail_std / tail_mean end, 9) as plateau_ratio,
       coalesce(case when tail_mean > 1e-9 then tail_std / tail_mean end < 0.15, false) as plateau_ok from g)""")
def _(spark, folder):
    out = health.convergence_check(tables.epoch_curve(spark, folder), ["run_id"], "epoch", "train_loss")
    return rounded(out, "tail_mean", "tail_std", "plateau_ratio")


@query("overfit_check", """select * from (
with o as (select *, row_number() over (partition by run_id order by val_loss, epoch) as b, row_number() over (partition by run_id order by epoch desc) as z from curve),
j as (select x.run_id, x.epoch as be, x.val_loss as bv, x.train_loss as bt, y.epoch as le, y.val_loss as lv, y.train_loss as lt from o x join o y using (run_id) where x.b = 1 and y.z = 1)
select run_id, be as best_epoch, bv as best_val_loss, round(lv - bv, 9) as val_rebound, lt < bt as train_still_falling, round(lv - lt, 9) as generalisation_gap,
       be < le - 2 and lv - bv > 1e-3 and lt < bt as overfit from j)""")
def _(spark, folder):
    out = health.overfit_check(tables.epoch_curve(spark, folder), ["run_id"], "epoch", "train_loss", "val_loss")
    return rounded(out.drop("n_epochs"), "val_rebound", "generalisation_gap")


@query("schedule_audit", """
select run_id, round(max(err), 9) as max_rel_err, sum(case when err >= 1e-3 then 1 else 0 end)::bigint as n_bad, count(*) as n,
       round(max(abs(coeff - (2e0 / (1e0 + exp(-10e0 * progress)) - 1e0))), 9) as max_ramp_err, sum(case when err >= 1e-3 then 1 else 0 end) = 0 as schedule_ok
from (select *, abs(lr - base_lr * power(1e0 + 10e0 * progress, -0.75e0)) / greatest(base_lr * power(1e0 + 10e0 * progress, -0.75e0), 1e-12) as err from step_log) group by 1""")
def _(spark, folder):
    out = health.schedule_audit(tables.step_log(spark, folder), ["run_id"], "lr", "base_lr", "progress", "coeff")
    return rounded(out, "max_rel_err", "max_ramp_err")


@query("run_health_verdict", """select * from (
with c as (select *, epoch / 40e0 as coeff, train_loss as alignment_loss, 1e0 + (n_a - n_b) / 1e5 as w0, 1e0 as w1,
                  case when n_a > n_b then 'optimal' else 'skipped' end as status, n_a = 0 or n_b = 0 as collapsed from curve),
g as (select run_id, arg_max(coeff, epoch) as lc, arg_min(coeff, epoch) as fc, arg_max(alignment_loss, epoch) as la, arg_max(src_acc, epoch) as ls, arg_max(w0, epoch) as lw,
             bool_or(status = 'optimal') as any_optimal_solve, bool_or(collapsed) as any_epoch_collapsed from c group by 1)
select run_id, lc > 0.9 and lc > fc as coeff_ramped, la > 0.2 as alignment_alive, ls > 0.5 as source_healthy, abs(lw - 1) > 1e-4 as weights_moved,
       any_optimal_solve, any_epoch_collapsed, false as any_nan from g)""")
def _(spark, folder):
    a, b = F.col("n_a"), F.col("n_b")
    curve = tables.epoch_curve(spark, folder).withColumns({
        "coeff": F.col("epoch") / F.lit(40.0),
        "alignment_loss": F.col("train_loss"),
        "w0": F.lit(1.0) + (a - b) / F.lit(1e5),
        "w1": F.lit(1.0),
        "solver_status": F.when(a > b, "optimal").otherwise("skipped"),
        "collapsed": (a == 0) | (b == 0),
        "nan": F.isnan("train_loss"),
    })
    return health.run_health_verdict(curve, ["run_id"])


@query("oracle_best_epoch", """select * from (
with k as (select arm, seed, epoch, sum(case when y_true = 0 and p0 >= p1 then 1 else 0 end) as c00, sum(case when y_true = 0 and p0 < p1 then 1 else 0 end) as c01,
                  sum(case when y_true = 1 and p0 >= p1 then 1 else 0 end) as c10, sum(case when y_true = 1 and p0 < p1 then 1 else 0 end) as c11 from preds group by 1, 2, 3),
m as (select arm, seed, epoch, c00 / (c00 + c10) as precision_0, c00 / (c00 + c01) as recall_0, c11 / (c11 + c01) as precision_1, c11 / (c11 + c10) as recall_1 from k),
f as (select *, (2 * precision_0 * recall_0 / (precision_0 + recall_0) + 2 * precision_1 * recall_1 / (precision_1 + recall_1)) / 2 as macro_f1 from m),
l as (select arm, seed, epoch, metric, value from (unpivot (select arm, seed, epoch, macro_f1, precision_0, recall_0 from f) on macro_f1, precision_0, recall_0 into name metric value value)),
r as (select *, row_number() over (partition by arm, seed, metric order by value desc, epoch) as n from l)
select arm, seed, metric, epoch as best_epoch, round(value, 9) as best_value from r where n = 1)""")
def _(spark, folder):
    rows = predictions.predict(tables.predictions(spark, folder))
    per_epoch = metrics.classification_metrics(rows, ["arm", "seed", "epoch"])
    out = health.oracle_best_epoch(per_epoch, ["arm", "seed"], "epoch", ["macro_f1", "precision_0", "recall_0"], authorized=True, reason="registered diagnostic")
    return rounded(out, "best_value")


@query("domain_logloss", """
select y_true, round(avg(case when domain = 'source' then -w * ln(greatest(p0, 1e-7)) end), 9) as source_loss,
       round(avg(case when domain <> 'source' then -ln(greatest(1e0 - p0, 1e-7)) end), 9) as target_loss,
       round((avg(case when domain = 'source' then -w * ln(greatest(p0, 1e-7)) end) + avg(case when domain <> 'source' then -ln(greatest(1e0 - p0, 1e-7)) end)) / 2, 9) as loss,
       round(avg(case when domain = 'source' then p0 end) + 3.7e-12, 9) as source_score, round(avg(case when domain <> 'source' then p0 end) + 3.7e-12, 9) as target_score
from (select *, case when y_true = 0 then 1.5e0 else 0.5e0 end as w from shift) group by 1""")
def _(spark, folder):
    rows = tables.shift(spark, folder).withColumn("w", F.when(F.col("y_true") == 0, 1.5).otherwise(0.5))
    out = rounded(health.domain_logloss(rows, ["y_true"], "domain", "p0", "w"), "source_loss", "target_loss", "loss")
    return off_tie(out, "source_score", "target_score")


@query("view_agreement", """select * from (
with v as (select *, case when p0 >= p1 then 0 else 1 end as q, case when p0 > 0 then -p0 * ln(p0) else 0e0 end + case when p1 > 0 then -p1 * ln(p1) else 0e0 end as h from aug_views),
o as (select a.sample_id, a.y_true, a.q as orig, sum(case when b.q = a.q then 1 else 0 end) as hits, count(*) as n, arg_max(b.q, b.view_id) as lq, arg_max(b.h, b.view_id) as lh
      from v a join v b using (sample_id) where a.view_id = 0 and b.view_id > 0 group by 1, 2, 3)
select y_true, round(avg(case when 2 * hits > n then 1e0 else 0e0 end), 9) as reliable_fraction, round(avg(case when lq = orig then 1e0 else 0e0 end), 9) as last_agrees_fraction,
       round(avg(case when 2 * hits > n then lh else -lh end), 9) as signed_entropy, count(*) as n_samples from o group by 1)""")
def _(spark, folder):
    out = health.view_agreement(tables.views(spark, folder), ["y_true"], "sample_id", "view_id")
    return rounded(out, "reliable_fraction", "last_agrees_fraction", "signed_entropy")


@query("class_confusion_score", """select * from (
with z as (select arm, seed, fold, exp((p0 - greatest(p0, p1)) * 6 / 2.5e0) as e0, exp((p1 - greatest(p0, p1)) * 6 / 2.5e0) as e1 from avgp),
s as (select arm, seed, fold, e0 / (e0 + e1) as y0, e1 / (e0 + e1) as y1 from z),
w as (select *, 1 + exp(y0 * ln(y0 + 1e-5) + y1 * ln(y1 + 1e-5)) as w from s),
m as (select arm, seed, fold, sum(w * y0 * y0) as a, sum(w * y0 * y1) as b, sum(w * y1 * y1) as d, count(*) / (sum(w) + 1e-5) as k, count(*) as n from w group by 1, 2, 3)
select arm, seed, fold, round((k * b / (k * a + k * b + 1e-5) + k * b / (k * b + k * d + 1e-5)) / 2e0, 9) as confusion_score, n from m)""")
def _(spark, folder):
    rows = averaged(spark, folder).withColumns({"z0": F.col("p0") * 6.0, "z1": F.col("p1") * 6.0})
    return rounded(health.class_confusion_score(rows, RUN, ["z0", "z1"]), "confusion_score")


@query("head_disparity", """
select y_true, round(avg(case when domain = 'source' then -4e0 * ln(case when p0 >= p1 then a0 else a1 end) end), 9) as source_term,
       round(avg(case when domain <> 'source' then -ln(least(1e0 - case when p0 >= p1 then a0 else a1 end + 1e-6, 1e0)) end), 9) as target_term,
       round(avg(case when domain = 'source' then -4e0 * ln(case when p0 >= p1 then a0 else a1 end) end)
             + avg(case when domain <> 'source' then -ln(least(1e0 - case when p0 >= p1 then a0 else a1 end + 1e-6, 1e0)) end), 9) as disparity
from (select s.*, (1 + (s.sample_id * 31) % 1022) / 1024e0 as a0, 1e0 - (1 + (s.sample_id * 31) % 1022) / 1024e0 as a1 from shift s) group by 1""")
def _(spark, folder):
    a0 = (F.lit(1) + (F.col("sample_id") * 31) % 1022) / F.lit(1024.0)
    rows = tables.shift(spark, folder).withColumn("a0", a0).withColumn("a1", F.lit(1.0) - F.col("a0"))
    out = health.head_disparity(rows, ["y_true"], "domain", ["p0", "p1"], ["a0", "a1"])
    return rounded(out, "source_term", "target_term", "disparity")


@query("entropy_domain_weights", """
select domain, sample_id, round(w / sum(w) over (partition by domain) * 1e3, 9) as weight_e3
from (select *, 1 + exp(p0 * ln(p0 + 1e-5) + p1 * ln(p1 + 1e-5)) as w from shift)""")
def _(spark, folder):
    out = health.entropy_domain_weights(tables.shift(spark, folder), [], "domain")
    return rounded(out.select("domain", "sample_id", (F.col("weight") * 1e3).alias("weight_e3")), "weight_e3")
