"""Registered queries on domain shift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shift
from ..sources import tables
from .registry import query, rounded
from .scoring import RUN


@query("validate_features", """select * from (
with f as (select domain, case when vec_id % 50 = 0 then true else false end as bad, case when vec_id % 70 = 0 then 63 else 64 end as w from feats),
g as (select domain, sum(case when bad then 1 else 0 end)::bigint as nonfinite_rows, min(w) as min_width, max(w) as max_width, count(*) as n from f group by 1)
select domain, 'nonfinite_rows' as rule, * exclude (domain) from g where nonfinite_rows > 0
union all select domain, 'unequal_width', * exclude (domain) from g where min_width <> 64 or max_width <> 64)""")
def _(spark, folder):
    cut = F.when(F.col("vec_id") % 70 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    broken = F.transform(cut, lambda x: F.when(F.col("vec_id") % 50 == 0, F.lit(float("nan"))).otherwise(x.cast("double")))
    rows = tables.features(spark, folder).withColumn("embedding", broken)
    return shift.validate_features(rows, ["domain"], "embedding", 2)


@query("coral_distance", """select * from (
with w as (select vec_id, domain, [cast(x as double) for x in embedding] as e from feats),
p as (select domain, i, j, covar_samp(e[i], e[j]) as c from w, (select unnest(range(1, 65)) as i), (select unnest(range(1, 65)) as j) group by 1, 2, 3),
d as (select sum(power(s.c - t.c, 2)) / (4e0 * 64 * 64) as coral from p s join p t on s.i = t.i and s.j = t.j where s.domain = 'source' and t.domain = 'target'),
m as (select d, avg(case when domain = 'source' then v end) - avg(case when domain = 'target' then v end) as g from feat_values group by d)
select round(coral, 12) as coral_distance, (select round(sqrt(sum(g * g)), 9) from m) as mean_difference_l2, 64 as feature_dimension from d)""")
def _(spark, folder):
    out = shift.coral_distance(tables.features(spark, folder), "domain", "embedding")
    return rounded(rounded(out, "coral_distance", digits=12), "mean_difference_l2")


@query("branch_divergence", """
select round(sqrt(sum(g * g)), 9) as divergence from (
  select d, avg(case when domain = 'source' then v end) - avg(case when domain = 'target' then v end) as g from feat_values group by d)""")
def _(spark, folder):
    return rounded(shift.branch_divergence(tables.features(spark, folder), "domain", "embedding"), "divergence")


_STATS = """
st as (select domain, d, avg(v) as m, var_pop(v) as q from feat_values group by 1, 2),
z as (select f.vec_id, f.domain, f.d, (f.v - st.m) / sqrt(st.q + 1e-5) as x from feat_values f join st on st.d = f.d and st.domain = {key})"""


def _standardized(mode):
    def run(spark, folder):
        out = shift.domain_standardize(tables.features(spark, folder), "domain", "embedding", mode)
        long = out.select("vec_id", "domain", F.posexplode("embedding").alias("pos", "x"))
        return rounded(long.select("vec_id", "domain", (F.col("pos") + 1).cast("bigint").alias("d"), "x"), "x", digits=8)

    return run


for _mode, _key in (("target", "'target'"), ("frozen", "'source'"), ("per_domain", "f.domain")):
    query(f"domain_standardize_{_mode}", f"""select * from (with {_STATS.format(key=_key).strip()}
select vec_id, domain, d, round(x, 8) as x from z)""")(_standardized(_mode))


@query("rbf_mmd2", """select * from (
with w as (select vec_id, domain, cast(embedding as double[]) as e from feats),
p as (select a.domain as da, b.domain as db, list_distance(a.e, b.e) as d from w a join w b on a.vec_id < b.vec_id),
s as (select quantile_cont(d, 0.5) as sigma from p where d > 0),
k as (select da, db, sum(exp(-d * d / (2e0 * sigma * sigma))) as k from p, s group by 1, 2),
c as (select cast(sum(case when domain = 'source' then 1 else 0 end) as double) as m, cast(sum(case when domain <> 'source' then 1 else 0 end) as double) as n from w)
select round(2 * sum(case when da = 'source' and db = 'source' then k else 0 end) / max(m * (m - 1)) + 2 * sum(case when da = 'target' and db = 'target' then k else 0 end) / max(n * (n - 1))
       - 2 * sum(case when da <> db then k else 0 end) / max(m * n), 9) as mmd2, round(max(sigma), 9) as bandwidth,
       'pooled median pairwise Euclidean distance' as bandwidth_source from k, s, c)""")
def _(spark, folder):
    out = shift.rbf_mmd2(tables.features(spark, folder), "vec_id", "domain", "embedding")
    return rounded(out, "mmd2", "bandwidth")


@query("rbf_mmd2_explicit", """select * from (
with w as (select vec_id, domain, cast(embedding as double[]) as e from feats),
k as (select a.domain as da, b.domain as db, sum(exp(-power(list_distance(a.e, b.e), 2) / (2e0 * 0.81e0))) as k from w a join w b on a.vec_id < b.vec_id group by 1, 2),
c as (select cast(sum(case when domain = 'source' then 1 else 0 end) as double) as m, cast(sum(case when domain <> 'source' then 1 else 0 end) as double) as n from w)
select round(2 * sum(case when da = 'source' and db = 'source' then k else 0 end) / max(m * (m - 1)) + 2 * sum(case when da = 'target' and db = 'target' then k else 0 end) / max(n * (n - 1))
       - 2 * sum(case when da <> db then k else 0 end) / max(m * n), 9) as mmd2, 0.9e0 as bandwidth, 'explicit' as bandwidth_source from k, c)""")
def _(spark, folder):
    out = shift.rbf_mmd2(tables.features(spark, folder), "vec_id", "domain", "embedding", bandwidth=0.9)
    return rounded(out, "mmd2")


@query("rbf_mmd2_linear", """select * from (
with w as (select vec_id, domain, cast(embedding as double[]) as e, row_number() over (partition by domain order by md5('0|' || vec_id), vec_id) as rn from feats),
q as (select (rn - 1) // 2 as slot, max(case when domain = 'source' and rn % 2 = 1 then e end) as s1, max(case when domain = 'source' and rn % 2 = 0 then e end) as s0,
             max(case when domain = 'target' and rn % 2 = 1 then e end) as t1, max(case when domain = 'target' and rn % 2 = 0 then e end) as t0 from w group by 1)
select round(avg(exp(-power(list_distance(s1, s0), 2) / 1.62e0) + exp(-power(list_distance(t1, t0), 2) / 1.62e0)
                 - exp(-power(list_distance(s1, t0), 2) / 1.62e0) - exp(-power(list_distance(s0, t1), 2) / 1.62e0)), 9) as mmd2, count(*) as n_quads
from q where s0 is not null and t0 is not null)""")
def _(spark, folder):
    return rounded(shift.rbf_mmd2_linear(tables.features(spark, folder), "vec_id", "domain", "embedding", 0.9), "mmd2")


@query("bbse", """select * from (
with j as (select sum(case when domain = 'source' and p0 >= p1 and y_true = 0 then 1 else 0 end) / sum(case when domain = 'source' then 1 else 0 end) as j00,
                  sum(case when domain = 'source' and p0 >= p1 and y_true = 1 then 1 else 0 end) / sum(case when domain = 'source' then 1 else 0 end) as j01,
                  sum(case when domain = 'source' and p0 < p1 and y_true = 0 then 1 else 0 end) / sum(case when domain = 'source' then 1 else 0 end) as j10,
                  sum(case when domain = 'source' and p0 < p1 and y_true = 1 then 1 else 0 end) / sum(case when domain = 'source' then 1 else 0 end) as j11,
                  avg(case when domain <> 'source' then p0 end) as m0, avg(case when domain <> 'source' then p1 end) as m1 from shift),
s as (select *, j00 * j11 - j01 * j10 as det, j00 * j00 + j01 * j01 + j10 * j10 + j11 * j11 as f from j),
w as (select *, (m0 * j11 - m1 * j01) / det as r0, (m1 * j00 - m0 * j10) / det as r1, (f + sqrt(f * f - 4 * det * det)) / 2 / abs(det) as cond from s)
select round(r0, 9) as raw_w0, round(r1, 9) as raw_w1, round(greatest(r0, 0) * (j00 + j10) / (greatest(r0, 0) * (j00 + j10) + greatest(r1, 0) * (j01 + j11)), 9) as target_prior0,
       r0 < 0 or r1 < 0 as negative_weights_clipped, round(cond, 6) as condition_number,
       round(greatest(r0, 0) * (j00 + j10) / (greatest(r0, 0) * (j00 + j10) + greatest(r1, 0) * (j01 + j11)) - 0.2e0, 9) as prior_gap from w)""")
def _(spark, folder):
    out = shift.bbse(tables.shift(spark, folder), "domain", reference_prior=0.2)
    out = rounded(out.select("raw_w0", "raw_w1", "target_prior0", "negative_weights_clipped", "condition_number", "prior_gap"),
                  "raw_w0", "raw_w1", "target_prior0", "prior_gap")
    return rounded(out, "condition_number", digits=6)


_IW = """
d as (select arm, seed, fold, case when group_id % 2 = 0 then 'source' else 'target' end as domain, y_true, p0, p1 from preds where epoch = 40),
c as (select arm, seed, fold, avg(case when domain = 'source' then p0 * (1 - y_true) end) as c00, avg(case when domain = 'source' then p0 * y_true end) as c01,
             avg(case when domain = 'source' then p1 * (1 - y_true) end) as c10, avg(case when domain = 'source' then p1 * y_true end) as c11,
             avg(case when domain = 'source' then 1e0 - y_true end) as s0, avg(case when domain = 'source' then cast(y_true as double) end) as s1,
             avg(case when domain <> 'source' then p0 end) as t0, avg(case when domain <> 'source' then p1 end) as t1 from d group by 1, 2, 3),
p as (select *, c00 * c00 + c10 * c10 as p00, c00 * c01 + c10 * c11 as p01, c01 * c01 + c11 * c11 as p11, -(c00 * t0 + c01 * t1) as q0, -(c10 * t0 + c11 * t1) as q1, -s0 / s1 as r from c),
w as (select *, greatest(0e0, least(-((1 / s1) * (p01 + r * p11) + q0 + r * q1) / (p00 + 2 * r * p01 + r * r * p11), 1 / s0)) as w0 from p)"""


@query("importance_weights", f"""select * from (with {_IW.strip()}
select arm, seed, fold, round(w0, 9) as w0, round((1 - s0 * w0) / s1, 9) as w1, 'optimal' as status from w)""")
def _(spark, folder):
    rows = tables.predictions(spark, folder, epochs=(40, 40)).withColumn(
        "domain", F.when(F.col("group_id") % 2 == 0, "source").otherwise("target")
    )
    out = shift.importance_weights(rows, RUN, "domain")
    return rounded(out.select(*RUN, "w0", "w1", "status"), "w0", "w1")


@query("ema_over_epochs", """select * from (
with recursive h as (select run_id, epoch, case when epoch % 4 = 0 then null else train_loss end as v, row_number() over (partition by run_id order by epoch) as k from curve),
e as (select run_id, epoch, k, coalesce(0.5e0 * v + 0.5e0 * 1e0, 1e0) as w from h where k = 1
      union all select h.run_id, h.epoch, h.k, coalesce(0.5e0 * h.v + 0.5e0 * e.w, e.w) from e join h on h.run_id = e.run_id and h.k = e.k + 1)
select run_id, epoch, round(w, 9) as ema from e)""")
def _(spark, folder):
    curve = tables.epoch_curve(spark, folder).withColumn("w", F.when(F.col("epoch") % 4 != 0, F.col("train_loss")))
    return rounded(shift.ema_over_epochs(curve, ["run_id"], "epoch", "w"), "ema")


@query("proxy_a_distance")
def _(spark, folder):
    return shift.proxy_a_distance(tables.features(spark, folder), "vec_id", "domain", "embedding")


def _blocks(rows):
    """The 64 dimensions as two sums of 32, for the fits that SQL can repeat."""
    return rows.withColumns({f"x{i + 1}": tables.part_sum("embedding", 32 * i + 1, 32) for i in range(2)}).drop("embedding")


_HALVES = ", ".join(f"list_sum(list_transform(embedding[{a}:{a + 31}], lambda v: cast(v as double))) as x{i}" for i, a in ((1, 1), (2, 33)))


def _newton(model: str) -> str:
    """Recursive SQL: damped Newton steps of the penalised logistic regression on x1, x2 and 1, for every `model` of the view train."""
    key = f"{model}, " if model else ""
    same = f"using ({model})" if model else "on true"
    group = f"group by {key}it, b1, b2, b0"
    return f"""
fit as (
  select {f"distinct {key}" if model else ""}0 as it, 0e0 as b1, 0e0 as b2, 0e0 as b0 from {"train" if model else "(select 1)"}
  union all
  select {key}it + 1, b1 - m1 * least(1e0, 5e0 / greatest(abs(m1), abs(m2), abs(m0), 1e-300)), b2 - m2 * least(1e0, 5e0 / greatest(abs(m1), abs(m2), abs(m0), 1e-300)),
         b0 - m0 * least(1e0, 5e0 / greatest(abs(m1), abs(m2), abs(m0), 1e-300))
  from (select *, (g1 * (h22 * h00 - h20 * h20) - h12 * (g2 * h00 - h20 * g0) + h10 * (g2 * h20 - h22 * g0)) / det as m1,
               (h11 * (g2 * h00 - h20 * g0) - g1 * (h12 * h00 - h20 * h10) + h10 * (h12 * g0 - g2 * h10)) / det as m2,
               (h11 * (h22 * g0 - g2 * h20) - h12 * (h12 * g0 - g2 * h10) + g1 * (h12 * h20 - h22 * h10)) / det as m0
        from (select *, h11 * (h22 * h00 - h20 * h20) - h12 * (h12 * h00 - h20 * h10) + h10 * (h12 * h20 - h22 * h10) as det
              from (select {key}it, b1, b2, b0, sum(w * (p - y) * x1) + b1 as g1, sum(w * (p - y) * x2) + b2 as g2, sum(w * (p - y)) + b0 as g0,
                           sum(w * p * (1 - p) * x1 * x1) + 1 as h11, sum(w * p * (1 - p) * x1 * x2) as h12, sum(w * p * (1 - p) * x1) as h10,
                           sum(w * p * (1 - p) * x2 * x2) + 1 as h22, sum(w * p * (1 - p) * x2) as h20, sum(w * p * (1 - p)) + 1 as h00
                    from (select train.*, it, b1, b2, b0, 1e0 / (1e0 + exp(-(x1 * b1 + x2 * b2 + b0))) as p from fit join train {same} where it < 25)
                    {group}))))"""


@query("proxy_a_distance_halves", f"""select * from (
with recursive r as (
  select vec_id, case when domain <> 'source' then 1 else 0 end as y, {_HALVES} from feats),
k as (select *, row_number() over (partition by y order by md5('0|' || vec_id), vec_id) as rn, count(*) over (partition by y) as n from r),
t as (select *, rn <= round(n * 0.3e0) as test from k),
st as (select avg(x1) as m1, stddev_pop(x1) as s1, avg(x2) as m2, stddev_pop(x2) as s2 from t where not test),
z as (select y, test, (x1 - m1) / s1 as x1, (x2 - m2) / s2 as x2 from t, st),
train as (select y, x1, x2, cast((select count(*) from z where not test) as double) / (2 * count(*) over (partition by y)) as w from z where not test),
{_newton("").strip()}
select round(avg(case when (case when x1 * b1 + x2 * b2 + b0 > 0 then 1 else 0 end) <> y then 1e0 else 0e0 end), 9) as domain_classifier_error,
       count(*) as n_holdout, round(2 * (1 - 2 * avg(case when (case when x1 * b1 + x2 * b2 + b0 > 0 then 1 else 0 end) <> y then 1e0 else 0e0 end)), 9) as proxy_a_distance,
       (select count(*) from r where y = 0) as n_source, (select count(*) from r where y = 1) as n_target, 0.3e0 as holdout_fraction, 0 as seed
from z, fit where test and it = 25)""")
def _(spark, folder):
    out = shift.proxy_a_distance(_blocks(tables.features(spark, folder)), "vec_id", "domain", ["x1", "x2"])
    return rounded(out.drop("convention"), "domain_classifier_error", "proxy_a_distance")


@query("balanced_downsample", """select * from (
with f as (select vec_id, domain, label % 2 as cls from feats join embeddings using (vec_id)),
s as (select cls, min(n) as n from (select cls, domain, count(*) as n from f group by 1, 2) group by 1),
r as (select f.*, rs, row_number() over (partition by cls, rs, domain order by md5('7|' || rs || '|' || vec_id), rs || '|' || vec_id) as rn from f, (select unnest([0, 1, 2]) as rs))
select cls, domain, rs as resample, vec_id, rn from r join s using (cls) where rn <= n)""")
def _(spark, folder):
    rows = _labelled(spark, folder).select("cls", "domain", "vec_id")
    return shift.balanced_downsample(rows, ["cls"], "domain", "vec_id", 3, 7).select("cls", "domain", "resample", "vec_id", "rn")


def _labelled(spark, folder):
    emb = tables.table(spark, folder, "embeddings")
    return emb.select(
        "vec_id", (F.col("label") % 2).alias("cls"),
        F.when(F.col("label") < 5, "source").otherwise("target").alias("domain"), "embedding",
    )


@query("format_probe")
def _(spark, folder):
    return shift.format_probe(_labelled(spark, folder), "cls", "domain", "vec_id", "embedding")


@query("format_probe_halves", f"""select * from (
with recursive f as (select vec_id, label % 2 as cls, case when label < 5 then 'source' else 'target' end as domain, {_HALVES} from embeddings),
s as (select cls, count(*) filter (where domain = 'source') as n_synthetic, count(*) filter (where domain <> 'source') as n_real from f group by 1),
k as (select f.*, rs, row_number() over (partition by cls, rs, domain order by md5('42|' || rs || '|' || vec_id), rs || '|' || vec_id) as rn from f, (select unnest(range(0, 20)) as rs)),
d as (select cls || '/' || rs as id, cls, rs, case when domain = 'source' then 0 else 1 end as y, x1, x2, (rn - 1) % least(5, n_synthetic, n_real) as fold,
             least(5, n_synthetic, n_real) as folds from k join s using (cls) where rn <= least(n_synthetic, n_real) and least(n_synthetic, n_real) >= 2),
train as (select id || '/' || m as model, y, x1, x2, 1e0 as w from (select *, unnest(range(0, folds)) as m from d) where m <> fold),
{_newton("model").strip()},
e as (select model, cls, y, x1 * b1 + x2 * b2 + b0 as z from d join fit on fit.model = id || '/' || fold where it = 25),
q as (select model, cls, y, rank() over (partition by model order by z) + (count(*) over (partition by model, z) - 1) / 2e0 as rk from e),
a as (select model, cls, (sum(case when y = 1 then rk end) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2e0)
             / (count(*) filter (where y = 1) * count(*) filter (where y = 0)) as auc from q group by 1, 2)
select cls, round(avg(auc), 9) as auc_mean, round(stddev_pop(auc), 9) as auc_std, count(auc) as n_auc_values, any_value(n_synthetic) as n_synthetic, any_value(n_real) as n_real,
       any_value(least(n_synthetic, n_real)) as n_balanced_per_domain, 20 as n_resamples, cast(any_value(least(5, n_synthetic, n_real)) as integer) as folds_per_resample
from a join s using (cls) group by cls)""")
def _(spark, folder):
    halves = _blocks(_labelled(spark, folder)).withColumn("f", F.array("x1", "x2"))
    return rounded(shift.format_probe(halves, "cls", "domain", "vec_id", "f"), "auc_mean", "auc_std")
