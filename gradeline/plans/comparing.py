"""Registered queries over run-level results: grids, pairing, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, inference, metrics, ranking
from ..sources import tables
from .registry import query, rnd, rounded
from .scoring import RUN, averaged, scored

METRICS = ("macro_f1", "f1_0", "precision_0", "recall_0", "average_precision")
HEADLINE = ("macro_f1", "f1_0", "average_precision")

# The declared comparison blocks (arms 0..3, roles of the metrics).
_WIDE = ["f1_1", "recall_1", "f1_0", "recall_0", "balanced_accuracy"]
_SHIP = {"primary": ["f1_1", "recall_1"], "secondary": ["macro_f1", "balanced_accuracy"]}
BLOCKS = [
    {"name": "0->1", "x": 0, "y": 1, "primary": ["macro_f1"], "secondary": _WIDE},
    {"name": "1->2", "x": 1, "y": 2, **_SHIP},
    {"name": "2->3", "x": 2, "y": 3, **_SHIP},
    {"name": "2->3 subset", "x": 2, "y": 3, **_SHIP, "source": "subset"},
    {"name": "0->3", "x": 0, "y": 3, "primary": ["macro_f1"], "secondary": _WIDE},
    {"name": "0->2", "x": 0, "y": 2, "primary": ["macro_f1"], "secondary": _WIDE},
]


def run_table(spark, folder):
    return metrics.classification_metrics(scored(spark, folder), RUN)


def run_metrics_long(spark, folder):
    """(arm, seed, fold, metric, value) from one pass over the averaged predictions."""
    return metrics.melt(ranking.run_metrics(averaged(spark, folder), RUN), RUN, METRICS)


def seed_means(spark, folder):
    long = run_metrics_long(spark, folder)
    return grid.aggregate_folds(long, ["arm", "seed", "metric"], "fold", "value", range(5)).select(
        "arm", "seed", "metric", F.col("mean").alias("value")
    )


_LONG = """
long as (select arm, seed, fold, metric, value from (
  unpivot (select m.arm, m.seed, m.fold, macro_f1, f1_0, precision_0, recall_0, ap as average_precision
           from run_metrics m join run_ap a using (arm, seed, fold))
  on macro_f1, f1_0, precision_0, recall_0, average_precision into name metric value value)),
sm as (select arm, seed, metric, avg(value) as value from long group by 1, 2, 3)"""

# df = 4: p = 1 - sin(1 + cos^2/2) with theta = atan(t/2); critical value 2.7764451051977987
_TEST = """
dd as (select b.arm, b.metric, b.seed, a.value - b.value as d from sm a join sm b using (seed, metric) where a.arm = 0 and b.arm <> 0),
tt as (select arm, metric, count(*) as n, avg(d) as mean_difference, stddev_samp(d) as sd, stddev_samp(d) / sqrt(count(*)) as se from dd group by 1, 2),
pp as (select *, mean_difference / se as t, 1e0 - sin(atan(abs(mean_difference / se) / 2e0)) * (1e0 + power(cos(atan(abs(mean_difference / se) / 2e0)), 2) / 2e0) as p from tt)"""

_FAM = """
ff as (select *, 'all' as family from pp union all select *, 'headline' from pp where metric in ('macro_f1', 'f1_0', 'average_precision')),
rr as (select *, row_number() over (partition by family order by p, arm, metric) as k, count(*) over (partition by family) as m from ff),
hh as (select *, least(1e0, max((m - k + 1) * p) over (partition by family order by k)) as holm_p,
              least(1e0, min(p * m / k) over (partition by family order by k rows between current row and unbounded following)) as bh_p from rr)"""


@query("aggregate_folds", """
select arm, seed, round(avg(macro_f1), 9) as mean, count(*) as n_folds,
       string_agg(case when c00 + c10 >= 0.4e0 * (c00 + c01 + c10 + c11) then cast(fold as varchar) end, ',' order by fold) as collapsed_folds
from run_metrics group by 1, 2""")
def _(spark, folder):
    runs = run_table(spark, folder)
    high = (F.col("c00") + F.col("c10")) >= F.lit(0.4) * (F.col("support_0") + F.col("support_1"))
    out = grid.aggregate_folds(runs.withColumn("collapsed", high), ["arm", "seed"], "fold", "macro_f1", range(5), "collapsed")
    listed = F.when(F.size("collapsed_folds") > 0, F.array_join("collapsed_folds", ","))
    return out.select("arm", "seed", rnd("mean").alias("mean"), F.col("n_folds").cast("bigint").alias("n_folds"), listed.alias("collapsed_folds"))


@query("grid_complete", """
select arm, seed, fold, problem, n from (
  select coalesce(c.arm, g.arm) as arm, coalesce(c.seed, g.seed) as seed, coalesce(c.fold, g.fold) as fold,
         case when n is null then 'missing' when g.arm is null then 'extra' when n > 1 then 'duplicate' end as problem, coalesce(n, 0) as n
  from (select arm, seed, fold, count(*) as n from preds where epoch = 36 and sample_id % 5 <> arm group by 1, 2, 3) c
  full join (select * from (select unnest([0, 1, 2, 3]) as arm), (select unnest([0, 1, 2, 3, 4]) as seed), (select unnest([0, 1, 2, 3, 4]) as fold)) g
  on c.arm = g.arm and c.seed = g.seed and c.fold = g.fold) where problem is not null""")
def _(spark, folder):
    cells = tables.predictions(spark, folder, epochs=(36, 36)).where(F.col("sample_id") % 5 != F.col("arm"))
    return grid.grid_complete(cells.select(*RUN), {"arm": range(4), "seed": range(5), "fold": range(5)})


@query("validate_id_set", """
select id, rule, n from (
  select coalesce(s.id, e.id) as id, case when n is null then 'missing_id' when e.id is null then
         case when s.id = floor(s.id) then 'unexpected_id' else 'non_integer_id' end end as rule, coalesce(n, 0) as n
  from (select (user_id % 17) / 2e0 as id, count(*) as n from events group by 1) s
  full join (select cast(unnest([0, 1, 2, 3, 4, 11]) as double) as id) e on s.id = e.id) where rule is not null""")
def _(spark, folder):
    seeds = tables.table(spark, folder, "events").select(((F.col("user_id") % 17) / F.lit(2.0)).alias("seed"))
    return grid.validate_id_set(seeds, "seed", [0, 1, 2, 3, 4, 11])


@query("pair_runs", """
select a.seed, a.fold, round(a.macro_f1, 9) as value_a, round(b.macro_f1, 9) as value_b, round(a.macro_f1 - b.macro_f1, 9) as difference
from run_metrics a join run_metrics b using (seed, fold) where a.arm = 0 and b.arm = 3""")
def _(spark, folder):
    runs = run_table(spark, folder)
    out = grid.pair_runs(runs.where("arm = 0"), runs.where("arm = 3"), ["fold"], "seed", "macro_f1")
    return rounded(out, "value_a", "value_b", "difference")


@query("pair_runs_loose", """
select a.seed, a.fold, round(a.macro_f1, 9) as value_a, round(b.macro_f1, 9) as value_b, round(a.macro_f1 - b.macro_f1, 9) as difference
from run_metrics a join run_metrics b using (seed, fold) where a.arm = 3 and b.arm = 0 and a.seed <> 2 and b.seed <> 4""")
def _(spark, folder):
    runs = run_table(spark, folder)
    y, x = runs.where("arm = 3 and seed <> 2"), runs.where("arm = 0 and seed <> 4")
    out = grid.pair_runs(y, x, ["fold"], "seed", "macro_f1", strict=False)
    return rounded(out, "value_a", "value_b", "difference")


@query("loose_pairs", """select * from (
with y as (select fold, seed, macro_f1 as v from run_metrics where arm = 3 and seed <> 2 and (fold <> 1 or seed = 0) and fold <> 2),
x as (select fold, seed, macro_f1 as v from run_metrics where arm = 0 and seed <> 4),
p as (select fold, seed, y.v - x.v as d from y join x using (fold, seed)),
f as (select fold from y union select fold from x)
select fold, count(d) as n_pairs, coalesce(string_agg(seed, ',' order by seed), '') as used_seeds, count(d) < 2 as insufficient,
       case when count(d) >= 2 then round(avg(d), 9) end as mean_difference from f left join p using (fold) group by 1)""")
def _(spark, folder):
    runs = run_table(spark, folder)
    y = runs.where("arm = 3 and seed <> 2 and (fold <> 1 or seed = 0) and fold <> 2")
    out = grid.loose_pairs(y, runs.where("arm = 0 and seed <> 4"), ["fold"], "seed", "macro_f1")
    return rounded(out.withColumn("used_seeds", F.array_join("used_seeds", ",")), "mean_difference")


@query("unmatched_seeds", """
select distinct seed, 'b' as only_in from preds where seed = 2 union all select distinct seed, 'a' from preds where seed = 4""")
def _(spark, folder):
    runs = run_table(spark, folder)
    return grid.unmatched_seeds(runs.where("arm = 3 and seed <> 2"), runs.where("arm = 0 and seed <> 4"), [], "seed")


@query("pair_long", f"""select * from (with {_LONG.strip()}
select 'arm' || b.arm as arm_id, metric, seed, round(b.value, 9) as value, round(a.value, 9) as ref_value, round(b.value - a.value, 9) as difference
from sm b join sm a using (seed, metric) where a.arm = 0 and b.arm <> 0)""")
def _(spark, folder):
    sm = seed_means(spark, folder)
    points = sm.groupBy("arm", "seed").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("values")
    )
    arms = points.groupBy(F.concat(F.lit("arm"), F.col("arm")).alias("arm_id")).agg(
        F.collect_list(F.struct("seed", "values")).alias("points")
    )
    return rounded(grid.pair_long(arms, "arm0"), "value", "ref_value", "difference")


@query("pending_cells", """
select arm, seed, fold, case when has is null then 'pending' when k is distinct from 3000 + fold then 'stale' else 'done' end as state
from (select * from (select unnest([0, 1, 2, 3, 4, 5]) as arm), (select unnest([0, 1, 2, 3, 4]) as seed), (select unnest([0, 1, 2, 3, 4]) as fold)) g
left join (select arm, seed, fold, true as has, case when fold = 4 then null else 3000 + (c00 + c01 + c10 + c11) % 1 + fold end as k from conf) using (arm, seed, fold)""")
def _(spark, folder):
    counts = metrics.confusion_counts(scored(spark, folder), RUN)
    size = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    records = counts.withColumn("signature", F.when(F.col("fold") != 4, F.lit(3000) + size % 1 + F.col("fold")))
    cells = grid.expected_grid(spark, {"arm": range(6), "seed": range(5), "fold": range(5)})
    return grid.pending_cells(cells.withColumn("signature", F.lit(3000) + F.col("fold")), records, RUN, ["signature"])


@query("seed_summary", f"""select * from (with {_LONG.strip()}
select arm, metric, round(avg(value), 9) as mean, round(stddev_samp(value), 9) as sd, count(*) as n, 5::bigint as min_folds from sm group by 1, 2)""")
def _(spark, folder):
    out = grid.seed_summary(run_metrics_long(spark, folder), ["arm"], "seed", "fold", "metric", "value")
    return rounded(out, "mean", "sd")


@query("arm_summary", """
select arm, round(avg(macro_f1), 9) as macro_f1_mean, round(avg(f1_0), 9) as f1_0_mean, round(stddev_pop(macro_f1), 9) as macro_f1_std,
       round(stddev_pop(f1_0), 9) as f1_0_std, sum(case when macro_f1 > 0.5e0 then 1 else 0 end)::bigint as n_healthy, count(*) as n from run_metrics group by 1""")
def _(spark, folder):
    runs = run_table(spark, folder).withColumn("healthy", F.col("macro_f1") > 0.5)
    out = grid.arm_summary(runs, ["arm"], ["macro_f1", "f1_0"], ["healthy"])
    return rounded(out, "macro_f1_mean", "f1_0_mean", "macro_f1_std", "f1_0_std")


@query("ceiling_gap", """
select arm, round(avg(macro_f1), 9) as mean, round(stddev_pop(macro_f1), 9) as std, count(*) as n, round(0.89e0 - avg(macro_f1), 9) as gap from run_metrics group by 1""")
def _(spark, folder):
    return rounded(grid.ceiling_gap(run_table(spark, folder), ["arm"], "macro_f1", 0.89), "mean", "std", "gap")


@query("cost_summary", """
select event_type, round(min(value), 6) as min, round(max(value), 6) as max, count(distinct user_id % 7) as distinct_peaks, count(*) as n,
       round(sum(event_id % 100) / sum(value), 6) as flops_per_second, round(quantile_cont(value, 0.25), 6) as q1,
       round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q3 from events group by 1""")
def _(spark, folder):
    runs = tables.table(spark, folder, "events").select(
        "event_type", "value", (F.col("user_id") % 7).alias("peak"), (F.col("event_id") % 100).alias("flops")
    )
    out = grid.cost_summary(runs, ["event_type"], "value", "peak", "flops")
    return rounded(out, "min", "max", "flops_per_second", "q1", "median", "q3", digits=6)


@query("paired_t", f"""select * from (with {_LONG.strip()}, {_TEST.strip()}
select arm, metric, n, 4 as df, round(mean_difference, 9) as mean_difference, round(sd, 9) as sample_sd, round(se, 9) as standard_error,
       round(t, 7) as t_statistic, round(p, 9) as p_value, round(mean_difference - 2.7764451051977987e0 * se, 9) as ci_lo,
       round(mean_difference + 2.7764451051977987e0 * se, 9) as ci_hi from pp)""")
def _(spark, folder):
    pairs = grid.pair_against(seed_means(spark, folder), "arm", 0, ["metric"], "seed", "value")
    out = rounded(inference.paired_t(pairs, ["arm", "metric"]).drop("insufficient", "t_critical"),
                  "mean_difference", "sample_sd", "standard_error", "p_value", "ci_lo", "ci_hi")
    return rounded(out, "t_statistic", digits=7)


@query("t_interval", f"""select * from (with {_LONG.strip()}
select arm, metric, count(*) as n, round(avg(value), 9) as mean, round(stddev_samp(value), 9) as sd,
       round(avg(value) - 2.7764451051977987e0 * stddev_samp(value) / sqrt(5e0), 9) as ci_lo,
       round(avg(value) + 2.7764451051977987e0 * stddev_samp(value) / sqrt(5e0), 9) as ci_hi from sm group by 1, 2)""")
def _(spark, folder):
    return rounded(inference.t_interval(seed_means(spark, folder), ["arm", "metric"], "value"), "mean", "sd", "ci_lo", "ci_hi")


@query("effect_over_se", f"""select * from (with {_LONG.strip()}, {_TEST.strip()}
select arm, metric, round(abs(mean_difference) / se, 7) as effect_over_se from pp)""")
def _(spark, folder):
    pairs = grid.pair_against(seed_means(spark, folder), "arm", 0, ["metric"], "seed", "value")
    out = inference.effect_over_se(inference.paired_t(pairs, ["arm", "metric"]))
    return rounded(out.select("arm", "metric", "effect_over_se"), "effect_over_se", digits=7)


@query("decide", f"""select * from (with {_LONG.strip()}, {_TEST.strip()},
ci as (select *, mean_difference - 2.7764451051977987e0 * se as lo, mean_difference + 2.7764451051977987e0 * se as hi from pp)
select arm, metric, lo > 0 or hi < 0 as excludes_zero, case when lo > 0 or hi < 0 then 'EFFECTIVE' else 'INCONCLUSIVE' end as verdict,
       case when lo > 0 or hi < 0 then case when mean_difference > 0 then 'improve' else 'degrade' end else 'n/a' end as direction from ci)""")
def _(spark, folder):
    pairs = grid.pair_against(seed_means(spark, folder), "arm", 0, ["metric"], "seed", "value")
    out = inference.decide(inference.paired_t(pairs, ["arm", "metric"]))
    return out.select("arm", "metric", "excludes_zero", "verdict", "direction")


_BOOT = """
dd as (select b.arm, b.seed, avg(a.macro_f1) - avg(b.macro_f1) as d
       from run_metrics a join run_metrics b using (seed, fold) where a.arm = 0 and b.arm <> 0 group by b.arm, b.seed),
ix as (select b, i, least(cast(floor(cast(('0x' || substr(md5('12345|' || b || '|' || i), 1, 13)) as bigint) / 4503599627370496e0 * 5) as bigint), 4) as s
       from (select unnest(range(0, 10000)) as b), (select unnest(range(0, 5)) as i)),
mm as (select arm, b, avg(d) as m from ix join dd on ix.s = dd.seed group by 1, 2),
bb as (select arm, quantile_cont(m, 0.025) as boot_lo, quantile_cont(m, 0.975) as boot_hi, avg(m) as boot_mean, count(*) as n_boot from mm group by 1)"""


def _macro_differences(spark, folder):
    runs = run_table(spark, folder)
    means = grid.aggregate_folds(runs, ["arm", "seed"], "fold", "macro_f1", range(5))
    return grid.pair_against(means, "arm", 0, [], "seed", "mean")


@query("bootstrap_paired_ci", f"""select * from (with {_BOOT.strip()}
select arm, round(boot_lo, 9) as boot_lo, round(boot_hi, 9) as boot_hi, round(boot_mean, 9) as boot_mean, n_boot from bb)""")
def _(spark, folder):
    out = inference.bootstrap_paired_ci(_macro_differences(spark, folder), ["arm"])
    return rounded(out, "boot_lo", "boot_hi", "boot_mean")


@query("ci_agreement", f"""select * from (with {_BOOT.strip()},
tt as (select arm, avg(d) as m, 2.7764451051977987e0 * stddev_samp(d) / sqrt(5e0) as half from dd group by 1),
jj as (select arm, m - half as lo, m + half as hi, greatest(1e-9, half) as half, boot_lo, boot_hi from tt join bb using (arm))
select arm, (lo > 0 or hi < 0) = (boot_lo > 0 or boot_hi < 0) as same_decision, round(abs(lo - boot_lo) / half, 7) as gap_lo, round(abs(hi - boot_hi) / half, 7) as gap_hi,
       (lo > 0 or hi < 0) = (boot_lo > 0 or boot_hi < 0) and abs(lo - boot_lo) / half < 0.5 and abs(hi - boot_hi) / half < 0.5 as consistent from jj)""")
def _(spark, folder):
    diffs = _macro_differences(spark, folder)
    both = inference.paired_t(diffs, ["arm"]).join(inference.bootstrap_paired_ci(diffs, ["arm"]), "arm")
    out = inference.ci_agreement(both).select("arm", "same_decision", "gap_lo", "gap_hi", "consistent")
    return rounded(out, "gap_lo", "gap_hi", digits=7)


@query("comparison_blocks", """select * from (
with bm as (select *, (recall_0 + recall_1) / 2e0 as balanced_accuracy from run_metrics),
lg as (select arm, seed, fold, metric, value from (unpivot (select arm, seed, fold, macro_f1, f1_0, recall_0, f1_1, recall_1, balanced_accuracy from bm)
       on macro_f1, f1_0, recall_0, f1_1, recall_1, balanced_accuracy into name metric value value)),
src as (select 'full' as source, arm, seed, metric, avg(value) as value from lg group by 2, 3, 4
        union all select 'subset', arm, seed, metric, avg(value) from lg where fold < 3 group by 2, 3, 4),
w as (select unnest(['f1_1', 'recall_1', 'f1_0', 'recall_0', 'balanced_accuracy']) as metric),
cfg as (
  select block, x, y, 'full' as source, 'primary' as role, 'macro_f1' as metric from (values ('0->1', 0, 1), ('0->3', 0, 3), ('0->2', 0, 2)) v(block, x, y)
  union all select block, x, y, 'full', 'secondary', metric from (values ('0->1', 0, 1), ('0->3', 0, 3), ('0->2', 0, 2)) v(block, x, y), w
  union all select block, x, y, source, role, metric from (values ('1->2', 1, 2, 'full'), ('2->3', 2, 3, 'full'), ('2->3 subset', 2, 3, 'subset')) v(block, x, y, source),
       (values ('primary', 'f1_1'), ('primary', 'recall_1'), ('secondary', 'macro_f1'), ('secondary', 'balanced_accuracy')) u(role, metric)),
d as (select block, role, c.metric, b.value - a.value as d from cfg c join src a on a.source = c.source and a.arm = c.x and a.metric = c.metric
      join src b on b.source = c.source and b.arm = c.y and b.metric = c.metric and b.seed = a.seed),
t as (select block, role, metric, count(*) as n, avg(d) as mean_difference, 2.7764451051977987e0 * stddev_samp(d) / sqrt(5e0) as half from d group by 1, 2, 3)
select block, role, metric, n, round(mean_difference, 9) as mean_difference, round(mean_difference - half, 9) as ci_lo, round(mean_difference + half, 9) as ci_hi,
       case when mean_difference - half > 0 or mean_difference + half < 0 then 'EFFECTIVE' else 'INCONCLUSIVE' end as verdict from t)""")
def _(spark, folder):
    runs = run_table(spark, folder).withColumn("balanced_accuracy", (F.col("recall_0") + F.col("recall_1")) / F.lit(2.0))
    long = metrics.melt(runs, RUN, ["macro_f1", "f1_0", "recall_0", "f1_1", "recall_1", "balanced_accuracy"])
    mean = F.avg("value").alias("value")
    full = long.groupBy("arm", "seed", "metric").agg(mean).withColumn("source", F.lit("full"))
    part = long.where("fold < 3").groupBy("arm", "seed", "metric").agg(mean).withColumn("source", F.lit("subset"))
    out = inference.comparison_blocks(full.unionByName(part), BLOCKS, "arm", "seed", "metric", "value")
    return rounded(out.select("block", "role", "metric", "n", "mean_difference", "ci_lo", "ci_hi", "verdict"), "mean_difference", "ci_lo", "ci_hi")


@query("validate_p_values", """
select event_id, rule from (select event_id, case when event_id % 50 = 3 then 'not_finite' when value / 100e0 > 1 or value < 0 then 'outside_unit_interval' end as rule from events)
where rule is not null""")
def _(spark, folder):
    p = F.when(F.col("event_id") % 50 == 3, F.lit(float("nan"))).otherwise(F.col("value") / F.lit(100.0))
    return inference.validate_p_values(tables.table(spark, folder, "events").select("event_id", p.alias("p")), "p").select("event_id", "rule")


_P_FAMILY = """
pf as (select user_id % 50 as family, event_id, least(1e0, power(value / 100e0, 4)) as p from events),
rk as (select *, row_number() over (partition by family order by p, event_id) as k, count(*) over (partition by family) as m from pf)"""


def _p_families(spark, folder):
    p = F.least(F.lit(1.0), F.pow(F.col("value") / F.lit(100.0), F.lit(4.0)))
    return tables.table(spark, folder, "events").select((F.col("user_id") % 50).alias("family"), "event_id", p.alias("p_value"))


@query("holm", f"""select * from (with {_P_FAMILY.strip()},
h as (select family, event_id, p, least(1e0, max((m - k + 1) * p) over (partition by family order by k)) as hp from rk)
select family, event_id, round(p, 9) as p_value, round(hp, 9) as holm_p, hp <= 0.05 as holm_rejected from h)""")
def _(spark, folder):
    return rounded(inference.holm(_p_families(spark, folder), ["family"], order=["event_id"]), "p_value", "holm_p")


@query("benjamini_hochberg", f"""select * from (with {_P_FAMILY.strip()},
h as (select family, event_id, p, least(1e0, min(p * m / k) over (partition by family order by k rows between current row and unbounded following)) as bp from rk)
select family, event_id, round(p, 9) as p_value, round(bp, 9) as bh_p, bp <= 0.05 as bh_rejected from h)""")
def _(spark, folder):
    return rounded(inference.benjamini_hochberg(_p_families(spark, folder), ["family"], order=["event_id"]), "p_value", "bh_p")


def compared(spark, folder):
    return inference.compare_arms(seed_means(spark, folder), "arm", 0, "seed", "metric", "value", HEADLINE)


@query("compare_arms", f"""select * from (with {_LONG.strip()}, {_TEST.strip()}, {_FAM.strip()}
select family, arm, metric, n, round(mean_difference, 9) as mean_difference, round(t, 7) as t_statistic, round(p, 9) as p_value,
       round(mean_difference - 2.7764451051977987e0 * se, 9) as ci_lo, round(mean_difference + 2.7764451051977987e0 * se, 9) as ci_hi,
       round(holm_p, 9) as holm_p, holm_p <= 0.05 as holm_rejected, round(bh_p, 9) as bh_p, bh_p <= 0.05 as bh_rejected from hh)""")
def _(spark, folder):
    out = compared(spark, folder).select(
        "family", "arm", "metric", "n", "mean_difference", rnd("t_statistic", 7).alias("t_statistic"), "p_value",
        "ci_lo", "ci_hi", "holm_p", "holm_rejected", "bh_p", "bh_rejected",
    )
    return rounded(out, "mean_difference", "p_value", "ci_lo", "ci_hi", "holm_p", "bh_p")


@query("family_summary", f"""select * from (with {_LONG.strip()}, {_TEST.strip()}, {_FAM.strip()}
select family, count(*) as n_tests, sum(case when p < 0.05 then 1 else 0 end)::bigint as raw_p_below_alpha,
       sum(case when holm_p <= 0.05 then 1 else 0 end)::bigint as holm_rejected, sum(case when bh_p <= 0.05 then 1 else 0 end)::bigint as bh_rejected from hh group by 1)""")
def _(spark, folder):
    return inference.family_summary(compared(spark, folder))
