"""Label-free health of runs: collapse, convergence, schedules, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import argmax, entropy, f64, inverse_decay, is_finite, is_integral, pick, ramp, softmax, total
from .metrics import require_authorisation
from .running import with_group_stats

# Closed collapse bounds on the share of class 0.
LOW, HIGH = 0.02, 0.60


def collapsed_share(n0: Column, n1: Column, low: float = LOW, high: float = HIGH) -> Column:
    share = n0 / (n0 + n1)
    return (share <= low) | (share >= high)


def collapse_from_counts(df: DataFrame, n0: str, n1: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Share of class 0 and the collapse flag; both bounds are inclusive.

    Counts must be non-negative integers with a positive total, anything else stops the job.
    """
    if not 0.0 <= low < high <= 1.0:
        raise ValueError("the low share must lie below the high one, both within [0, 1]")
    valid = is_integral(n0) & is_integral(n1) & (f64(n0) >= 0) & (f64(n1) >= 0) & (f64(n0) + f64(n1) > 0)
    share = f64(n0) / (f64(n0) + f64(n1))
    checked = F.when(valid, share).otherwise(F.raise_error(F.lit("prediction counts must be non-negative integers with a positive total")))
    return df.withColumn("class0_fraction", checked).withColumns({
        "total": (F.col(n0) + F.col(n1)).cast("bigint"),
        "collapsed": (F.col("class0_fraction") <= low) | (F.col("class0_fraction") >= high),
    })


def collapse_from_predictions(df: DataFrame, keys: Sequence[str], pred: str = "y_pred") -> DataFrame:
    """Collapse of every key from its predictions; one that is null or no class stops the job with their number."""
    n0, n1 = F.count_if(F.col(pred) == 0), F.count_if(F.col(pred) == 1)
    foreign = F.count(F.lit(1)) - n0 - n1
    message = F.concat(foreign.cast("string"), F.lit(" predictions are neither class 0 nor class 1"))
    counts = df.groupBy(*keys).agg(F.when(foreign > 0, F.raise_error(message)).otherwise(n0).alias("n0"), n1.alias("n1"))
    return collapse_from_counts(counts, "n0", "n1")


def epoch_collapse_routes(
    epochs: DataFrame, keys: Sequence[str], epoch: str, n0: str, n1: str, low: float = LOW, high: float = HIGH
) -> DataFrame:
    """Last-epoch share route and any-epoch single-class route per run.

    Duplicate epochs or unequal totals within a run stop the job.
    """
    e = F.struct(F.col(epoch).alias("epoch"), F.col(n0).alias("n0"), F.col(n1).alias("n1"))
    single = (F.col(n0) == 0) | (F.col(n1) == 0)
    agg = epochs.groupBy(*keys).agg(
        F.max_by(e, epoch).alias("last"),
        F.bool_or(single).alias("any_epoch_single_class"),
        F.array_sort(F.collect_set(F.when(single, F.col(epoch)))).alias("collapsed_epochs"),
        F.count(F.lit(1)).alias("n_epochs"),
        F.count_distinct(epoch).alias("_epochs"),
        F.min(F.col(n0) + F.col(n1)).alias("_low"),
        F.max(F.col(n0) + F.col(n1)).alias("_high"),
    )
    problem = (
        F.when(F.col("n_epochs") != F.col("_epochs"), "duplicate epoch")
        .when(F.col("_low") != F.col("_high"), "epoch totals differ")
        .when(F.col("_low") <= 0, "empty prediction histogram")
    )
    checked = F.when(problem.isNull(), F.col("_high")).otherwise(F.raise_error(problem))
    return agg.withColumn("total", checked).select(
        *keys,
        F.col("last.epoch").alias("last_epoch"),
        F.col("last.n0").alias("last_n0"),
        F.col("last.n1").alias("last_n1"),
        collapsed_share(F.col("last.n0"), F.col("last.n1"), low, high).alias("last_epoch_collapsed"),
        "any_epoch_single_class", "collapsed_epochs", "n_epochs", "total",
    )


def triangulate(df: DataFrame, routes: Sequence[str]) -> DataFrame:
    """Majority over boolean-or-null routes; fewer than two valid routes or a tie gives a null verdict."""
    yes = total([F.when(F.col(r), 1).otherwise(0) for r in routes])
    no = total([F.when(~F.col(r), 1).otherwise(0) for r in routes])
    votes = df.withColumns({"true_votes": yes, "false_votes": no})
    t, f = F.col("true_votes"), F.col("false_votes")
    valid = t + f
    unanimous = (valid > 0) & ((t == 0) | (f == 0))
    return votes.withColumns({
        "n_valid_routes": valid,
        "unanimous": unanimous,
        "verdict": F.when((valid >= 2) & (t != f), t > f),
        "disagreement_warning": (valid < 2) | ~unanimous,
    })


def collapse_enrich(
    last_k: DataFrame, epochs: DataFrame, keys: Sequence[str], n0: str = "n0", n1: str = "n1", epoch: str = "epoch"
) -> DataFrame:
    """Attach the two epoch routes to last-K counts and adjudicate; totals must agree."""
    first = collapse_from_counts(last_k.select(*keys, n0, n1), n0, n1).select(
        *keys, F.col("collapsed").alias("last_k_collapsed"), F.col("total").alias("_total")
    )
    routes = epoch_collapse_routes(epochs, keys, epoch, n0, n1)
    joined = first.join(routes, list(keys), "full")  # a run that one side lacks must not vanish
    same = F.when(F.col("_total") == F.col("total"), F.col("total")).otherwise(
        F.raise_error(F.lit("epoch rows and last-K counts disagree on the number of targets"))
    )
    votes = triangulate(
        joined.withColumn("total", same), ["last_epoch_collapsed", "last_k_collapsed", "any_epoch_single_class"]
    )
    return votes.withColumn("collapsed", F.col("verdict")).drop("_total")


def pseudo_label_health(
    df: DataFrame, keys: Sequence[str], probs: Sequence[str] = ("p0", "p1"), guard: str = "clip"
) -> DataFrame:
    """Predicted histogram, mean entropy, NaN flag and the all-one-class flag."""
    pred = argmax(probs)
    n = range(len(probs))
    bad = ~is_finite(probs[0])
    for p in probs[1:]:
        bad = bad | ~is_finite(p)
    out = df.groupBy(*keys).agg(
        *[F.count_if(pred == i).alias(f"n{i}") for i in n],
        F.avg(entropy(probs, guard)).alias("mean_entropy"),
        F.bool_or(bad).alias("has_nan"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("all_one_class", F.greatest(*[F.col(f"n{i}") for i in n]) == F.col("n"))


def dominant_share(df: DataFrame, keys: Sequence[str], pred: str) -> DataFrame:
    """Most frequent predicted class (lowest on ties) and its share per run."""
    counts = df.groupBy(*keys, pred).agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.col("n"), (-F.col(pred)).alias("neg"))
    return counts.groupBy(*keys).agg(
        F.max_by(pred, rank).alias("dominant_class"), (F.max("n") / F.sum("n")).alias("dominant_share")
    )


def tail_stats(df: DataFrame, keys: Sequence[str], epoch: str, value: str, k: int = 5) -> DataFrame:
    """Mean and population SD of the last k epochs."""
    newest = Window.partitionBy(*keys).orderBy(F.col(epoch).desc())
    tail = df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= k)
    return tail.groupBy(*keys).agg(
        F.avg(value).alias("tail_mean"), F.stddev_pop(value).alias("tail_std"), F.count(F.lit(1)).alias("n_tail")
    )


def convergence_check(df: DataFrame, keys: Sequence[str], epoch: str, loss: str, k: int = 5) -> DataFrame:
    """First and last loss, whether it fell, tail mean and SD, plateau ratio below 0.15."""
    newest = Window.partitionBy(*keys).orderBy(F.col(epoch).desc())
    ranked = df.withColumn("_tail", F.row_number().over(newest) <= k)
    in_tail = F.when(F.col("_tail"), f64(loss))
    agg = ranked.groupBy(*keys).agg(
        F.min_by(loss, epoch).alias("loss_first"),
        F.max_by(loss, epoch).alias("loss_last"),
        F.bool_or(~is_finite(loss)).alias("nan_seen"),
        F.avg(in_tail).alias("tail_mean"),
        F.stddev_pop(in_tail).alias("tail_std"),
    )
    ratio = F.when(F.col("tail_mean") > 1e-9, F.col("tail_std") / F.col("tail_mean"))
    return agg.withColumns({
        "loss_decreased": F.col("loss_last") < F.col("loss_first"),
        "plateau_ratio": ratio,
        "plateau_ok": F.coalesce(ratio < 0.15, F.lit(False)),
    })


def overfit_check(df: DataFrame, keys: Sequence[str], epoch: str, train: str, val: str) -> DataFrame:
    """Best validation epoch (first minimum), rebound, whether training still falls, and the verdict."""
    best = F.struct(f64(val).alias("v"), F.col(epoch).alias("e"))
    row = F.struct(F.col(epoch).alias("epoch"), f64(train).alias("train"), f64(val).alias("val"))
    agg = df.groupBy(*keys).agg(
        F.min_by(row, best).alias("best"), F.max_by(row, epoch).alias("last"), F.count(F.lit(1)).alias("n_epochs")
    )
    rebound = F.col("last.val") - F.col("best.val")
    falling = F.col("last.train") < F.col("best.train")
    early = F.col("best.epoch") < F.col("last.epoch") - 2
    return agg.select(
        *keys,
        F.col("best.epoch").alias("best_epoch"),
        F.col("best.val").alias("best_val_loss"),
        rebound.alias("val_rebound"),
        falling.alias("train_still_falling"),
        (F.col("last.val") - F.col("last.train")).alias("generalisation_gap"),
        (early & (rebound > 1e-3) & falling).alias("overfit"),
        "n_epochs",
    )


def schedule_audit(
    log: DataFrame, keys: Sequence[str], lr: str, base: str, progress: str, coeff: str | None = None, tol: float = 1e-3
) -> DataFrame:
    """Largest relative error of the logged rate against base*(1+10p)^-0.75, and of the ramp coefficient."""
    want = inverse_decay(base, progress)
    err = F.abs(f64(lr) - want) / F.greatest(want, F.lit(1e-12))
    aggs = [F.max(err).alias("max_rel_err"), F.count_if(err >= tol).alias("n_bad"), F.count(F.lit(1)).alias("n")]
    if coeff:
        aggs.append(F.max(F.abs(f64(coeff) - ramp(progress))).alias("max_ramp_err"))
    return log.groupBy(*keys).agg(*aggs).withColumn("schedule_ok", F.col("n_bad") == 0)


def run_health_verdict(
    curve: DataFrame, keys: Sequence[str], epoch: str = "epoch", coeff: str = "coeff", alignment: str = "alignment_loss",
    accuracy: str = "src_acc", weights: Sequence[str] = ("w0", "w1"), solver: str = "solver_status",
    collapsed: str = "collapsed", nan: str = "nan",
) -> DataFrame:
    """End-of-run flags from the epoch curve."""
    last = F.struct(coeff, alignment, accuracy, *weights)
    agg = curve.groupBy(*keys).agg(
        F.max_by(last, epoch).alias("last"), F.min_by(coeff, epoch).alias("_first_coeff"),
        F.coalesce(F.bool_or(F.col(solver) == "optimal"), F.lit(False)).alias("any_optimal_solve"),
        F.bool_or(collapsed).alias("any_epoch_collapsed"),
        F.bool_or(nan).alias("any_nan"),
    )
    moved = F.lit(False)
    for w in weights:
        moved = moved | (F.abs(F.col(f"last.{w}") - 1.0) > 1e-4)
    return agg.select(
        *keys,
        ((F.col(f"last.{coeff}") > 0.9) & (F.col(f"last.{coeff}") > F.col("_first_coeff"))).alias("coeff_ramped"),
        (F.col(f"last.{alignment}") > 0.2).alias("alignment_alive"),
        (F.col(f"last.{accuracy}") > 0.5).alias("source_healthy"),
        moved.alias("weights_moved"),
        "any_optimal_solve", "any_epoch_collapsed", "any_nan",
    )


def oracle_best_epoch(df: DataFrame, keys: Sequence[str], epoch: str, metrics: Sequence[str], *, authorized: bool, reason: str) -> DataFrame:
    """Per metric the epoch with the highest value, earliest on ties. Diagnostic on target labels.

    Refused without authorisation and a reason; a value that is not finite or a repeated epoch stops the job.
    """
    require_authorisation(authorized, reason)
    checked = lambda m: F.when(is_finite(m), f64(m)).otherwise(F.raise_error(F.lit(f"{m} has a value that is not finite")))
    long = df.select(*keys, epoch, *[checked(m).alias(m) for m in metrics]).unpivot([*keys, epoch], list(metrics), "metric", "value")
    rank = F.struct(F.col("value"), (-F.col(epoch)).alias("neg"))
    once = F.when(F.count(epoch) == F.count_distinct(epoch), F.max_by(epoch, rank)).otherwise(F.raise_error(F.lit("an epoch occurs twice")))
    return long.groupBy(*keys, "metric").agg(once.alias("best_epoch"), F.max("value").alias("best_value"))


def domain_logloss(
    df: DataFrame, keys: Sequence[str], domain: str, score: str, weight: str | None = None, source: str = "source",
    clamp: float = 1e-7,
) -> DataFrame:
    """Domain classifier loss on a scored table: -ln d on the source side, -ln(1-d) on the target side."""
    is_source = F.col(domain) == source
    w = f64(weight) if weight else F.lit(1.0)
    src = F.when(is_source, -w * F.log(F.greatest(f64(score), F.lit(clamp))))
    tgt = F.when(~is_source, -F.log(F.greatest(F.lit(1.0) - f64(score), F.lit(clamp))))
    return df.groupBy(*keys).agg(
        F.avg(src).alias("source_loss"),
        F.avg(tgt).alias("target_loss"),
        ((F.avg(src) + F.avg(tgt)) / F.lit(2.0)).alias("loss"),
        F.avg(F.when(is_source, f64(score))).alias("source_score"),
        F.avg(F.when(~is_source, f64(score))).alias("target_score"),
    )


def view_agreement(
    df: DataFrame, keys: Sequence[str], sample: str, view: str, probs: Sequence[str] = ("p0", "p1")
) -> DataFrame:
    """Agreement of augmented views (view > 0) with the original (view 0).

    A sample is reliable when more than half its views agree; the entropy of its last view counts
    positive when reliable, negative otherwise.
    """
    rows = df.select(*keys, sample, view, argmax(probs).alias("pred"), entropy(probs).alias("ent"))
    # only the original's label is needed up front, so views fold into one aggregate per sample
    per = rows.groupBy(*keys, sample).agg(
        F.max(F.when(F.col(view) == 0, F.col("pred"))).alias("orig"),
        F.max_by(F.struct("pred", "ent"), view).alias("last"),
        *[F.count_if((F.col(view) > 0) & (F.col("pred") == c)).alias(f"v{c}") for c in range(len(probs))],
        F.count_if(F.col(view) > 0).alias("n_views"),
    )
    matches = F.coalesce(pick("orig", [F.col(f"v{c}") for c in range(len(probs))]), F.lit(0))
    flagged = per.withColumn("reliable", 2 * matches > F.col("n_views"))
    signed = F.when(F.col("reliable"), F.col("last.ent")).otherwise(-F.col("last.ent"))
    return flagged.groupBy(*keys).agg(
        F.avg(F.col("reliable").cast("double")).alias("reliable_fraction"),
        F.avg((F.col("last.pred") == F.col("orig")).cast("double")).alias("last_agrees_fraction"),
        F.avg(signed).alias("signed_entropy"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def class_confusion_score(
    df: DataFrame, keys: Sequence[str], logits: Sequence[str], temperature: float = 2.5, eps: float = 1e-5
) -> DataFrame:
    """Minimum-class-confusion statistic: entropy-weighted class correlation, mean off-diagonal share.

    The weight normalisation B/sum(w) multiplies every cell alike, so it is applied once to the
    aggregated sums and no per-row second pass is needed.
    """
    n = range(len(logits))
    soft = df.select(*keys, *[p.alias(f"y{i}") for i, p in enumerate(softmax(logits, temperature))])
    ent = total([-F.col(f"y{i}") * F.log(F.col(f"y{i}") + eps) for i in n])
    weighted = soft.withColumn("w", F.lit(1.0) + F.exp(-ent))
    sums = weighted.groupBy(*keys).agg(
        *[F.sum(F.col("w") * F.col(f"y{i}") * F.col(f"y{j}")).alias(f"m{i}{j}") for i in n for j in n],
        F.sum("w").alias("_w"), F.count(F.lit(1)).alias("n"),
    )
    scale = F.col("n") / (F.col("_w") + eps)
    row = {i: total([scale * F.col(f"m{i}{j}") for j in n]) + eps for i in n}
    off = total([scale * F.col(f"m{i}{j}") / row[i] for i in n for j in n if i != j])
    return sums.select(*keys, (off / F.lit(float(len(logits)))).alias("confusion_score"), "n")


def head_disparity(
    df: DataFrame, keys: Sequence[str], domain: str, main: Sequence[str], adversary: Sequence[str],
    margin: float = 4.0, source: str = "source", offset: float = 1e-6,
) -> DataFrame:
    """Margin disparity between two heads on a joined prediction table.

    Source: margin * -ln p_adv[argmax main]. Target: -ln min(1, 1 - p_adv[argmax main] + offset).
    """
    chosen = pick(argmax(main), [f64(a) for a in adversary])
    is_source = F.col(domain) == source
    src = F.when(is_source, -F.log(chosen) * F.lit(margin))
    tgt = F.when(~is_source, -F.log(F.least(F.lit(1.0) - chosen + F.lit(offset), F.lit(1.0))))
    return df.groupBy(*keys).agg(
        F.avg(src).alias("source_term"), F.avg(tgt).alias("target_term"), (F.avg(src) + F.avg(tgt)).alias("disparity")
    )


def entropy_domain_weights(
    df: DataFrame, keys: Sequence[str], domain: str, probs: Sequence[str] = ("p0", "p1")
) -> DataFrame:
    """Per-row weight 1+exp(-H), normalised to sum 1 inside each domain.

    The domain totals are aggregated and joined back: a window over a domain would hold all its rows.
    """
    raw = df.withColumn("_w", F.lit(1.0) + F.exp(-entropy(probs, "offset")))
    sums = raw.groupBy(*keys, domain).agg(F.sum("_w").alias("_sum"))
    return with_group_stats(raw, sums, [*keys, domain]).withColumn("weight", F.col("_w") / F.col("_sum")).drop("_w", "_sum")
