"""Paired inference and multiplicity correction as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import f64, hash_index, is_finite
from ..functions.student import critical_value, two_sided_p
from .running import running_folds, score_buckets


def paired_t(diffs: DataFrame, keys: Sequence[str], diff: str = "difference", confidence: float = 0.95) -> DataFrame:
    """Two-sided paired t test and interval per key.

    Zero spread gives t=0, p=1 for a zero mean, else t=+-inf, p=0, and an interval equal to the mean.
    Groups with fewer than two pairs are kept and marked `insufficient`.
    """
    d = f64(diff)
    agg = diffs.groupBy(*keys).agg(
        F.count(d).alias("n"),
        F.avg(d).alias("mean_difference"),
        F.stddev_samp(d).alias("_sd"),
        F.min(d).alias("_min"),
        F.max(d).alias("_max"),
    )
    # equal inputs have exactly zero spread; the moment formula may leave a rounding residue
    flat = F.col("_min") == F.col("_max")
    sized = agg.withColumns({
        "insufficient": F.col("n") < 2,
        "df": (F.col("n") - 1).cast("int"),
        "mean_difference": F.when(flat, F.col("_min")).otherwise(F.col("mean_difference")),
        "sample_sd": F.when(flat, F.lit(0.0)).otherwise(F.col("_sd")),
    })
    mean, sd, usable = F.col("mean_difference"), F.col("sample_sd"), ~F.col("insufficient")
    with_se = sized.withColumns({
        "standard_error": F.when(usable, sd / F.sqrt(f64("n"))),
        "t_critical": F.when(usable, critical_value(confidence, "df")),
    })
    se = F.col("standard_error")
    infinite = F.when(mean > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    degenerate = F.when(mean == 0, F.lit(0.0)).otherwise(infinite)
    stat = F.when(usable, F.when(sd == 0, degenerate).otherwise(mean / se))
    p_flat = F.when(mean == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    tested = with_se.withColumn("t_statistic", stat)
    return tested.select(
        *keys, "n", "df", "insufficient", "mean_difference", "sample_sd", "standard_error", "t_statistic", "t_critical",
        F.when(usable, F.when(sd == 0, p_flat).otherwise(two_sided_p("t_statistic", "df"))).alias("p_value"),
        F.when(usable, F.when(sd == 0, mean).otherwise(mean - F.col("t_critical") * se)).alias("ci_lo"),
        F.when(usable, F.when(sd == 0, mean).otherwise(mean + F.col("t_critical") * se)).alias("ci_hi"),
    )


def t_interval(values: DataFrame, keys: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Mean, sample SD and t interval of per-seed values."""
    out = paired_t(values, keys, value, confidence)
    return out.select(
        *keys, "n", F.col("mean_difference").alias("mean"), F.col("sample_sd").alias("sd"), "ci_lo", "ci_hi"
    )


def effect_over_se(tested: DataFrame) -> DataFrame:
    """|mean| over its standard error, infinite for a vanishing standard error, null without one."""
    ratio = F.abs("mean_difference") / F.col("standard_error")
    return tested.withColumn(
        "effect_over_se", F.when(F.col("standard_error") > 1e-12, ratio).when(F.col("standard_error").isNotNull(), F.lit(math.inf))
    )


def decide(tested: DataFrame, lo: str = "ci_lo", hi: str = "ci_hi", mean: str = "mean_difference") -> DataFrame:
    """EFFECTIVE iff the interval excludes zero; direction by the sign of the mean."""
    excludes = (F.col(lo) > 0) | (F.col(hi) < 0)
    return tested.withColumns({
        "excludes_zero": excludes,
        "verdict": F.when(excludes, "EFFECTIVE").otherwise("INCONCLUSIVE"),
        "direction": F.when(excludes, F.when(F.col(mean) > 0, "improve").otherwise("degrade")).otherwise("n/a"),
    })


def bootstrap_paired_ci(
    diffs: DataFrame, keys: Sequence[str], diff: str = "difference", order: str = "seed",
    n_boot: int = 10_000, seed: int = 12345,
) -> DataFrame:
    """Percentile interval of resampled mean differences.

    Draws are hash-based, so a retried task repeats them. Pairs (one per seed) travel as a sorted
    array per group and the resamples are spread over the cluster, not over the driver.
    """
    packed = diffs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), f64(diff).alias("d")))).alias("_pairs")
    ).withColumn("_n", F.size("_pairs"))
    chunks = math.ceil(n_boot / 500)
    drawn = (
        packed.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        .repartition(*keys, "_chunk")
        .withColumn("b", F.explode(F.sequence(F.col("_chunk") * 500, F.least(F.col("_chunk") * 500 + 499, F.lit(n_boot - 1)))))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .select(*keys, "b", F.element_at("_pairs", (hash_index("_n", seed, "b", "i") + 1).cast("int"))["d"].alias("v"))
    )
    means = drawn.groupBy(*keys, "b").agg(F.avg("v").alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    out = means.groupBy(*keys).agg(q.alias("_q"), F.avg("m").alias("boot_mean"), F.count(F.lit(1)).alias("n_boot"))
    return out.select(*keys, F.col("_q")[0].alias("boot_lo"), F.col("_q")[1].alias("boot_hi"), "boot_mean", "n_boot")


def ci_agreement(df: DataFrame) -> DataFrame:
    """Compare a t interval (ci_lo, ci_hi) with a bootstrap one (boot_lo, boot_hi)."""
    t_out = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    b_out = (F.col("boot_lo") > 0) | (F.col("boot_hi") < 0)
    half = F.greatest(F.lit(1e-9), (F.col("ci_hi") - F.col("ci_lo")) / F.lit(2.0))
    lo = F.abs(F.col("ci_lo") - F.col("boot_lo")) / half
    hi = F.abs(F.col("ci_hi") - F.col("boot_hi")) / half
    return df.withColumns({
        "same_decision": t_out == b_out, "gap_lo": lo, "gap_hi": hi,
        "consistent": (t_out == b_out) & (lo < 0.5) & (hi < 0.5),
    })


def validate_p_values(df: DataFrame, p: str) -> DataFrame:
    """Rows whose p-value is missing, not finite or outside [0, 1]."""
    rule = F.when(~is_finite(p), "not_finite").when(~f64(p).between(0.0, 1.0), "outside_unit_interval")
    return df.withColumn("rule", rule).where("rule is not null")


def _steps(df: DataFrame, family: Sequence[str], p: str) -> DataFrame:
    """One row per distinct p of a family: rows `_n` with it, rows `cum_n` up to it, family size `_m`.

    A missing or invalid p-value stops the job. Tied p-values are one step however many there are.
    """
    message = F.concat(F.lit("invalid p-value "), F.coalesce(F.col(p).cast("string"), F.lit("null")))
    valid = F.when(is_finite(p) & f64(p).between(0.0, 1.0), f64(p)).otherwise(F.raise_error(message))
    steps = df.groupBy(*family, valid.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_folds(steps, family, [-b for b in score_buckets(F.col("_p"))], [F.col("_p")], {"_n": "sum"}, whole=True, keep_buckets=True)
    return cum.withColumnRenamed("all__n", "_m")


def _adjusted(df: DataFrame, steps: DataFrame, family: Sequence[str], p: str, name: str, alpha: float) -> DataFrame:
    found = steps.select(*family, F.col("_p"), F.least(F.lit(1.0), F.col("_run_scaled")).alias(name))
    keyed = df.withColumn("_p", f64(p)).join(found, [*family, "_p"])
    return keyed.select(*df.columns, name, (F.col(name) <= alpha).alias(name.replace("_p", "_rejected")))


def holm(df: DataFrame, family: Sequence[str], p: str = "p_value", order: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Holm step-down adjustment inside each family.

    Works on distinct p-values: the first rank of a tie decides for all of it, so `order` is not needed.
    Running counts and maxima are cut into the same p buckets, so one family may hold most of the rows and the
    second fold finds the steps where the first has left them.
    """
    first = F.col("cum__n") - F.col("_n") + 1
    scaled = _steps(df, family, p).withColumn("_scaled", (F.col("_m") - first + 1) * F.col("_p"))
    run = running_folds(scaled, family, ["_bucket0"], [F.col("_p")], {"_scaled": "max"}, prefix="_run")
    return _adjusted(df, run, family, p, "holm_p", alpha)


def benjamini_hochberg(
    df: DataFrame, family: Sequence[str], p: str = "p_value", order: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Benjamini-Hochberg step-up adjustment inside each family; the last rank of a tie decides for all of it."""
    scaled = _steps(df, family, p).withColumn("_scaled", F.col("_p") * F.col("_m") / F.col("cum__n"))
    run = running_folds(scaled, family, score_buckets(F.col("_p")), [F.col("_p").desc()], {"_scaled": "min"}, prefix="_run")
    return _adjusted(df, run, family, p, "bh_p", alpha)


def adjust_small_families(
    df: DataFrame, family: Sequence[str], p: str = "p_value", order: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Both adjustments in one exchange, for families declared up front (a fixed number of tests each).

    A test without a p-value (too few pairs) is no member of its family and stays without adjustment.
    """
    ranked = Window.partitionBy(*family).orderBy(F.col(p).asc_nulls_last(), *order)
    whole = Window.partitionBy(*family)
    k, m = F.row_number().over(ranked), F.count(p).over(whole)
    scaled = df.withColumns({"_down": (m - k + 1) * f64(p), "_up": f64(p) * m / k})
    upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
    onward = ranked.rowsBetween(0, Window.unboundedFollowing)
    adjusted = scaled.withColumns({
        "holm_p": F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_down").over(upto))),
        "bh_p": F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_up").over(onward))),
    })
    return adjusted.withColumns({
        "holm_rejected": F.col("holm_p") <= alpha, "bh_rejected": F.col("bh_p") <= alpha,
    }).drop("_down", "_up")


def compare_arms(
    seed_means: DataFrame, arm: str, reference, seed: str, metric: str, value: str, headline: Sequence[str],
    confidence: float = 0.95, alpha: float = 0.05, seeds: Sequence | None = None,
) -> DataFrame:
    """Reference arm minus every other arm for every metric, with two corrected families.

    `seed_means` holds one value per (arm, seed, metric). Family `all` covers every comparison,
    `headline` those whose metric is listed. Result rows are (family, arm, metric). Both arms of a
    comparison must have the same seeds, and `seeds` where given; else the job stops.
    """
    from .grid import pair_against

    if seeds is not None:
        known = F.col(seed).isin(list(seeds))
        seed_means = seed_means.withColumn(seed, F.when(known, F.col(seed)).otherwise(F.raise_error(F.concat(F.lit("unexpected seed "), F.col(seed).cast("string")))))
    # the reference paired with itself tells how many seeds it has, without a second pass over the input
    pairs = pair_against(seed_means, arm, reference, [metric], seed, value, strict=True, keep_reference=True)
    own = F.max(F.when(F.col(arm) == reference, F.col("n"))).over(Window.partitionBy(metric))
    tested = paired_t(pairs, [arm, metric], confidence=confidence)
    columns = tested.columns
    tested = tested.withColumn("_expected", own).where(F.col(arm) != reference)
    wanted = F.col("_expected") if seeds is None else F.lit(len(set(seeds)))
    message = F.concat(F.lit("seed sets differ for arm "), F.col(arm).cast("string"), F.lit(", metric "), F.col(metric))
    checked = F.when(F.col("n").eqNullSafe(F.col("_expected")) & (F.col("n") == wanted), F.col("n")).otherwise(F.raise_error(message))
    tested = tested.withColumn("n", checked).select(*columns)
    in_headline = F.col(metric).isin(list(headline))
    families = F.explode(F.when(in_headline, F.array(F.lit("all"), F.lit("headline"))).otherwise(F.array(F.lit("all"))))
    rows = tested.withColumn("family", families)
    return adjust_small_families(rows, ["family"], order=[arm, metric], alpha=alpha)


def family_summary(compared: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per family: number of tests, raw p below alpha, rejections after each correction."""
    return compared.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_tests"),
        F.count_if(F.col("p_value") < alpha).alias("raw_p_below_alpha"),
        F.count_if("holm_rejected").alias("holm_rejected"),
        F.count_if("bh_rejected").alias("bh_rejected"),
    )


def comparison_blocks(values: DataFrame, blocks: Sequence[dict], arm: str, seed: str, metric: str, value: str) -> DataFrame:
    """Declared comparisons y-x, each with primary and secondary metrics, in one job.

    A block is {name, x, y, primary, secondary, source?}; `source` selects rows of an optional
    `source` column of `values`. Seeds missing in one arm are skipped; a declared comparison without
    any pair is in the result, with n = 0 and `insufficient`.
    """
    spark = values.sparkSession
    rows = [
        (b["name"], b["x"], b["y"], m, role, b.get("source", "full"))
        for b in blocks for role in ("primary", "secondary") for m in b[role]
    ]
    arm_type = values.schema[arm].dataType.simpleString()
    config = spark.createDataFrame(rows, f"block string, x {arm_type}, y {arm_type}, {metric} string, role string, source string")
    data = values if "source" in values.columns else values.withColumn("source", F.lit("full"))
    side = lambda name: data.select("source", F.col(arm).alias(name), seed, metric, f64(value).alias(f"_{name}"))
    diffs = (
        config.join(side("x"), ["source", "x", metric])
        .join(side("y"), ["source", "y", metric, seed])
        .withColumn("difference", F.col("_y") - F.col("_x"))
    )
    tested = paired_t(diffs, ["block", "role", metric])
    declared = config.select("block", "role", metric).distinct().join(tested, ["block", "role", metric], "left")
    return decide(effect_over_se(declared.withColumns({
        "n": F.coalesce("n", F.lit(0).cast("bigint")), "insufficient": F.coalesce("insufficient", F.lit(True))})))
