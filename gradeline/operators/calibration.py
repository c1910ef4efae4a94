"""Probability quality: Brier score, calibration error, confidence, covariate strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import argmax, col, entropy, equal_width_bin, f64, is_finite, total
from .metrics import confusion_counts, with_class_metrics
from .running import quantiles, with_summary

PROBS = ("p0", "p1")


def _brier_term(probs: Sequence[str], y: str) -> Column:
    return total([F.pow(f64(p) - F.when(F.col(y) == i, 1.0).otherwise(0.0), 2) for i, p in enumerate(probs)])


def brier(df: DataFrame, keys: Sequence[str], probs: Sequence[str] = PROBS, y: str = "y_true") -> DataFrame:
    """Mean squared distance to the one-hot truth, overall and by true class (null if absent)."""
    term = _brier_term(probs, y)
    return df.groupBy(*keys).agg(
        F.avg(term).alias("brier"),
        *[F.avg(F.when(F.col(y) == i, term)).alias(f"brier_{i}") for i in range(len(probs))],
    )


def calibration_error(
    df: DataFrame, keys: Sequence[str], n_bins: int = 15, probs: Sequence[str] = PROBS, y: str = "y_true",
    sparse_below: int = 10,
) -> DataFrame:
    """Equal-width top-label and class-wise calibration error.

    One row per (key, target) with target 'top_label' or the class index: the error, number of
    non-empty bins, smallest non-empty bin and whether that bin is sparse.
    """
    top = F.greatest(*[f64(p) for p in probs])
    targets = [F.struct(F.lit("top_label").alias("target"), top.alias("s"), (argmax(probs) == F.col(y)).cast("int").alias("e"))]
    targets += [
        F.struct(F.lit(str(i)).alias("target"), f64(p).alias("s"), (F.col(y) == i).cast("int").alias("e"))
        for i, p in enumerate(probs)
    ]
    bins = (
        df.select(*keys, F.explode(F.array(*targets)).alias("t"))
        .groupBy(*keys, F.col("t.target").alias("target"), equal_width_bin("t.s", n_bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("t.e").alias("events"), F.sum("t.s").alias("scores"))
    )
    gap = F.abs(F.col("events") / F.col("n") - F.col("scores") / F.col("n"))
    return bins.groupBy(*keys, "target").agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("calibration_error"),
        F.count(F.lit(1)).alias("n_bins_used"),
        F.min("n").alias("smallest_bin"),
        (F.min("n") < sparse_below).alias("sparse"),
    )


def classwise_calibration_error(errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Top-label error and the mean over class targets, from `calibration_error` rows."""
    is_top = F.col("target") == "top_label"
    return errors.groupBy(*keys).agg(
        F.max(F.when(is_top, F.col("calibration_error"))).alias("ece"),
        F.avg(F.when(~is_top, F.col("calibration_error"))).alias("classwise_error"),
    )


def confidence_entropy(df: DataFrame, keys: Sequence[str], probs: Sequence[str] = PROBS, y: str = "y_true") -> DataFrame:
    """Mean maximum probability and entropy overall, by true class and by correctness."""
    slim = df.select(
        *keys,
        F.col(y).cast("string").alias("y"),
        F.when(argmax(probs) == F.col(y), "correct").otherwise("wrong").alias("ok"),
        F.greatest(*[f64(p) for p in probs]).alias("conf"),
        entropy(probs).alias("ent"),
    )
    # counts per (true class, correctness) first; the three views are sums of those few rows
    cells = slim.groupBy(*keys, "y", "ok").agg(
        F.sum("conf").alias("conf"), F.sum("ent").alias("ent"), F.count(F.lit(1)).alias("n")
    )
    views = F.explode(F.array(
        F.struct(F.lit("overall").alias("view"), F.lit("all").alias("value")),
        F.struct(F.lit("true_class").alias("view"), F.col("y").alias("value")),
        F.struct(F.lit("correctness").alias("view"), F.col("ok").alias("value")),
    ))
    return (
        cells.withColumn("g", views)
        .groupBy(*keys, F.col("g.view").alias("view"), F.col("g.value").alias("value"))
        .agg(
            (F.sum("conf") / F.sum("n")).alias("mean_confidence"),
            (F.sum("ent") / F.sum("n")).alias("mean_entropy"),
            F.sum("n").alias("n"),
        )
    )


def quantile_edges(df: DataFrame, value: str, n_bins: int) -> DataFrame:
    """One row with the distinct linear-interpolation quantile edges of the finite values, none without any."""
    points = {f"e{i}": i / n_bins for i in range(n_bins + 1)}
    edges = quantiles(df, [], value, points).select(F.array_distinct(F.array(*points)).alias("edges"))
    counted = df.agg(F.count(F.when(F.col(value).isNull() | ~is_finite(value), 1)).alias("excluded"))
    return with_summary(counted, edges).select(F.coalesce("edges", F.array().cast("array<double>")).alias("edges"), "excluded")


def stratified_metrics(
    df: DataFrame, cov: str, n_bins: int = 3, keys: Sequence[str] = (), y: str = "y_true", yhat: str = "y_pred",
    edges: DataFrame | None = None,
) -> DataFrame:
    """Per-class metrics inside quantile bins of a covariate.

    A value equal to an inner edge goes to the upper bin; null and NaN values are excluded and counted,
    infinite ones stop the job. Edges are shared by all keys and computed from `df` unless given. Every
    key has a row for every bin, with zero support where it is empty. Without any valid value there is
    one row per key with a null bin and status 'no_valid_covariates'.
    """
    value = col(cov).cast("double")
    df = df.withColumn(cov, F.when(F.abs(value) == F.lit(float("inf")), F.raise_error(F.lit(f"{cov} has an infinite value"))).otherwise(F.col(cov)))
    cut = edges if edges is not None else quantile_edges(df, cov, n_bins)
    inner = F.slice(F.col("edges"), F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = with_summary(df, cut).withColumn("bin", F.when(is_finite(cov), F.size(F.filter(inner, lambda e: e <= value))))
    cells = ["c00", "c01", "c10", "c11"]
    counts = confusion_counts(binned, [*keys, "edges", "excluded", "bin"], y=y, yhat=yhat)
    # at most n_bins + 1 entries per key
    held = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct(*cells).alias("c")))))
    per_key = counts.groupBy(*keys, "edges", "excluded").agg(held.alias("_held")).withColumn("n_edges", F.size(F.array_compact("edges")))
    bins = F.when(F.col("n_edges") > 0, F.sequence(F.lit(0), F.greatest(F.col("n_edges") - 2, F.lit(0)))).otherwise(F.array(F.lit(None).cast("int")))
    rows = per_key.withColumn("bin", F.explode(bins)).select(
        *keys, "bin", F.get("edges", F.col("bin")).alias("lo"), F.get("edges", F.least(F.col("bin") + 1, F.col("n_edges") - 1)).alias("hi"),
        "n_edges", "excluded", *[F.coalesce(F.try_element_at("_held", F.coalesce("bin", F.lit(-1)))[c], F.lit(0)).alias(c) for c in cells])
    status = F.when(F.col("n_edges") == 0, "no_valid_covariates").when(F.col("n_edges") == 1, "degenerate_equal_covariate").otherwise("ok")
    return with_class_metrics(rows).withColumn("status", status).withColumn("sparse", F.least("support_0", "support_1") < 10)
