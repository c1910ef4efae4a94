"""Threshold-free ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import argmax, f64
from .metrics import with_class_metrics
from .running import running_totals, score_buckets


def _steps(df: DataFrame, keys: Sequence[str], score: str, y: str, positive: int) -> DataFrame:
    """Positives and rows per distinct score; equal scores form one step."""
    return df.groupBy(*keys, f64(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == positive, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n")
    )


def average_precision(
    df: DataFrame, keys: Sequence[str], score: str = "p0", y: str = "y_true", positive: int = 0
) -> DataFrame:
    """Non-interpolated average precision per key; null when only one true class exists.

    Running counts are cut into score buckets, so one run may hold most of the rows.
    """
    cum = running_totals(
        _steps(df, keys, score, y, positive), keys, score_buckets(F.col("score")), [F.col("score").desc()], ["pos", "n"]
    )
    # sum(pos * precision) and the class totals come out of the same aggregate
    out = cum.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("cum_pos") / F.col("cum_n"))).alias("weighted"),
        F.sum("pos").alias("n_pos"),
        F.sum("n").alias("n"),
    )
    mixed = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return out.select(*keys, F.when(mixed, F.col("weighted") / F.col("n_pos")).alias("average_precision"), "n_pos", "n")


def run_metrics(
    df: DataFrame, keys: Sequence[str], probs: Sequence[str] = ("p0", "p1"), y: str = "y_true"
) -> DataFrame:
    """Confusion cells, per-class metrics, macro-F1 and class-0 average precision of two-class runs.

    The distinct-score table carries the four confusion cells, so both kinds of metric come from one
    pass over the predictions.
    """
    cell = lambda t, q: F.sum(F.when((F.col(y) == t) & (F.col("_pred") == q), 1).otherwise(0)).alias(f"c{t}{q}")
    cells = ["c00", "c01", "c10", "c11"]
    steps = (
        df.withColumn("_pred", argmax(probs))
        .groupBy(*keys, f64(probs[0]).alias("score"))
        .agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))
    )
    # accumulating exactly the aggregated cells keeps both branches of the running totals on one exchange
    cum = running_totals(steps, keys, score_buckets(F.col("score")), [F.col("score").desc()], cells)
    cum_pos = F.col("cum_c00") + F.col("cum_c01")
    cum_n = cum_pos + F.col("cum_c10") + F.col("cum_c11")
    counts = cum.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in cells],
        F.sum((F.col("c00") + F.col("c01")) * (cum_pos / cum_n)).alias("_weighted"),
    )
    scored = with_class_metrics(counts)
    mixed = (F.col("support_0") > 0) & (F.col("support_1") > 0)
    return scored.withColumn(
        "average_precision", F.when(mixed, F.col("_weighted") / F.col("support_0"))
    ).drop("_weighted")


def average_precision_histogram(
    df: DataFrame, keys: Sequence[str], bins: int = 4096, score: str = "p0", y: str = "y_true", positive: int = 0
) -> DataFrame:
    """Opt-in approximation: scores are rounded to `bins` levels first, which bounds the step table."""
    level = F.floor(f64(score) * bins) / F.lit(float(bins))
    return average_precision(df.withColumn("_level", level), keys, "_level", y, positive)


def roc_auc(df: DataFrame, keys: Sequence[str], score: str = "p0", y: str = "y_true", positive: int = 0) -> DataFrame:
    """Mann-Whitney AUC with ties at half weight; null when only one true class exists."""
    steps = _steps(df, keys, score, y, positive).withColumn("neg", F.col("n") - F.col("pos"))
    cum = running_totals(steps, keys, score_buckets(F.col("score")), [F.col("score").desc()], ["pos", "neg"])
    # negatives at or below a step: all negatives minus those strictly above it
    above = F.col("cum_neg") - F.col("neg")
    out = cum.groupBy(*keys).agg(
        F.sum(f64("pos") * (above + F.col("neg") * F.lit(0.5))).alias("beaten"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    pairs = f64("n_pos") * f64("n_neg")
    return out.select(
        *keys,
        F.when(pairs > 0, (pairs - F.col("beaten")) / pairs).alias("roc_auc"),
        "n_pos",
        "n_neg",
    )
