"""From per-checkpoint probabilities to predicted labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import argmax, col, softmax

PROBS = ("p0", "p1")


def mean_checkpoints(
    df: DataFrame,
    keys: Sequence[str],
    probs: Sequence[str] = PROBS,
    carry: Sequence[str] = ("y_true",),
    expected_k: int | None = None,
) -> DataFrame:
    """Average class probabilities over checkpoints in double precision.

    `keys` identify one sample of one run. `n_checkpoints` counts the averaged rows; with
    `expected_k` a sample with any other count stops the job.
    """
    averaged = df.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in carry],
        *[F.avg(F.col(p).cast("double")).alias(p) for p in probs],
        F.count(F.lit(1)).alias("n_checkpoints"),
    )
    if expected_k is None:
        return averaged
    message = F.concat(
        F.lit(f"expected exactly {expected_k} checkpoints, got "), F.col("n_checkpoints").cast("string")
    )
    checked = F.when(F.col("n_checkpoints") == expected_k, F.col("n_checkpoints")).otherwise(F.raise_error(message))
    return averaged.withColumn("n_checkpoints", checked)


def predict(
    df: DataFrame,
    probs: Sequence[str] = PROBS,
    mode: str = "argmax",
    threshold: float = 0.5,
    target: int = 0,
    name: str = "y_pred",
) -> DataFrame:
    """Predicted class: argmax with ties to the lowest class, or `p[target] >= threshold` (two classes)."""
    if mode == "argmax":
        return df.withColumn(name, argmax(probs))
    if mode != "threshold" or len(probs) != 2:
        raise ValueError("mode must be 'argmax', or 'threshold' with two classes")
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be within [0, 1]")
    return df.withColumn(name, F.when(F.col(probs[target]) >= threshold, target).otherwise(1 - target))


def class_columns(df: DataFrame, array_col: str, n_classes: int, prefix: str = "p") -> DataFrame:
    """Spread an ARRAY<DOUBLE> of class probabilities into one column per class."""
    return df.withColumns({f"{prefix}{i}": F.col(array_col)[i].cast("double") for i in range(n_classes)})


def select_last_k(df: DataFrame, run_keys: Sequence[str], name_col: str, tag: str | Column, k: int) -> DataFrame:
    """The K highest epochs per run from names `<tag>_epoch<digits>.pth`, compared as numbers.

    Other names are ignored. Two names for any one epoch stop the job; `last_k_violations` lists every
    duplicate, and runs without any match, without stopping.
    """
    parsed = _parse_epochs(df, name_col, tag)
    others = [c for c in parsed.columns if c not in (*run_keys, "epoch")]
    # one row per (run, epoch) before ranking; the rank filter then prunes to k rows per run on the map side
    per_epoch = parsed.groupBy(*run_keys, "epoch").agg(F.count(F.lit(1)).alias("_same"), F.min(F.struct(*others)).alias("_row"))
    newest = Window.partitionBy(*run_keys).orderBy(F.col("epoch").desc())
    message = F.concat(F.lit("duplicate epoch "), F.col("epoch").cast("string"))
    single = F.when(F.col("_same") == 1, F.col("epoch")).otherwise(F.raise_error(message))
    per_epoch = per_epoch.withColumn("epoch", single)
    top = per_epoch.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= k)
    return top.select(*run_keys, *[F.col("_row")[c].alias(c) for c in others], "epoch")


def last_k_violations(df: DataFrame, run_keys: Sequence[str], name_col: str, tag: str | Column) -> DataFrame:
    parsed = _parse_epochs(df, name_col, tag)
    duplicates = (
        parsed.groupBy(*run_keys, "epoch")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(*run_keys, F.lit("duplicate_epoch").alias("rule"), "epoch")
    )
    empty = (
        df.select(*run_keys).distinct().join(parsed.select(*run_keys).distinct(), list(run_keys), "left_anti")
    ).select(*run_keys, F.lit("no_checkpoint").alias("rule"), F.lit(None).cast("bigint").alias("epoch"))
    return duplicates.unionByName(empty)


def _parse_epochs(df: DataFrame, name_col: str, tag: str | Column) -> DataFrame:
    prefix = F.lit(tag) if isinstance(tag, str) else tag
    tail = F.when(F.col(name_col).startswith(F.concat(prefix, F.lit("_epoch"))),
                  F.substr(F.col(name_col), F.length(prefix) + F.lit(1)))
    digits = F.regexp_extract(tail, r"^_epoch(\d+)\.pth$", 1)
    return df.withColumn("epoch", F.when(F.length(digits) > 0, digits.cast("bigint"))).where("epoch is not null")


def score_checkpoints(
    df: DataFrame,
    features: str,
    checkpoints: dict[int, Callable],
    n_classes: int,
    width: int,
    batch_size: int = 4096,
    probs_prefix: str = "p",
) -> DataFrame:
    """Run caller-supplied models over a feature array of `width`, one output row per (input row, checkpoint).

    `checkpoints` maps an epoch to a factory returning `predict(np.ndarray) -> np.ndarray` of logits.
    Factories run once per Python worker; the rows themselves stay partitioned.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    per_epoch = []
    for epoch, factory in sorted(checkpoints.items()):
        udf = predict_batch_udf(factory, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[width]])
        per_epoch.append(F.struct(F.lit(epoch).alias("epoch"), udf(F.col(features)).alias("logits")))
    scored = df.withColumn("_ckpt", F.explode(F.array(*per_epoch)))
    logits = [F.col("_ckpt.logits")[i] for i in range(n_classes)]
    return scored.select(
        *df.columns,
        F.col("_ckpt.epoch").alias("epoch"),
        *[p.alias(f"{probs_prefix}{i}") for i, p in enumerate(softmax(logits))],
    )


def blind(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Keep an allow-list of columns, so labels can not travel along."""
    missing = [c for c in allowed if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    return df.select(*allowed)


def churn(df: DataFrame, run_keys: Sequence[str], sample: str, epoch: str, pred: str) -> DataFrame:
    """Share of samples whose prediction changed since the previous epoch; null for the first epoch."""
    # the sample leads: its values tell most rows apart in the sort, those of a run few
    before = Window.partitionBy(sample, *run_keys).orderBy(epoch)
    flips = df.withColumn("_prev", F.lag(col(pred)).over(before))
    changed = F.when(F.col("_prev").isNotNull(), (F.col("_prev") != F.col(pred)).cast("double"))
    return flips.groupBy(*run_keys, epoch).agg(
        F.avg(changed).alias("churn"), F.count(F.lit(1)).alias("n_samples")
    )
