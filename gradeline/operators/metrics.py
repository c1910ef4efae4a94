"""Confusion counts and the metrics computed from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, f64, is_finite, pick, safe_div, total
from .running import with_summary

# The ten scalar metrics of a two-class run, class 0 = airplane, class 1 = ship.
SCALAR_METRICS = (
    "precision_airplane", "recall_airplane", "f1_airplane",
    "precision_ship", "recall_ship", "f1_ship",
    "macro_f1", "balanced_accuracy", "aircraft_recall", "accuracy",
)


def confusion_counts(df: DataFrame, keys: Sequence[str], n_classes: int = 2, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """One row per key with columns c<true><pred>, zero cells included.

    A single conditional aggregate: the map side reduces each partition to one row per key, so a
    hot run costs no more than the others.
    """
    cells = [
        F.sum(F.when((F.col(y) == i) & (F.col(yhat) == j), 1).otherwise(0)).alias(f"c{i}{j}")
        for i in range(n_classes)
        for j in range(n_classes)
    ]
    return df.groupBy(*keys).agg(*cells)


def confusion_matrix(df: DataFrame, keys: Sequence[str], n_classes: int = 2, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """Long form (true, pred, n) with every cell present."""
    wide = confusion_counts(df, keys, n_classes, y, yhat)
    cells = F.array(*[
        F.struct(F.lit(i).alias("true"), F.lit(j).alias("pred"), F.col(f"c{i}{j}").alias("n"))
        for i in range(n_classes)
        for j in range(n_classes)
    ])
    return wide.select(*keys, F.explode(cells).alias("cell")).select(*keys, "cell.true", "cell.pred", "cell.n")


def per_class(n_classes: int = 2) -> dict[str, Column]:
    """Precision, recall, F1 and support per class from c<true><pred>; 0 on zero division."""
    out: dict[str, Column] = {}
    rng = range(n_classes)
    for c in rng:
        hit = F.col(f"c{c}{c}")
        precision = safe_div(hit, total([F.col(f"c{i}{c}") for i in rng]))
        recall = safe_div(hit, total([F.col(f"c{c}{j}") for j in rng]))
        out[f"precision_{c}"] = precision
        out[f"recall_{c}"] = recall
        out[f"f1_{c}"] = safe_div(F.lit(2.0) * precision * recall, precision + recall)
        out[f"support_{c}"] = total([F.col(f"c{c}{j}") for j in rng])
    return out


def with_class_metrics(counts: DataFrame, n_classes: int = 2) -> DataFrame:
    """Add per-class metrics and macro_f1 to a table of confusion counts."""
    scored = counts.withColumns(per_class(n_classes))
    return scored.withColumn("macro_f1", total([F.col(f"f1_{c}") for c in range(n_classes)]) / F.lit(float(n_classes)))


def classification_metrics(df: DataFrame, keys: Sequence[str], n_classes: int = 2, y: str = "y_true", yhat: str = "y_pred") -> DataFrame:
    """Per-class precision/recall/F1/support, macro-F1 and the confusion cells per key."""
    return with_class_metrics(confusion_counts(df, keys, n_classes, y, yhat), n_classes)


def metrics_from_confusion(counts: DataFrame, cells: Sequence[str] = ("c00", "c01", "c10", "c11")) -> DataFrame:
    """The ten scalar metrics of a stored 2x2 matrix given as columns true0pred0, 0/1, 1/0, 1/1."""
    aa, a_s, s_a, ss = (F.col(c) for c in cells)
    p_a, r_a = safe_div(aa, aa + s_a), safe_div(aa, aa + a_s)
    p_s, r_s = safe_div(ss, ss + a_s), safe_div(ss, ss + s_a)
    f_a = safe_div(F.lit(2.0) * p_a * r_a, p_a + r_a)
    f_s = safe_div(F.lit(2.0) * p_s * r_s, p_s + r_s)
    values = (
        p_a, r_a, f_a, p_s, r_s, f_s,
        (f_a + f_s) / F.lit(2.0), (r_a + r_s) / F.lit(2.0), r_a, safe_div(aa + ss, aa + a_s + s_a + ss),
    )
    return counts.withColumns(dict(zip(SCALAR_METRICS, values)))


def imbalance_metrics(counts: DataFrame) -> DataFrame:
    """MCC, Cohen kappa, balanced accuracy and g-mean from c00..c11, with a status.

    Recall averages are null when a true class is absent; kappa is null when it is 0/0; an undefined
    MCC is 0.
    """
    c00, c01, c10, c11 = (f64(c) for c in ("c00", "c01", "c10", "c11"))
    t0, t1, q0, q1 = c00 + c01, c10 + c11, c00 + c10, c01 + c11
    n = t0 + t1
    present = (t0 > 0) & (t1 > 0)
    r0, r1 = c00 / t0, c11 / t1
    spread = t0 * t1 * q0 * q1
    expected = t0 * q0 + t1 * q1
    kappa = F.when(n * n != expected, (n * (c00 + c11) - expected) / (n * n - expected))
    return counts.withColumns({
        "mcc": F.when(spread > 0, (c00 * c11 - c01 * c10) / F.sqrt(spread)).otherwise(F.lit(0.0)),
        "cohen_kappa": kappa,
        "balanced_accuracy": F.when(present, (r0 + r1) / F.lit(2.0)),
        "gmean": F.when(present, F.sqrt(r0 * r1)),
        "status": F.when(~present, "undefined_class_recall").when(kappa.isNull(), "cohen_kappa_undefined").otherwise("ok"),
    })


def directed_confusion(counts: DataFrame, n_classes: int = 2) -> DataFrame:
    """Off-diagonal rate per true class, null when the class is absent."""
    rates = {}
    for i in range(n_classes):
        support = total([F.col(f"c{i}{j}") for j in range(n_classes)])
        for j in range(n_classes):
            if i != j:
                rates[f"rate_{i}_to_{j}"] = F.when(support > 0, f64(f"c{i}{j}") / support)
    return counts.withColumns(rates)


def melt(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to (metric, value) rows."""
    return df.select(*keys, *[f64(m).alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")


def extract_metric(df: DataFrame, keys: Sequence[str], path: str, root: str = "metrics") -> DataFrame:
    """One number per record by dotted path; missing, boolean or non-finite values stop the job."""
    schema = df.select(F.col(f"{root}.{path}").alias("v")).schema["v"].dataType.typeName()
    if schema not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        raise ValueError(f"{path} holds {schema}; a metric must be numeric")
    value = f64(F.col(f"{root}.{path}"))
    checked = F.when(is_finite(value), value).otherwise(F.raise_error(F.lit(f"metric '{path}' must be finite")))
    return df.select(*keys, F.lit(path).alias("metric"), checked.alias("value"))


def flatten_metrics(df: DataFrame, keys: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Nested records to long (metric, value) rows; `fields` maps metric name to column path."""
    flat = df.select(*keys, *[f64(F.col(path)).alias(name) for name, path in fields.items()])
    long = flat.unpivot(list(keys), list(fields), "metric", "value")
    bad = F.raise_error(F.concat(F.lit("non-finite metric "), F.col("metric")))
    return long.withColumn("value", F.when(is_finite("value"), F.col("value")).otherwise(bad))


def class_weights(
    counts: DataFrame, cls: str, n: str, scheme: str = "inverse", beta: float = 0.999, classes: Sequence | None = None,
) -> DataFrame:
    """Class weights from one row per class; an empty class stops the job, and so does one of `classes` without a row.

    inverse           n / (C * n_c)
    effective_number  (1-beta)/(1-beta^n_c), scaled to mean 1
    """
    size = f64(n)
    checked = F.when(size > 0, size).otherwise(F.raise_error(F.concat(F.lit("empty class "), F.col(cls).cast("string"))))
    table = counts.withColumn("_n", checked)
    if classes is not None:
        seen = counts.agg(F.collect_set(F.when(F.col(cls).isin(list(classes)), F.col(cls))).alias("_seen"))  # at most the declared classes
        lacking = F.array_except(F.array(*[F.lit(c) for c in classes]), F.col("_seen"))
        message = F.concat(F.lit("empty class "), F.array_join(F.transform(lacking, lambda c: c.cast("string")), ", "))
        table = with_summary(table, seen).withColumn("_n", F.when(F.size(lacking) == 0, F.col("_n")).otherwise(F.raise_error(message))).drop("_seen")
    if scheme == "inverse":
        raw = F.col("_n")
        summary = table.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_classes"))
        weight = F.col("_total") / (F.col("_classes") * F.col("_n"))
    elif scheme == "effective_number":
        raw = F.lit(1.0 - beta) / (F.lit(1.0) - F.pow(F.lit(beta), F.col("_n")))
        table = table.withColumn("_raw", raw)
        summary = table.agg(F.sum("_raw").alias("_total"), F.count(F.lit(1)).alias("_classes"))
        weight = F.col("_raw") / F.col("_total") * F.col("_classes")
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    return with_summary(table, summary).select(*counts.columns, weight.alias("weight"))


def weighted_log_loss(
    df: DataFrame, keys: Sequence[str], weights: Sequence[float], probs: Sequence[str] = ("p0", "p1"),
    y: str = "y_true", yhat: str = "y_pred", floor: float = 1e-12,
) -> DataFrame:
    """Class-weighted mean cross-entropy and accuracy."""
    w = pick(y, [F.lit(float(v)) for v in weights])
    p = F.greatest(pick(y, [f64(c) for c in probs]), F.lit(floor))
    return df.groupBy(*keys).agg(
        (F.sum(-w * F.log(p)) / F.sum(w)).alias("log_loss"),
        F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def oof_summary(folds: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample SD over folds plus the pooled out-of-fold confusion cells."""
    return folds.groupBy(*keys).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
        *[F.sum(c).alias(f"oof_{c}") for c in ("c00", "c01", "c10", "c11")],
        F.count(F.lit(1)).alias("n_folds"),
    )


def require_authorisation(authorized: bool, reason: str) -> None:
    """Diagnostics that read target labels need both, stated by the caller."""
    if authorized is not True or not isinstance(reason, str) or not reason.strip():
        raise PermissionError("reading target labels needs authorized=True and a non-empty reason")


def _count_reached(score: Column, cuts: Sequence[float], before: int = 0) -> Column:
    """How many of the ascending cuts the score reaches, by halving; a null score reaches none."""
    if not cuts:
        return F.lit(before)
    middle = len(cuts) // 2
    return F.when(score >= cuts[middle], _count_reached(score, cuts[middle + 1 :], before + middle + 1)).otherwise(
        _count_reached(score, cuts[:middle], before))


def threshold_sweep(
    df: DataFrame, keys: Sequence[str], thresholds: Sequence[float], score: str = "p0", y: str = "y_true",
    *, authorized: bool, reason: str,
) -> DataFrame:
    """Two-class metrics at every given threshold of the class-0 score; nothing is selected.

    A diagnostic on target labels: refused without authorisation and a reason.

    Each row is counted once, under the number of thresholds its score reaches, which a balanced tree
    of comparisons finds; cumulating those counts over the (keys x thresholds) table gives every
    confusion matrix without multiplying rows.
    """
    require_authorisation(authorized, reason)
    cuts = sorted(float(t) for t in thresholds)
    if not cuts or len(set(cuts)) != len(cuts) or cuts[0] < 0 or cuts[-1] > 1:
        raise ValueError("thresholds must be non-empty, unique and within [0, 1]")
    reached = _count_reached(col(score), cuts)
    counts = df.groupBy(*keys, reached.alias("reached")).agg(
        F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("n1"),
    )
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(cuts)]))
    hit = F.col("reached") > F.col("cut.i")
    cells = (
        counts.withColumn("cut", grid)
        .groupBy(*keys, F.col("cut.t").alias("threshold"))
        .agg(
            F.sum(F.when(hit, F.col("n0")).otherwise(0)).alias("c00"),
            F.sum(F.when(~hit, F.col("n0")).otherwise(0)).alias("c01"),
            F.sum(F.when(hit, F.col("n1")).otherwise(0)).alias("c10"),
            F.sum(F.when(~hit, F.col("n1")).otherwise(0)).alias("c11"),
        )
    )
    scored = with_class_metrics(cells)
    n = F.col("support_0") + F.col("support_1")
    return scored.withColumn("class0_fraction", (F.col("c00") + F.col("c10")) / n)


_METRIC_PLUGINS: dict[str, tuple] = {}


def register_metric(name: str, aggregate: Column, finish: Column | None = None) -> None:
    """Add a caller-defined metric: an aggregate over prediction rows, then an optional expression on `name`."""
    _METRIC_PLUGINS[name] = (aggregate, finish)


def apply_metrics(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Evaluate registered metrics in one aggregation."""
    out = df.groupBy(*keys).agg(*[_METRIC_PLUGINS[n][0].alias(n) for n in names])
    finish = {n: _METRIC_PLUGINS[n][1] for n in names if _METRIC_PLUGINS[n][1] is not None}
    return out.withColumns(finish) if finish else out
