"""Sinks. Spark's commit protocol makes every write appear whole or not at all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_splits(splits: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Split table partitioned by (domain, fold), so readers of one fold list one directory."""
    writer = splits.sortWithinPartitions("split", "filepath").write.mode(mode).partitionBy("domain", "fold")
    writer.option("header", True).format(fmt).save(path)


def write_splits_file(splits: DataFrame, path: str, columns: Sequence[str] = ("domain", "fold", "split", "filepath", "label")) -> None:
    """Row order fixed by all columns; one file per range, in range order."""
    splits.select(*columns).orderBy(*columns).write.mode("errorifexists").option("header", True).csv(path)


def splits_hash(splits: DataFrame, columns: Sequence[str] = ("domain", "fold", "split", "filepath", "label")) -> DataFrame:
    """Order-free content hash of a split table: row count and sums of two halves of each row's digest."""
    digest = F.md5(F.concat_ws(",", *columns))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")
    return splits.agg(
        F.count(F.lit(1)).alias("n"), F.sum(half(1)).cast("string").alias("h1"), F.sum(half(17)).cast("string").alias("h2")
    )


def _holds_nan(c: Column, kind: T.DataType) -> Column | None:
    """Whether a value of this type holds NaN at any depth; None where the type can not."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(c), F.lit(False))
    if isinstance(kind, T.StructType):
        parts = [x for x in (_holds_nan(c[f.name], f.dataType) for f in kind.fields) if x is not None]
        return reduce(lambda x, y: x | y, parts) if parts else None
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
    if inner is None or _holds_nan(F.lit(None).cast(inner), inner) is None:
        return None
    values = F.map_values(c) if isinstance(kind, T.MapType) else c
    return F.coalesce(F.exists(values, lambda x: _holds_nan(x, inner)), F.lit(False))


def strict_json_columns(df: DataFrame) -> DataFrame:
    """The same columns; NaN at any depth of one stops the job."""
    out = {}
    for field in df.schema.fields:
        bad = _holds_nan(F.col(field.name), field.dataType)
        if bad is not None:
            out[field.name] = F.when(bad, F.raise_error(F.lit(f"refusing to write NaN in {field.name}"))).otherwise(F.col(field.name))
    return df.withColumns(out) if out else df


def write_strict_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a row: finite numbers as numbers, infinities by name as text, no NaN."""
    strict_json_columns(df).write.mode(mode).json(path)


def write_new_only(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Refuse an existing output location."""
    df.write.mode("errorifexists").format(fmt).save(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_curve(curve: DataFrame, path: str) -> None:
    """Per-epoch table; a null is written as the empty string."""
    curve.write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def churn_matrix(preds: DataFrame, keys: Sequence[str], slot: str, pred: str, n_slots: int) -> DataFrame:
    """Wide prediction matrix a0..a<n-1>, one row per key and epoch; any other slot stops the job."""
    known = F.coalesce(F.col(slot).between(0, n_slots - 1), F.lit(False))
    message = F.concat(F.lit("slot outside the matrix: "), F.coalesce(F.col(slot).cast("string"), F.lit("null")))
    preds = preds.withColumn(slot, F.when(known, F.col(slot)).otherwise(F.raise_error(message)))
    wide = [F.max(F.when(F.col(slot) == i, F.col(pred))).alias(f"a{i}") for i in range(n_slots)]
    return preds.groupBy(*keys).agg(*wide)


def churn_long(matrix: DataFrame, keys: Sequence[str], n_slots: int) -> DataFrame:
    """Inverse of `churn_matrix`."""
    long = matrix.unpivot(list(keys), [f"a{i}" for i in range(n_slots)], "slot_name", "pred")
    return long.select(*keys, F.substring("slot_name", 2, 9).cast("int").alias("slot"), "pred").where("pred is not null")


def write_churn_matrix(preds: DataFrame, keys: Sequence[str], slot: str, pred: str, n_slots: int, path: str) -> None:
    churn_matrix(preds, keys, slot, pred, n_slots).write.mode("errorifexists").option("header", True).csv(path)


def write_labels_by_class(rows: DataFrame, label: str, path: str) -> None:
    """One table partitioned by class: a class is a directory, the whole is the root."""
    rows.write.mode("errorifexists").partitionBy(label).parquet(path)


def persist_bank(bank: DataFrame, id_col: str, path: str) -> None:
    """Parameter bank with a fresh index 0..n-1 in id order."""
    from ..operators.splits import reindex

    reindex(bank, id_col).write.mode("errorifexists").parquet(path)


def store_predictions(preds: DataFrame, table: str, path: str, sample: str = "sample_id", buckets: int = 64, sort: Sequence[str] = ()) -> DataFrame:
    """Predictions as a table bucketed by sample and sorted inside buckets; returned as it reads back.

    Rows of one sample lie in one bucket, so averages over checkpoints, churn and joins by sample need no exchange,
    however many runs and epochs follow. `path` must be in storage that every executor reaches; an existing table stops the write.
    Take as many buckets as make a bucket fit a task: the count stays with the table. A null sample is a bucket's like any other.
    """
    writer = preds.repartition(buckets, sample).write.mode("errorifexists").format("parquet").option("path", path)
    writer.bucketBy(buckets, sample).sortBy(sample, *sort).saveAsTable(table)
    return preds.sparkSession.table(table)
