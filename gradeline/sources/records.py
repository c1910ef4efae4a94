"""Readers for split tables, run records, envelopes, probes and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_SCHEMA = "domain string, fold int, split string, filepath string, label string"


def read_splits(
    spark: SparkSession, path: str, domain: str | None = None, fold: int | None = None, split: str | None = None,
    fmt: str = "parquet", expected: dict[str, int] | None = None,
) -> DataFrame:
    """Filtered read of the split table; on the partitioned form domain and fold prune directories.

    `expected` maps label to row count and refuses a different content.
    """
    reader = spark.read.schema(SPLIT_SCHEMA)
    table = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    for name, value in (("domain", domain), ("fold", fold), ("split", split)):
        if value is not None:
            table = table.where(F.col(name) == value)
    if expected is not None:
        found = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(len(expected) + 1).collect()}
        if found != expected:
            raise ValueError(f"split counts {found} differ from {expected}")
    return table


def read_run_records(
    spark: SparkSession, path: str, schema: str | T.StructType, strict: dict[str, Sequence[int]] | None = None, multiline: bool = False
) -> DataFrame:
    """JSON records keyed (arm, seed) by a path element `<arm>_seed<seed>`.

    Without `strict` any parseable name is taken and others are skipped. With it, the exact
    arm x seed grid is demanded.
    """
    raw = spark.read.schema(schema).option("multiLine", multiline).option("recursiveFileLookup", True).json(path)
    where = F.col("_metadata.file_path")
    pattern = r"(?:^|[/=])(\d+)_seed(\d+)(?:\.json)?(?:/|$)"
    keyed = raw.withColumns({"_arm": F.regexp_extract(where, pattern, 1), "_seed": F.regexp_extract(where, pattern, 2)})
    records = keyed.where(F.length("_arm") > 0).select(
        F.col("_arm").cast("int").alias("arm"), F.col("_seed").cast("int").alias("seed"),
        *[c for c in raw.columns if c not in ("arm", "seed")],
    )
    if strict is not None:
        from ..operators.grid import enforce, grid_complete

        enforce(grid_complete(records.select("arm", "seed"), strict), "run records")
    return records


def read_records_envelope(lines: DataFrame, value: str, record_schema: str, key: str = "records") -> DataFrame:
    """Documents that are either an array of records or an object holding that array under `key`."""
    as_array = F.from_json(value, f"array<{record_schema}>")
    as_object = F.from_json(value, f"struct<{key}: array<{record_schema}>>")[key]
    picked = F.when(F.ltrim(F.col(value)).startswith("["), as_array).otherwise(as_object)
    checked = F.when(F.size(picked) > 0, picked).otherwise(F.raise_error(F.lit(f"document is not a non-empty array or an object with {key}")))
    return lines.select(F.explode(checked).alias("r")).select("r.*")


PROBE_CLASS = (
    "struct<auc_mean: double, auc_std: double, n_synthetic: int, n_real: int, n_balanced_per_domain: int, "
    "n_resamples: int, folds_per_resample: int, n_auc_values: int>"
)


def read_format_probes(spark: SparkSession, path: str, classes: Sequence[str] = ("airplane", "ship"), multiline: bool = False) -> DataFrame:
    """Per-arm probe documents to one row per (arm, class)."""
    fields = ", ".join(f"{c} {PROBE_CLASS}" for c in classes)
    docs = spark.read.schema(f"arm int, arm_dir string, {fields}").option("multiLine", multiline).json(path)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("v")) for c in classes]))
    return docs.select("arm", "arm_dir", rows.alias("p")).select("arm", "arm_dir", "p.class", "p.v.*")


STEP_LOG_SCHEMA = "step bigint, run_id bigint, progress double, base_lr double, lr double, coeff double"


def read_log(spark: SparkSession, path: str, schema: str = STEP_LOG_SCHEMA) -> DataFrame:
    """Append-only JSON lines, as a batch."""
    return spark.read.schema(schema).json(path)


def stream_log(spark: SparkSession, path: str, schema: str = STEP_LOG_SCHEMA, files_per_trigger: int | None = None) -> DataFrame:
    """The same log as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated label-access lines: an ISO timestamp followed by key=value fields."""
    parts = F.split("value", "\t")
    fields = F.str_to_map(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "\t"), F.lit("\t"), F.lit("="))
    return spark.read.text(path).select(F.to_timestamp(parts[0]).alias("ts"), fields.alias("f")).select(
        "ts", *[F.col("f")[k].alias(k) for k in ("caller", "reason", "csv", "domain", "fold", "split")],
        F.col("f")["n_labels_read"].cast("bigint").alias("n_labels_read"),
    )
