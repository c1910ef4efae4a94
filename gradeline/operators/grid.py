"""The arm x seed x fold grid: completeness, fold means and pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import f64
from ..session import cut_lineage
from .running import quantiles, with_summary


def expected_grid(spark: SparkSession, dims: dict[str, Sequence]) -> DataFrame:
    """Every combination of the declared dimension values."""
    out = spark.range(1).select()
    for name, values in dims.items():
        if not values or len(set(values)) != len(values):
            raise ValueError(f"{name} must be non-empty and unique")
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def grid_complete(df: DataFrame, dims: dict[str, Sequence]) -> DataFrame:
    """Violations of an exact grid: one row per missing, extra or duplicated cell."""
    keys = list(dims)
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    want = expected_grid(df.sparkSession, dims).withColumn("_want", F.lit(True))
    both = cells.join(want, keys, "full")
    problem = (
        F.when(F.col("n").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    )
    return both.select(*keys, problem.alias("problem"), F.coalesce("n", F.lit(0)).alias("n")).where("problem is not null")


def enforce(violations: DataFrame, what: str) -> None:
    """Action: stop when a violations table is not empty, showing its first rows."""
    rows = violations.limit(20).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def validate_id_set(df: DataFrame, id_col: str, expected: Sequence[int]) -> DataFrame:
    """Ids that are outside the expected set, non-integral, or expected but absent."""
    if not expected or len(set(expected)) != len(expected) or any(isinstance(v, bool) or not isinstance(v, int) for v in expected):
        raise ValueError("expected ids must be unique non-empty integers")
    seen = df.select(f64(id_col).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    want = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(v)) for v in expected])).alias("id"))
    rule = F.when(F.col("n").isNull(), "missing_id").when(
        F.col("_want").isNull(), F.when(F.col("id") == F.floor("id"), "unexpected_id").otherwise("non_integer_id")
    )
    return (
        seen.join(want.withColumn("_want", F.lit(True)), "id", "full")
        .select("id", rule.alias("rule"), F.coalesce("n", F.lit(0)).alias("n"))
        .where("rule is not null")
    )


def aggregate_folds(
    records: DataFrame, keys: Sequence[str], fold: str, value: str, expected_folds: Sequence[int],
    collapsed: str | None = None,
) -> DataFrame:
    """Mean over exactly the expected folds; collapsed folds are listed and stay in the mean.

    A missing, extra or duplicated fold stops the job.
    """
    want = sorted(int(f) for f in expected_folds)
    flag = F.col(collapsed) if collapsed else F.lit(False)
    entries = F.array_sort(F.collect_list(F.struct(F.col(fold).alias("fold"), f64(value).alias("value"), flag.alias("collapsed"))))
    grouped = records.groupBy(*keys).agg(F.avg(f64(value)).alias("mean"), entries.alias("_e"))
    folds = F.transform("_e", lambda e: e["fold"].cast("int"))
    wanted = F.array(*[F.lit(f) for f in want])
    checked = F.when(folds == wanted, F.size("_e")).otherwise(
        F.raise_error(F.concat(F.lit("invalid folds "), F.array_join(folds, ",")))
    )
    return grouped.select(
        *keys,
        F.col("mean"),
        checked.alias("n_folds"),
        F.transform("_e", lambda e: e["value"]).alias("fold_values"),
        F.transform(F.filter("_e", lambda e: e["collapsed"]), lambda e: e["fold"].cast("int")).alias("collapsed_folds"),
    )


def pair_runs(
    a: DataFrame, b: DataFrame, keys: Sequence[str], seed: str, value: str, strict: bool = True
) -> DataFrame:
    """Differences a-b matched by seed id.

    strict  a seed present on one side only stops the job
    loose   such seeds are skipped
    """
    left = a.select(*keys, seed, f64(value).alias("value_a"))
    right = b.select(*keys, seed, f64(value).alias("value_b"))
    if not strict:
        joined = left.join(right, [*keys, seed])
    else:
        joined = left.join(right, [*keys, seed], "full")
        one_sided = F.col("value_a").isNull() | F.col("value_b").isNull()
        message = F.concat(F.lit("seed sets differ at seed "), F.col(seed).cast("string"))
        joined = joined.withColumn(seed, F.when(one_sided, F.raise_error(message)).otherwise(F.col(seed)))
    return joined.withColumn("difference", F.col("value_a") - F.col("value_b"))


def loose_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], seed: str, value: str) -> DataFrame:
    """One row per key of either side: how many seeds pair, which ones, and the mean of a-b.

    Seeds of one side only, or without a value, are skipped. A key with fewer than two pairs has its row too: it is
    `insufficient` and has no mean. Without keys there is one row, also where nothing pairs.
    """
    left = a.select(*keys, seed, f64(value).alias("_a"))
    right = b.select(*keys, seed, f64(value).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    joined = left.join(right, [*keys, seed], "full")
    agg = joined.groupBy(*keys).agg(
        F.count_if(both).alias("n_pairs"), F.sort_array(F.collect_list(F.when(both, F.col(seed)))).alias("used_seeds"),  # bounded by the seeds
        F.avg(F.when(both, F.col("_a") - F.col("_b"))).alias("_mean"))
    few = F.col("n_pairs") < 2
    return agg.select(*keys, "n_pairs", "used_seeds", few.alias("insufficient"), F.when(~few, F.col("_mean")).alias("mean_difference"))


def unmatched_seeds(a: DataFrame, b: DataFrame, keys: Sequence[str], seed: str) -> DataFrame:
    """Seeds found in only one of two arms."""
    on = [*keys, seed]
    return (
        a.select(*on).distinct().join(b.select(*on), on, "left_anti").withColumn("only_in", F.lit("a"))
        .unionByName(b.select(*on).distinct().join(a.select(*on), on, "left_anti").withColumn("only_in", F.lit("b")))
    )


def pair_against(
    values: DataFrame, arm: str, reference, keys: Sequence[str], seed: str, value: str, strict: bool = False, keep_reference: bool = False,
) -> DataFrame:
    """reference - arm for every other arm, matched on keys and seed.

    One exchange by (keys, seed) in place of a self-join, so the inputs are computed once. A seed the
    reference lacks is skipped, or stops the job when `strict`. With `keep_reference` it is paired with
    itself as well.
    """
    cell = Window.partitionBy(*keys, seed)
    ref = F.max(F.when(F.col(arm) == reference, f64(value))).over(cell)
    if strict:
        message = F.concat(F.lit("the reference arm lacks seed "), F.col(seed).cast("string"))
        ref = F.coalesce(ref, F.raise_error(message).cast("double"))
    return (
        values.withColumn("value_a", ref)
        .where(F.col("value_a").isNotNull() if keep_reference else (F.col(arm) != reference) & F.col("value_a").isNotNull())
        .select(
            arm, *keys, seed, "value_a", f64(value).alias("value_b"),
            (F.col("value_a") - f64(value)).alias("difference"),
        )
    )


def pair_long(arms: DataFrame, reference: str, metric_map: str = "values") -> DataFrame:
    """Pair nested per-seed points of every arm with one reference arm.

    `arms` has arm_id and points ARRAY<STRUCT<seed, values MAP<STRING, DOUBLE>>>. The reference must
    hold each (seed, metric) exactly once. The flat points are written once, as either side of the join would
    otherwise compute `arms` again.
    """
    flat = cut_lineage(
        arms.select("arm_id", F.explode("points").alias("p"))
        .select("arm_id", F.col("p.seed").alias("seed"), F.explode(F.col(f"p.{metric_map}")).alias("metric", "value"))
    )
    ref = (
        flat.where(F.col("arm_id") == reference)
        .groupBy("seed", "metric")
        .agg(F.min("value").alias("_v"), F.count(F.lit(1)).alias("_n"))
        .withColumn("ref_value", F.when(F.col("_n") == 1, F.col("_v")).otherwise(
            F.raise_error(F.lit("reference arm is not unique"))))
        .drop("_v", "_n")
    )
    joined = flat.where(F.col("arm_id") != reference).join(ref, ["seed", "metric"], "left")
    checked = F.when(F.col("ref_value").isNull(), F.raise_error(F.lit("reference arm is incomplete"))).otherwise(
        F.col("value") - F.col("ref_value")
    )
    return joined.select("arm_id", "metric", "seed", "value", "ref_value", checked.alias("difference"))


def pending_cells(grid: DataFrame, records: DataFrame, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Work list: cells without a record, and cells whose stored identity fields no longer match."""
    stored = records.select(*keys, *[F.col(f).alias(f"_stored_{f}") for f in identity], F.lit(True).alias("_has"))
    joined = grid.join(stored, list(keys), "left")
    same: Column = F.lit(True)
    for field in identity:
        same = same & F.col(field).eqNullSafe(F.col(f"_stored_{field}"))
    state = F.when(F.col("_has").isNull(), "pending").when(~same, "stale").otherwise("done")
    return joined.select(*keys, state.alias("state"))


def seed_summary(folds: DataFrame, arm: Sequence[str], seed: str, fold: str, metric: str, value: str) -> DataFrame:
    """Per-seed fold means, then mean, sample SD and n over seeds for every metric."""
    per_seed = folds.groupBy(*arm, seed, metric).agg(F.avg(f64(value)).alias("m"), F.count_distinct(fold).alias("f"))
    return per_seed.groupBy(*arm, metric).agg(
        F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count(F.lit(1)).alias("n"), F.min("f").alias("min_folds"),
    )


def arm_summary(cells: DataFrame, keys: Sequence[str], metrics: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """Mean and population SD of each metric plus counts of true flags."""
    return cells.groupBy(*keys).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics],
        *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags],
        F.count(F.lit(1)).alias("n"),
    )


def ceiling_gap(cells: DataFrame, arm: Sequence[str], value: str, ceiling: float) -> DataFrame:
    """Mean per arm, population SD and distance to a reference constant."""
    out = cells.groupBy(*arm).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n")
    )
    return out.withColumn("gap", F.lit(float(ceiling)) - F.col("mean"))


def cost_summary(runs: DataFrame, keys: Sequence[str], timing: str, peak: str, flops: str | None = None) -> DataFrame:
    """Quartiles and range of a timing, number of distinct peaks, derived work rate."""
    aggs = [F.min(timing).alias("min"), F.max(timing).alias("max"), F.count_distinct(peak).alias("distinct_peaks")]
    if flops:
        aggs.append((F.sum(f64(flops)) / F.sum(f64(timing))).alias("flops_per_second"))
    quartiles = quantiles(runs, keys, timing, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    out = runs.groupBy(*keys).agg(*aggs)
    return out.join(quartiles, list(keys)) if keys else with_summary(out, quartiles)
