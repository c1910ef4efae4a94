"""Deterministic folds, samples and draws. All randomness is a hash of a seed and a row id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import f64, hash_index, hash_text, hash_uniform, total
from .running import number_by_hash, number_by_id, quantiles, with_group_stats, with_summary


#: Rows of one class that a task may rank. Up to it every task keeps only its own first rows of a class
#: before the exchange; beyond it rows are numbered across buckets. Both give the same rows.
TASK_QUOTA = 10_000


def stratified_kfold(df: DataFrame, strata: Sequence[str], label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold in which each row is tested, stratified by label inside each stratum.

    Rows are dealt to folds in hash order. Each class starts where the classes before it stopped, so
    fold totals differ by at most one and so do class counts, as in the usual stratified k-fold.
    """
    strata = list(strata)
    ranked = number_by_hash(df, [*strata, label], seed, id_col, "_rn")
    sizes = df.groupBy(*strata, label).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(strata or [F.lit(0)])).orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    # one row per class: the offset table is tiny whatever the number of rows
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = with_group_stats(ranked, offsets, [*strata, label])
    return joined.withColumn("fold", ((F.col("_rn") - 1 + F.col("_off")) % k).cast("int")).drop("_rn", "_off")


def expand_folds(assigned: DataFrame, k: int = 5) -> DataFrame:
    """One row per (row, fold) with split = test in its own fold and train in the others."""
    own = F.col("fold")
    return (
        assigned.withColumn("_own", own)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("split", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train"))
        .drop("_own")
    )


def split_manifest(splits: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Class counts per (domain, fold, split), with subtotals per (domain, fold), domain and overall."""
    counts = [F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes]
    return splits.rollup("domain", "fold", "split").agg(*counts, F.count(F.lit(1)).alias("total"))


def leak_check(splits: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Ids that occur in both train and test of one fold."""
    per = splits.groupBy(*keys, id_col).agg(F.count_distinct("split").alias("n_splits"))
    return per.where(F.col("n_splits") > 1)


def fold_coverage_check(splits: DataFrame, keys: Sequence[str], id_col: str, k: int) -> DataFrame:
    """Ids not tested exactly once, or not present exactly once in every fold."""
    per = splits.groupBy(*keys, id_col).agg(
        F.count_if(F.col("split") == "test").alias("n_test"), F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("fold").alias("n_folds"),
    )
    rule = F.when(F.col("n_test") != 1, "not_tested_once").when(
        (F.col("n_rows") != k) | (F.col("n_folds") != k), "not_in_every_fold"
    )
    return per.withColumn("rule", rule).where("rule is not null")


def canonicalize(df: DataFrame, path: str) -> DataFrame:
    """Distinct paths in lexicographic byte order."""
    return df.select(path).distinct().orderBy(path)


def fixed_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows in hash order, without looking at any class; `position` is the draw order.

    Each task keeps its own n first rows, so the merge sees n rows per task.
    """
    hashed = df.withColumn("draw_hash", hash_text(seed, id_col))
    return hashed.orderBy("draw_hash", id_col).limit(n)


def per_class_sample(df: DataFrame, label: str, id_col: str, quotas: dict, seed: int) -> DataFrame:
    """Fixed number of rows per class by hash rank; `order_hash` shuffles the result."""
    quota: Column = F.lit(0)
    for value, n in quotas.items():
        quota = F.when(F.col(label) == value, n).otherwise(quota)
    most = max(quotas.values(), default=0)
    if most <= TASK_QUOTA:
        first = Window.partitionBy(label).orderBy("_hash", id_col)
        ranked = df.withColumn("_hash", hash_text(seed, id_col)).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= most).drop("_hash")
    else:
        ranked = number_by_hash(df, [label], seed, id_col)
    return ranked.where(F.col("rn") <= quota).withColumn("order_hash", hash_text(seed + 1, id_col))


def per_class_head(df: DataFrame, label: str, id_col: str, n: int) -> DataFrame:
    """The first n ids of every class, by integer id."""
    if n > TASK_QUOTA:
        return number_by_id(df, [label], id_col).where(F.col("rn") <= n).drop("rn")
    first = Window.partitionBy(label).orderBy(id_col)
    return df.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= n).drop("rn")


def truncate(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n rows in a fixed order (a distributed top-n)."""
    return df.orderBy(*order).limit(n)


def round_robin_assign(rows: DataFrame, row_id: str, bank: DataFrame, bank_id: str) -> DataFrame:
    """Row i (by id order) takes bank entry i mod n; both sides are numbered without a one-task sort."""
    left = number_by_id(rows, [], row_id, name="_i").withColumn("_i", F.col("_i") - 1)
    right = number_by_id(bank, [], bank_id, name="_slot").withColumn("_slot", F.col("_slot") - 1)
    size = bank.agg(F.count(F.lit(1)).alias("_n"))
    keyed = with_summary(left, size).withColumn("_slot", F.col("_i") % F.col("_n")).drop("_i", "_n")
    return keyed.join(right, "_slot").drop("_slot")


def band_filter_pool(pool: DataFrame, mean: str, lo: str | float = "p5", clamp: float | None = None) -> DataFrame:
    """Keep pool rows with mean in [lo, p95]; lo is the 5th percentile, its clamp, or a fixed value."""
    edges = quantiles(pool, [], mean, {"_p5": 0.05, "p95": 0.95}).drop("n")
    low: Column = F.col("_p5") if lo == "p5" else F.lit(float(lo))
    if lo == "p5" and clamp is not None:
        low = F.greatest(low, F.lit(float(clamp)))
    banded = with_summary(pool, edges).withColumn("lo", low)
    return banded.where(F.col(mean).between(F.col("lo"), F.col("p95"))).drop("_p5")


def draw_pairs(rows: DataFrame, row_id: str, pool: DataFrame, pool_id: str, seed: int) -> DataFrame:
    """One hashed index per row picks a pool entry, so paired pool columns stay together."""
    slots = number_by_id(pool, [], pool_id, name="_slot").withColumn("_slot", F.col("_slot") - 1)
    size = pool.agg(F.count(F.lit(1)).alias("_n"))
    drawn = with_summary(rows, size).withColumn("_slot", hash_index("_n", seed, row_id)).drop("_n")
    return drawn.join(slots, "_slot").drop("_slot")


def perturb(df: DataFrame, id_col: str, columns: Sequence[str], lo: float = 0.9, hi: float = 1.1, seed: int = 42) -> DataFrame:
    """Multiply columns by independent uniform factors in [lo, hi)."""
    factor = lambda c: F.lit(lo) + F.lit(hi - lo) * hash_uniform(seed, id_col, F.lit(c))
    return df.withColumns({c: f64(c) * factor(c) for c in columns})


def pick_clean_candidate(
    draws: DataFrame, keys: Sequence[str], draw: str, fraction: str, limit: float = 0.10, max_draws: int = 30
) -> DataFrame:
    """First candidate at or below the zero-fraction limit, else the cleanest of the first draws.

    Draw 0 is the original; `redraws` is how many further candidates were looked at.
    """
    considered = draws.where(F.col(draw) <= max_draws)
    clean = F.col(fraction) <= limit
    rank = F.struct(
        F.when(clean, 0).otherwise(1).alias("dirty"),
        F.when(clean, F.lit(0.0)).otherwise(f64(fraction)).alias("f"),
        F.col(draw).alias("d"),
    )
    best = considered.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(draw).alias("draw"), f64(fraction).alias("fraction"), clean.alias("clean")), rank).alias("b"),
        F.max(draw).alias("_last"),
    )
    return best.select(
        *keys, F.col("b.draw").alias("draw"), F.col("b.fraction").alias("fraction"), F.col("b.clean").alias("clean"),
        F.when(F.col("b.clean"), F.col("b.draw")).otherwise(F.col("_last")).alias("redraws"),
    )


def weighted_draw(df: DataFrame, id_col: str, weights: dict[str, float], seed: int, name: str = "category") -> DataFrame:
    """Categorical draw by cumulative weights, in the given order."""
    scale = sum(weights.values())
    u = hash_uniform(seed, id_col)
    out: Column = F.lit(list(weights)[-1])
    acc = scale
    for label in reversed(list(weights)):
        acc -= weights[label]
        out = F.when(u < F.lit((acc + weights[label]) / scale), label).otherwise(out)
    return df.withColumn(name, out)


def share_audit(df: DataFrame, category: str, weights: dict[str, float]) -> DataFrame:
    """Observed share of each category against its weight."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    size = counts.agg(F.sum("n").alias("_t"))
    scale = sum(weights.values())
    target: Column = F.lit(0.0)
    for label, w in weights.items():
        target = F.when(F.col(category) == label, w / scale).otherwise(target)
    return with_summary(counts, size).select(category, "n", (F.col("n") / F.col("_t")).alias("share"), target.alias("target_share"))


def unimodal_check(df: DataFrame, keys: Sequence[str], pos: str, value: str, tol: float = 0.02) -> DataFrame:
    """Violations of rise-then-fall per profile: the profile must climb to its first maximum and fall after it."""
    peak = df.groupBy(*keys).agg(F.min_by(pos, F.struct((-f64(value)).alias("v"), F.col(pos).alias("p"))).alias("peak"))
    along = Window.partitionBy(*keys).orderBy(pos)
    step = df.withColumn("_d", f64(value) - F.lag(f64(value)).over(along)).join(peak, list(keys))
    bad = F.when(F.col(pos) <= F.col("peak"), F.col("_d") < -tol).otherwise(F.col("_d") > tol)
    return step.groupBy(*keys).agg(F.first("peak").alias("peak"), F.count_if(bad).alias("violations"))


def representative_sample(df: DataFrame, strata: Sequence[str], tag: str, n: int) -> DataFrame:
    """One row per stratum in key order, then the remaining rows by tag, n in total.

    Rows tied on a stratum's smallest tag are told apart by a hash of the row, copies of a row by their
    number; a missing tag comes last, and missing stratum values form strata of their own.
    """
    place = F.struct(F.col(tag).isNull().alias("none"), F.col(tag).alias("tag"), F.col("_row").alias("row"))
    hashed = df.withColumn("_row", F.xxhash64(*df.columns))
    first = hashed.groupBy(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)]).agg(F.min(place).alias("_top"))
    same: Column = F.lit(True)
    for i, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    copy = F.row_number().over(Window.partitionBy(*strata, tag, "_row").orderBy("_row"))
    ranked = hashed.withColumn("_copy", copy).join(first, same).withColumn(
        "_first", F.when((F.col("_copy") == 1) & place.eqNullSafe(F.col("_top")), 0).otherwise(1))
    order = [F.col("_first"), *[F.when(F.col("_first") == 0, F.col(s)) for s in strata], F.col(tag).asc_nulls_last(), F.col("_row")]
    return ranked.orderBy(*order).limit(n).select(*df.columns)


def merge_verified(a: DataFrame, b: DataFrame, id_col: str, digest: str, copies: Sequence[DataFrame] = ()) -> DataFrame:
    """Append the rows of `a` to `b`: same columns, and equal digests at every copy, or the job stops."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    checked = a
    for i, copy in enumerate(copies):
        side = copy.select(id_col, F.col(digest).alias(f"_copy{i}"))
        joined = checked.join(side, id_col, "left")
        same = F.col(digest).eqNullSafe(F.col(f"_copy{i}"))
        checked = joined.withColumn(
            digest, F.when(same, F.col(digest)).otherwise(F.raise_error(F.concat(F.lit("copy differs for "), F.col(id_col).cast("string"))))
        ).drop(f"_copy{i}")
    return checked.select(*a.columns).unionByName(b)


def partition_of(a: DataFrame, b: DataFrame, universe: DataFrame, id_col: str) -> DataFrame:
    """Violations of 'a and b are disjoint and together are the universe'."""
    tagged = (
        a.select(id_col, F.lit("a").alias("t")).unionByName(b.select(id_col, F.lit("b").alias("t")))
        .unionByName(universe.select(id_col, F.lit("u").alias("t")))
    )
    per = tagged.groupBy(id_col).agg(*[F.count_if(F.col("t") == t).alias(f"n_{t}") for t in "abu"])
    covered = total([F.col("n_a"), F.col("n_b")])
    rule = (
        F.when(F.col("n_u") == 0, "outside_universe")
        .when((F.col("n_a") > 0) & (F.col("n_b") > 0), "in_both")
        .when(covered == 0, "uncovered")
        .when((F.col("n_a") > 1) | (F.col("n_b") > 1), "repeated")
    )
    return per.select(id_col, rule.alias("rule")).where("rule is not null")


def reindex(df: DataFrame, id_col: str, name: str = "index") -> DataFrame:
    """New index 0..n-1 in id order after filtering."""
    return number_by_id(df, [], id_col, name="_rn").withColumn(name, F.col("_rn") - 1).drop("_rn")


