"""Running totals and dense row numbers over groups that do not fit one task.

A window ordered over a whole group sends that group to one task. Here the order is cut into
monotone buckets: rows are accumulated inside (group, bucket), bucket totals are accumulated on
their own small table, and the two are added. Buckets come from the data values alone, so a
recomputed stage reproduces them exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_text
from ..session import cut_lineage


def with_summary(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of an ungrouped aggregate to every row.

    A scalar subquery: the aggregate is evaluated once, must have exactly one row, and reaches the
    tasks as a constant, so no join is involved.
    """
    names = one_row.columns
    if len(names) == 1:
        return df.withColumn(names[0], one_row.scalar())
    packed = df.withColumn("_summary", one_row.select(F.struct(*names)).scalar())
    return packed.select(*df.columns, *[F.col("_summary")[n].alias(n) for n in names])


#: Rows of a statistics table up to which it may be broadcast.
SMALL_ROWS = 20_000


def with_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], small_rows: int | None = None) -> DataFrame:
    """Attach the row of `stats` with the same keys, nulls included, to every row of a much larger table.

    `stats` has one row per key. It is written once and counted: up to `small_rows` (else `SMALL_ROWS`)
    rows it is broadcast, so a few hot keys do not gather the large table; more keys than that spread by
    themselves. Statistics with wide rows state a lower bound.
    """
    names = [f"_on{i}" for i in range(len(keys))]
    other = [c for c in stats.columns if c not in keys]
    kept = cut_lineage(stats.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *other))
    small = F.broadcast(kept) if kept.count() <= (SMALL_ROWS if small_rows is None else small_rows) else kept
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return df.join(small, same).drop(*names)


_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(fold: str, a: Column, b: Column) -> Column:
    """Combine two partial results; either may be null when it covers no rows."""
    if fold == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if fold == "max" else F.least(a, b)


def _offsets(totals: DataFrame, keys: list[str], levels: list[str], folds: dict[str, str]) -> DataFrame:
    """Exclusive prefix of every bucket path and the result of the whole group, one level at a time from the outermost."""
    outer = levels[:-1]
    order = Window.partitionBy(*keys, *outer) if keys or outer else Window.partitionBy(F.lit(0))
    before = order.orderBy(levels[-1]).rowsBetween(Window.unboundedPreceding, -1)
    prefix = [_FOLDS[f](s).over(before).alias(f"_before_{s}") for s, f in folds.items()]
    if not outer:
        group = Window.partitionBy(*(keys or [F.lit(0)]))
        return totals.select(*keys, *levels, *prefix, *[_FOLDS[f](s).over(group).alias(f"_all_{s}") for s, f in folds.items()])
    local = totals.select(*keys, *levels, *prefix)
    upper = _offsets(
        totals.groupBy(*keys, *outer).agg(*[_FOLDS[f](s).alias(s) for s, f in folds.items()]), keys, outer, folds
    ).withColumnsRenamed({f"_before_{s}": f"_upper_{s}" for s in folds})
    return local.join(upper, [*keys, *outer]).select(
        *keys, *levels,
        *[_merge(f, F.col(f"_before_{s}"), F.col(f"_upper_{s}")).alias(f"_before_{s}") for s, f in folds.items()],
        *[f"_all_{s}" for s in folds],
    )


def running_folds(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[Column | str],
    order: Sequence[Column],
    folds: dict[str, str],
    prefix: str = "cum_",
    whole: bool = False,
    keep_buckets: bool = False,
) -> DataFrame:
    """Add the inclusive running sum, max or min `cum_<column>` of each column, per key group in `order`.

    `folds` maps column to 'sum', 'max' or 'min'; with `whole`, `all_<column>` is the result of the
    whole group, which the bucket totals give for nothing. `buckets` are expressions that never decrease along
    `order`, coarsest first. `order` must be unique inside a group, or the results of tied rows are
    arbitrary. A null key or bucket has no place in the order and stops the job; no row is dropped.

    With `keep_buckets` the buckets stay as columns `_bucket0`, ...; a later fold over the same rows and keys that
    names them as its `buckets` finds its rows where they are and needs no exchange of them.
    """
    keys = list(keys)
    named = all(isinstance(b, str) for b in buckets)
    levels = list(buckets) if named else [f"_bucket{i}" for i in range(len(buckets))]
    cut = df
    if not named:
        cut = cut.withColumns(dict(zip(levels, buckets)))
        refuse = lambda name: F.when(F.col(name).isNull(), F.raise_error(F.lit(f"null in {name}: rows without a key or an order value can not be accumulated"))).otherwise(F.col(name))
        cut = cut.withColumns({name: refuse(name) for name in (*keys, *levels)})
    # stated once here, the null filters that the joins imply are the same in every branch, so the
    # branches share one exchange of the rows instead of recomputing them; nulls never get this far
    for name in (*keys, *levels):
        cut = cut.where(F.col(name).isNotNull())
    totals = cut.groupBy(*keys, *levels).agg(*[_FOLDS[f](s).alias(s) for s, f in folds.items()])
    inside = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"{prefix}{s}": _FOLDS[f](s).over(inside) for s, f in folds.items()})
    joined = local.join(_offsets(totals, keys, levels, folds), [*keys, *levels])
    kept = [c for c in df.columns if keep_buckets or c not in levels] + ([c for c in levels if c not in df.columns] if keep_buckets else [])
    return joined.select(
        *kept,
        *[_merge(f, F.col(f"{prefix}{s}"), F.col(f"_before_{s}")).alias(f"{prefix}{s}") for s, f in folds.items()],
        *([F.col(f"_all_{s}").alias(f"all_{s}") for s in folds] if whole else []),
    )


def running_totals(
    df: DataFrame, keys: Sequence[str], buckets: Sequence[Column], order: Sequence[Column], sums: Sequence[str],
    prefix: str = "cum_",
) -> DataFrame:
    """`running_folds` with sums only."""
    return running_folds(df, keys, buckets, order, dict.fromkeys(sums, "sum"), prefix)


def score_buckets(score: Column) -> list[Column]:
    """Buckets of a score in [0, 1], rising as the score falls.

    2^20 equal slices in the middle and logarithmic ones within 2^-12 of either end, where the
    scores of a confident classifier pile up. The totals of one group stay below 1.6 million rows
    however many scores it has.
    """
    edge, tiny = 2.0**-12, 1e-300
    below = F.lit(1.0) - score
    depth = lambda x: F.floor(-F.log2(F.greatest(x, F.lit(tiny))) * F.lit(256.0))
    slices = F.floor(below * F.lit(float(2**20)))
    near_one = F.lit(-1) - depth(below)
    near_zero = F.lit(2**20 + 1) + depth(score)
    return [F.when(below < edge, near_one).when(score < edge, near_zero).otherwise(slices).cast("bigint")]


def value_buckets(value: Column) -> list[Column]:
    """Monotone two-level buckets of any finite double: sign, binary exponent and mantissa bits.

    The coarse level keeps 12 mantissa bits (a column spanning 2^40 has at most 330 thousand coarse
    buckets), the fine one 12 more, so values crowded around a large number still separate.
    """
    size = F.greatest(F.abs(value), F.lit(1e-300))
    exponent = F.floor(F.log2(size))
    mantissa = size / F.pow(F.lit(2.0), exponent) - F.lit(1.0)
    magnitude = (exponent + 1100) * (1 << 24) + F.floor(mantissa * F.lit(float(1 << 24)))
    fine = F.when(value < 0, -magnitude).when(value == 0, F.lit(0)).otherwise(magnitude).cast("bigint")
    return [F.shiftright(fine, 12), fine]


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per entry of `points`; adds the count `n`.

    Only finite values count: nulls, NaN and infinities are left out of the quantiles and of `n`, and a key without a finite
    value has no row. `left_out` counts them.

    The built-in exact percentile keeps all distinct values of a group in one buffer. Here they stay
    rows: counts per distinct value are accumulated across buckets and the bracketing ranks are
    picked by an aggregate.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    counts = df.where(finite).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running_totals(counts, keys, value_buckets(F.col("_v")), [F.col("_v")], ["_n"], prefix="_cum")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    rows = cum.join(sizes, keys) if keys else with_summary(cum, sizes)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum_n") - F.col("_n") <= rank) & (rank < F.col("_cum_n")), F.col("_v")))

    aggs = []
    for name, q in points.items():
        position = F.lit(float(q)) * (F.col("n") - 1)
        aggs += [at(F.floor(position)).alias(f"_lo_{name}"), at(F.ceil(position)).alias(f"_hi_{name}")]
    out = rows.groupBy(*keys, "n").agg(*aggs)
    cols = []
    for name, q in points.items():
        part = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (part - F.floor(part))).alias(name))
    return out.select(*keys, *cols, "n")


def left_out(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key, the rows that `quantiles` and `approx_quantiles` leave out and those that they take."""
    v = F.col(value).cast("double")
    finite = F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False))
    return df.groupBy(*keys).agg(F.count_if(~finite).alias("n_left_out"), F.count_if(finite).alias("n"))


def approx_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float], k: int = 800) -> DataFrame:
    """Approximate quantiles per key from mergeable sketches: one pass, one exchange of a few kilobytes per task and key.

    A KLL sketch keeps about 3k values whatever the size of the group. The value given for a point is one of the
    group's, and its rank is off by at most about 2.3 / k^0.9 of the group (0.6 % at k = 800) with 99 % confidence; it is not
    interpolated. Which values a sketch keeps is random, so results may differ from run to run. For exact results use
    `quantiles`. Null and values that are not finite are left out, see `left_out`; adds the count `n`.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    finite = df.where(F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False)))
    sketches = finite.groupBy(*keys).agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("_sketch"), F.count(F.lit(1)).alias("n"))
    if not keys:
        sketches = sketches.where("n > 0")
    return sketches.select(*keys, *[F.kll_sketch_get_quantile_double("_sketch", F.lit(float(q))).alias(name) for name, q in points.items()], "n")


def number_rows(
    df: DataFrame, keys: Sequence[str], buckets: Sequence[Column], order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """Dense 1-based row number per key group, without a one-task window."""
    counted = running_totals(df.withColumn("_one", F.lit(1)), keys, buckets, order, ["_one"], prefix="_cum")
    return counted.withColumnRenamed("_cum_one", name).drop("_one")


def number_by_id(df: DataFrame, keys: Sequence[str], id_col: str, width: int = 1 << 18, name: str = "rn") -> DataFrame:
    """Row number in the order of a unique integer id; a bucket holds at most `width` ids.

    Ids may be dense or spread over all 64-bit values: each level groups 2^15 buckets of the next, so
    no window over bucket totals exceeds that, and the outermost has at most 2^16 at the default width.
    """
    fine = F.floor(F.col(id_col) / F.lit(width)).cast("bigint")
    levels = [F.shiftright(fine, 30), F.shiftright(fine, 15), fine]
    return number_rows(df, keys, levels, [F.col(id_col)], name)


def number_by_hash(df: DataFrame, keys: Sequence[str], seed: int, id_col: str, name: str = "rn") -> DataFrame:
    """Row number in a pseudo-random order fixed by `seed` and the id."""
    hashed = df.withColumn("_hash", hash_text(seed, id_col))
    buckets = [F.substring("_hash", 1, 3), F.substring("_hash", 1, 5)]
    return number_rows(hashed, keys, buckets, [F.col("_hash"), F.col(id_col)], name).drop("_hash")
