"""Distribution shift between a source and a target domain."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import argmax, f64, hash_text, is_finite
from ..session import cut_lineage
from .ranking import roc_auc
from .running import number_by_hash, with_group_stats, with_summary
from .vectors import logistic_fit_columns, logistic_fits, masked_logistic_fits, moments

PROBS = ("p0", "p1")


def validate_features(df: DataFrame, keys: Sequence[str], features: str, min_rows: int = 1) -> DataFrame:
    """Violations of the feature contract: null or non-finite rows, unequal width, too few rows per key."""
    bad = F.col(features).isNull() | (F.size(features) == 0) | ~F.forall(features, is_finite)
    agg = df.groupBy(*keys).agg(
        F.count_if(F.coalesce(bad, F.lit(True))).alias("nonfinite_rows"),
        F.min(F.size(features)).alias("min_width"),
        F.max(F.size(features)).alias("max_width"),
        F.count(F.lit(1)).alias("n"),
    )
    width = agg.agg(F.max("max_width").alias("_width"))
    joined = with_summary(agg, width)
    rules = F.array_compact(F.array(
        F.when(F.col("nonfinite_rows") > 0, "nonfinite_rows"),
        F.when((F.col("min_width") != F.col("_width")) | (F.col("max_width") != F.col("_width")), "unequal_width"),
        F.when(F.col("n") < min_rows, "too_few_rows"),
    ))
    return joined.withColumn("rule", F.explode(rules)).select(*keys, "rule", "nonfinite_rows", "min_width", "max_width", "n")


def coral_distance(df: DataFrame, domain: str, features: str, source: str = "source", target: str = "target") -> DataFrame:
    """Covariance distance sum((CovS-CovT)^2)/(4 D^2) with sample covariances, and the L2 mean gap."""
    m = moments(df.where(F.col(domain).isin(source, target)), [domain], features)
    side = lambda name, tag: F.max_by(F.struct("n", "mean", "scatter"), F.when(F.col(domain) == name, 1)).alias(tag)
    both = m.agg(side(source, "s"), side(target, "t"))
    cov = lambda t: F.transform(F.col(f"{t}.scatter"), lambda v: v / (F.col(f"{t}.n") - F.lit(1.0)))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
    d = F.size("s.mean")
    return both.select(
        (square(cov("s"), cov("t")) / (F.lit(4.0) * d * d)).alias("coral_distance"),
        F.sqrt(square(F.col("s.mean"), F.col("t.mean"))).alias("mean_difference_l2"),
        d.alias("feature_dimension"),
    )


def branch_divergence(df: DataFrame, domain: str, features: str, source: str = "source", target: str = "target") -> DataFrame:
    """L2 norm of the difference of the two domains' mean features."""
    means = domain_means(df, domain, features)
    diff = F.max(F.when(F.col(domain) == source, F.col("mean"))) - F.max(F.when(F.col(domain) == target, F.col("mean")))
    return means.groupBy("pos").agg(diff.alias("d")).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("divergence"))


def domain_means(df: DataFrame, domain: str, features: str) -> DataFrame:
    """Long (domain, pos, mean, var, n): population moments of every feature.

    A task sends one vector of sums per domain; rows are never multiplied by their features. Squares
    are taken around the task's own mean, so only differences between task means can cancel.
    """
    slim = df.select(domain, F.col(features).cast("array<double>").alias("f"))
    kind = slim.schema[domain].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for pdf in batches:
            for key, rows in pdf.groupby(domain, sort=False):
                x = np.stack(rows["f"].to_numpy()).astype(np.float64)
                n, mean, square = len(x), x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)
                if key in state:
                    m, other, before = state[key]
                    gap = mean - other
                    square, mean, n = before + square + gap * gap * (m * n / (m + n)), other + gap * (n / (m + n)), m + n
                state[key] = (n, mean, square)
        if state:
            yield pd.DataFrame([{domain: k, "n": n, "mean": mean, "square": square} for k, (n, mean, square) in state.items()])

    parts = slim.where(F.col(domain).isNotNull()).mapInPandas(partial, f"`{domain}` {kind}, n bigint, mean array<double>, square array<double>")
    # one row per task, domain and feature from here on, in one exchange
    long = parts.select(domain, "n", F.posexplode(F.arrays_zip("mean", "square")).alias("pos", "s"))
    whole = Window.partitionBy(domain, "pos")
    centred = long.withColumn("_mean", F.sum(F.col("n") * F.col("s.mean")).over(whole) / F.sum("n").over(whole))
    gap = F.col("s.mean") - F.col("_mean")
    return centred.groupBy(domain, "pos").agg(
        F.first("_mean").alias("mean"), (F.sum(F.col("s.square") + F.col("n") * gap * gap) / F.sum("n")).alias("var"), F.sum("n").alias("n"))


def domain_standardize(
    df: DataFrame, domain: str, features: str, mode: str = "target", source: str = "source", target: str = "target",
    eps: float = 1e-5,
) -> DataFrame:
    """Standardise features with re-estimated statistics.

    target      every row with target-domain statistics
    frozen      every row with source-domain statistics
    per_domain  every row with the statistics of its own domain

    Statistics come from rows with a domain; with per_domain a row without one stops the job, no row is lost.
    """
    if mode == "per_domain":
        missing = F.raise_error(F.lit("a row without a domain has no statistics"))
        df = df.withColumn(domain, F.when(F.col(domain).isNull(), missing).otherwise(F.col(domain)))
    stats = domain_means(df, domain, features)
    packed = stats.groupBy(domain).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean", "var"))), lambda s: F.struct(s["mean"], s["var"])).alias("_stats")
    )
    if mode == "per_domain":
        joined = with_group_stats(df, packed, [domain], small_rows=256)  # a row holds two values per feature
    elif mode in ("target", "frozen"):
        chosen = packed.where(F.col(domain) == (target if mode == "target" else source)).select("_stats")
        joined = with_summary(df, chosen)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    scaled = F.zip_with(
        F.col(features).cast("array<double>"), F.col("_stats"), lambda x, s: (x - s["mean"]) / F.sqrt(s["var"] + F.lit(eps))
    )
    return joined.withColumn(features, scaled).drop("_stats")


# --- maximum mean discrepancy ----------------------------------------------------------------


#: Rows of a tile, and of the sub-blocks that a task compares at a time.
TILE_ROWS, SUB_ROWS = 16384, 512
#: Rows drawn to guess where the median lies, slots of a histogram of distances, distances that may be picked from one by one.
PILOT_ROWS, SLOTS, PICKED = 512, 1 << 14, 1 << 17


def _block_pairs(df: DataFrame, id_col: str, domain: str, features: str, source: str, block_rows: int) -> DataFrame:
    """Rows keyed by unordered tile pair (lo, hi), dealt by it; a pair holds about two tiles of rows. The rows are written once.

    Tiles are hash-assigned, so their size does not depend on the data. No pair of rows is emitted. A row
    is copied once per tile, so tiles are large; a small input has enough of them for eight pairs a core, as
    pairs are dealt by hash and unevenly.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-n // block_rows), min(-(-n // 256), int(np.ceil(np.sqrt(16 * cores)))), 1)
    own = F.conv(F.substring(hash_text(0, id_col), 1, 8), 16, 10).cast("bigint") % blocks
    rows = cut_lineage(df.select(
        own.cast("int").alias("own"), (F.col(domain) == source).cast("int").alias("src"),
        F.col(features).cast("array<double>").alias("f"),
    ))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = other.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "src", "f")
    # an explicit count, as partitions small in bytes are much work here and shall not be joined
    return tiles.repartition(max(cores, blocks * (blocks + 1) // 2), "lo", "hi")


def _distances(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Squared distances between sub-blocks of the two tiles of a pair, and the source flags of both sides.

    Sub-blocks of a tile with itself come once per unordered pair; the last field marks those on the diagonal.
    """
    same = bool(pdf["lo"].iloc[0] == pdf["hi"].iloc[0])
    left = pdf[pdf["own"] == pdf["lo"]]
    right = left if same else pdf[pdf["own"] == pdf["hi"]]
    if len(left) == 0 or len(right) == 0:
        return
    a, b = np.stack(left["f"].to_numpy()), np.stack(right["f"].to_numpy())
    u, v = left["src"].to_numpy(), right["src"].to_numpy()
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    # one matrix product gives the squared distances: (a, |a|^2, 1) times (-2 b, 1, |b|^2)
    one_a, one_b = np.ones((len(a), 1)), np.ones((len(b), 1))
    p, q = np.hstack((a, aa[:, None], one_a)), np.hstack((-2.0 * b, one_b, bb[:, None])).T.copy()
    close = 1e-9 * (aa.max() + bb.max())
    for i in range(0, len(a), SUB_ROWS):
        for j in range(i if same else 0, len(b), SUB_ROWS):
            x, y = slice(i, i + SUB_ROWS), slice(j, j + SUB_ROWS)
            sq = p[x] @ q[:, y]
            near = np.flatnonzero(sq <= close)
            for k in range(0, len(near), 1 << 13):  # the product cancels there, and equal rows have no distance
                r, c = np.divmod(near[k : k + (1 << 13)], sq.shape[1])
                sq[r, c] = ((a[i + r] - b[j + c]) ** 2).sum(1)
            yield sq, u[x], v[y], same and i == j


_INFINITE = int(np.array(np.inf).view(np.int64))


def _distance_bits(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    """Bit patterns of the squared distances, each pair of rows once; positive numbers sort like theirs."""
    for sq, _, _, same in _distances(pdf):
        yield (sq[np.triu_indices(sq.shape[0], 1)] if same else sq.ravel()).view(np.int64)


def _span_counts(spans: list[tuple[int, int]], outside: bool):
    """Histograms of the distances inside spans of bit patterns; span -1 has the counts of all, and of those below the first one."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        found, total, below = [np.zeros(SLOTS, np.int64) for _ in spans], 0, 0
        for bits in _distance_bits(pdf):
            if outside:
                total += np.count_nonzero((bits > 0) & (bits <= _INFINITE))
                below += np.count_nonzero((bits > 0) & (bits < spans[0][0]))
            for slots, (low, high) in zip(found, spans):
                slots += np.bincount((bits[(bits >= low) & (bits < high)] - low) // -(-(high - low) // SLOTS), minlength=SLOTS)
        span, slot = np.nonzero(np.stack(found))
        rows = pd.DataFrame({"span": span, "slot": slot, "n": np.stack(found)[span, slot]})
        return pd.concat([rows, pd.DataFrame({"span": [-1, -1], "slot": [0, 1], "n": [total, below]})]) if outside else rows

    return count


def _span_values(spans: list[tuple[int, int]]):
    """The distances inside spans of bit patterns, with the number of each."""

    def values(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [bits[(bits >= low) & (bits < high)] for bits in _distance_bits(pdf) for low, high in spans]
        bits, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
        return pd.DataFrame({"bits": bits, "n": n}).astype("int64")

    return values


def median_distance(df: DataFrame, id_col: str, domain: str, features: str, source: str = "source", block_rows: int = TILE_ROWS) -> float:
    """Exact median of the positive pairwise Euclidean distances of the pooled rows.

    Positive doubles sort like their bit patterns. A pass over all pairs counts them in slots of the span in which a few
    drawn rows have their middle distances, and the next one picks the middle values from their slot. Where the
    span misses them or a slot holds too many, another pass narrows it first; no list of all distances exists anywhere.
    """
    return _median_of(_block_pairs(df, id_col, domain, features, source, block_rows), _pilot_span(df, id_col, features))


def _pilot_span(df: DataFrame, id_col: str, features: str) -> tuple[int, int]:
    """Bit patterns between which the median probably lies, from at most `PILOT_ROWS` rows."""
    drawn = df.select(F.col(features).cast("array<double>").alias("f"), F.xxhash64(id_col).alias("h")).orderBy("h").limit(PILOT_ROWS).collect()
    x = np.array([r["f"] for r in drawn], dtype=float)
    i, j = np.triu_indices(len(x), 1)
    sq = np.concatenate([((x[i[k : k + 4096]] - x[j[k : k + 4096]]) ** 2).sum(1) for k in range(0, len(i), 4096)]) if len(i) else np.zeros(0)
    sq = sq[np.isfinite(sq) & (sq > 0)]
    if not len(sq):
        return 1, _INFINITE + 1
    low, high = (int(b) for b in np.quantile(sq, [0.45, 0.55], method="nearest").view(np.int64))
    return low, high + 1


def _median_of(pairs: DataFrame, span: tuple[int, int]) -> float:
    def counted(spans: list[tuple[int, int]], outside: bool) -> dict[int, dict[int, int]]:
        # at most one row per slot and wanted span reaches the driver
        rows = pairs.groupBy("lo", "hi").applyInPandas(_span_counts(spans, outside), "span bigint, slot bigint, n bigint").groupBy("span", "slot").agg(F.sum("n").alias("n"))
        out: dict[int, dict[int, int]] = {i: {} for i in range(-1, len(spans))}
        for r in rows.collect():
            out[r["span"]][r["slot"]] = r["n"]
        return out

    def narrowed(low: int, high: int, rank: int, slots: dict[int, int]) -> tuple[int, int, int, int]:
        step = -(-(high - low) // SLOTS)
        for slot in sorted(slots):
            if rank < slots[slot]:
                return low + slot * step, min(low + (slot + 1) * step, high), rank, slots[slot]
            rank -= slots[slot]
        raise AssertionError("rank outside the span")

    hist = counted([span], True)
    total, below, inside = hist[-1].get(0, 0), hist[-1].get(1, 0), sum(hist[0].values())
    if total == 0:
        raise ValueError("no bandwidth: all rows have equal features")
    targets = []  # (low, high, rank inside, distances inside) of the two middle ones
    for rank in ((total - 1) // 2, total // 2):
        if rank < below:
            targets.append((1, span[0], rank, below))
        elif rank < below + inside:
            targets.append(narrowed(*span, rank - below, hist[0]))
        else:
            targets.append((span[1], _INFINITE + 1, rank - below - inside, total - below - inside))
    while open_ := sorted({(low, high) for low, high, _, n in targets if n > PICKED and high - low > 1}):
        hist = counted(open_, False)
        targets = [narrowed(*t[:3], hist[open_.index(t[:2])]) if t[:2] in open_ else t for t in targets]
    rest = sorted({(low, high) for low, high, _, _ in targets if high - low > 1})
    values = []
    if rest:  # at most `PICKED` distances of each span
        rows = pairs.groupBy("lo", "hi").applyInPandas(_span_values(rest), "bits bigint, n bigint").groupBy("bits").agg(F.sum("n").alias("n"))
        values = sorted((r["bits"], r["n"]) for r in rows.collect())

    def picked(low: int, high: int, rank: int, _: int) -> float:
        for bits, n in ((b, n) for b, n in values if low <= b < high):
            if rank < n:
                return bits
            rank -= n
        return low

    ends = np.array([picked(*t) for t in targets], dtype=np.int64).view(np.float64)
    return float(np.sqrt(ends).sum() / 2)


def rbf_mmd2(
    df: DataFrame, id_col: str, domain: str, features: str, bandwidth: float | None = None,
    source: str = "source", block_rows: int = TILE_ROWS,
) -> DataFrame:
    """Unbiased squared MMD with an RBF kernel over all pairs of rows.

    Work is quadratic by definition. It is cut into tile pairs that each return three kernel sums;
    without `bandwidth` the exact pooled median distance is used. All passes read the same tiles. Rows without a
    domain, a third domain, less than two rows of a domain and a bandwidth that is not finite are refused.
    """
    if bandwidth is not None and not (bandwidth > 0 and math.isfinite(bandwidth)):
        raise ValueError("bandwidth must be positive and finite")
    _refuse_domains(df, domain, source, 2)
    pairs = _block_pairs(df, id_col, domain, features, source, block_rows)
    sigma = _median_of(pairs, _pilot_span(df, id_col, features)) if bandwidth is None else float(bandwidth)
    if not (sigma > 0 and math.isfinite(sigma)):
        raise ValueError("the pooled median distance is no bandwidth: it must be positive and finite")
    gamma = 1.0 / (2.0 * sigma * sigma)

    def kernel_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        ss = tt = st = 0.0
        for sq, left, right, same in _distances(pdf):
            sq *= -gamma
            k = np.exp(sq, out=sq)
            if same:
                np.fill_diagonal(k, 0.0)
            twice = 1.0 if same else 2.0
            sides = np.stack((left == 1, left != 1)).astype(float) @ k @ np.stack((right == 1, right != 1), axis=1).astype(float)
            ss += twice * sides[0, 0]
            tt += twice * sides[1, 1]
            st += sides[0, 1] if same else sides[0, 1] + sides[1, 0]
        return pd.DataFrame({"ss": [ss], "tt": [tt], "st": [st]})

    sums = pairs.groupBy("lo", "hi").applyInPandas(kernel_sums, "ss double, tt double, st double").agg(
        F.sum("ss").alias("ss"), F.sum("tt").alias("tt"), F.sum("st").alias("st")
    )
    sizes = df.agg(F.count_if(F.col(domain) == source).cast("double").alias("m"), F.count_if(F.col(domain) != source).cast("double").alias("n"))
    m, n = F.col("m"), F.col("n")
    return with_summary(sums, sizes).select(
        (F.col("ss") / (m * (m - 1)) + F.col("tt") / (n * (n - 1)) - F.lit(2.0) * F.col("st") / (m * n)).alias("mmd2"),
        F.lit(sigma).alias("bandwidth"),
        # The two names of the bandwidth's source.
        F.lit("pooled median pairwise Euclidean distance" if bandwidth is None else "explicit").alias("bandwidth_source"),
    )


def rbf_mmd2_linear(
    df: DataFrame, id_col: str, domain: str, features: str, bandwidth: float, source: str = "source", seed: int = 0
) -> DataFrame:
    """Opt-in linear-time unbiased estimate: hash-ordered rows are matched in quadruples (s, s', t, t')."""
    ranked = number_by_hash(df.select(id_col, domain, F.col(features).cast("array<double>").alias("f")), [domain], seed, id_col)
    slot = F.floor((F.col("rn") - 1) / 2).cast("bigint")
    side = F.concat(F.when(F.col(domain) == source, "s").otherwise("t"), (F.col("rn") % 2).cast("string"))
    quads = ranked.withColumns({"slot": slot, "side": side}).groupBy("slot").agg(
        *[F.max_by("f", F.when(F.col("side") == s, 1)).alias(s) for s in ("s1", "s0", "t1", "t0")]
    ).where(F.col("s0").isNotNull() & F.col("t0").isNotNull())
    g = 1.0 / (2.0 * bandwidth * bandwidth)

    def k(a: str, b: str) -> Column:
        d2 = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
        return F.exp(F.lit(-g) * d2)

    return quads.agg(
        F.avg(k("s1", "s0") + k("t1", "t0") - k("s1", "t0") - k("s0", "t1")).alias("mmd2"), F.count(F.lit(1)).alias("n_quads")
    )


# --- label shift ------------------------------------------------------------------------------


def bbse(
    df: DataFrame, domain: str, probs: Sequence[str] = PROBS, y: str = "y_true", source: str = "source",
    reference_prior: float | None = None, condition_limit: float = 1e8,
) -> DataFrame:
    """Two-class label-shift estimate from hard source confusion and soft target marginal.

    Negative weights are clipped and reported. An absent source class or an ill-conditioned
    confusion matrix stops the job.
    """
    is_s = F.col(domain) == source
    pred = argmax(probs)
    cell = lambda q, t: (F.count_if(is_s & (pred == q) & (F.col(y) == t)) / F.count_if(is_s)).alias(f"j{q}{t}")
    stats = df.agg(
        cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1),
        F.avg(F.when(~is_s, f64(probs[0]))).alias("m0"), F.avg(F.when(~is_s, f64(probs[1]))).alias("m1"),
    )
    j00, j01, j10, j11, m0, m1 = (F.col(c) for c in ("j00", "j01", "j10", "j11", "m0", "m1"))
    det = j00 * j11 - j01 * j10
    frob = j00 * j00 + j01 * j01 + j10 * j10 + j11 * j11
    top = (frob + F.sqrt(F.greatest(frob * frob - F.lit(4.0) * det * det, F.lit(0.0)))) / F.lit(2.0)
    solved = stats.withColumns({
        "prior0": j00 + j10, "prior1": j01 + j11,
        "condition_number": F.when(det != 0, top / F.abs(det)).otherwise(F.lit(float("inf"))),
        "raw_w0": F.try_divide(m0 * j11 - m1 * j01, det), "raw_w1": F.try_divide(m1 * j00 - m0 * j10, det),
    })
    problem = F.when((F.col("prior0") == 0) | (F.col("prior1") == 0), "the source has no row of one class").when(
        F.col("condition_number") > condition_limit, "ill-conditioned source confusion"
    )
    w0 = F.greatest(F.col("raw_w0"), F.lit(0.0))
    w1 = F.greatest(F.col("raw_w1"), F.lit(0.0))
    mass = w0 * F.col("prior0") + w1 * F.col("prior1")
    est = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(w0 * F.col("prior0") / mass)
    gap = F.lit(None).cast("double") if reference_prior is None else F.col("target_prior0") - F.lit(float(reference_prior))
    return solved.withColumns({
        "target_prior0": est,
        "w0": w0, "w1": w1,
        "negative_weights_clipped": (F.col("raw_w0") < 0) | (F.col("raw_w1") < 0),
    }).withColumn("prior_gap", gap)


def importance_weights(
    df: DataFrame, keys: Sequence[str], domain: str, probs: Sequence[str] = PROBS, y: str = "y_true", source: str = "source"
) -> DataFrame:
    """Two-class importance weights per key: min w'Pw/2 + q'w with w >= 0 and s.w = 1.

    P = C'C and q = -C.yhat are kept in this form; the constraint leaves one variable, so the optimum
    is a clamped quotient. Non-finite inputs give null weights and status 'skipped'.
    """
    is_s = F.col(domain) == source
    soft = lambda i, j: F.avg(F.when(is_s, f64(probs[i]) * (F.col(y) == j).cast("double"))).alias(f"c{i}{j}")
    share = lambda j: F.avg(F.when(is_s, (F.col(y) == j).cast("double"))).alias(f"s{j}")
    target = lambda i: F.avg(F.when(~is_s, f64(probs[i]))).alias(f"t{i}")
    stats = df.groupBy(*keys).agg(soft(0, 0), soft(0, 1), soft(1, 0), soft(1, 1), share(0), share(1), target(0), target(1))
    return solve_importance_weights(stats)


def solve_importance_weights(stats: DataFrame) -> DataFrame:
    """Closed form on columns c00..c11 (soft confusion), s0, s1 (source shares), t0, t1 (target marginal)."""
    c00, c01, c10, c11, s0, s1, t0, t1 = (F.col(c) for c in ("c00", "c01", "c10", "c11", "s0", "s1", "t0", "t1"))
    p00, p01, p11 = c00 * c00 + c10 * c10, c00 * c01 + c10 * c11, c01 * c01 + c11 * c11
    q0, q1 = -(c00 * t0 + c01 * t1), -(c10 * t0 + c11 * t1)
    # on the line w = (t, (1 - s0 t)/s1): direction (1, r), r = -s0/s1, start (0, 1/s1)
    r, start = -s0 / s1, F.lit(1.0) / s1
    curvature = p00 + F.lit(2.0) * r * p01 + r * r * p11
    slope = start * (p01 + r * p11) + q0 + r * q1
    free = F.when(curvature > 0, -slope / curvature).otherwise(F.when(slope < 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    w0 = F.greatest(F.lit(0.0), F.least(free, F.lit(1.0) / s0))
    ok = (s0 > 0) & (s1 > 0)
    for c in (c00, c01, c10, c11, s0, s1, t0, t1):
        ok = ok & is_finite(c)
    solved = stats.withColumn("w0", F.when(ok, w0))
    return solved.withColumns({
        "w1": F.when(ok, (F.lit(1.0) - s0 * F.col("w0")) / s1),
        "status": F.when(F.coalesce(ok, F.lit(False)), "optimal").otherwise("skipped"),
    })


#: Epochs whose maps are composed in one array, and such arrays composed in one of the next level.
EMA_FAN = 256


def ema_over_epochs(df: DataFrame, keys: Sequence[str], epoch: str, value: str, ma: float = 0.5, start: float = 1.0) -> DataFrame:
    """w <- (1-ma)*new + ma*w over epochs in order; a null epoch keeps the previous value.

    Emits one row per epoch. Every row is the affine map w -> a*w + b, and maps compose: arrays of at most
    `EMA_FAN` epochs are composed each by itself, then arrays of their results, then those of a run, one for
    every 65,536 epochs. The weight before each array comes down the same way. No task holds a run.

    Epochs are integers, negative ones included. A null epoch number comes first, repeated ones go by value, nulls first.
    """
    keys = list(keys)
    at = F.col(epoch).cast("bigint")
    arrays, blocks = F.floor(at / F.lit(EMA_FAN)).cast("bigint"), F.floor(F.col("_array") / F.lit(EMA_FAN)).cast("bigint")
    v = f64(value)
    rows = df.select(
        *keys, arrays.alias("_array"),
        F.struct(F.col(epoch).alias("at"), v.alias("v"), F.when(v.isNull(), 1.0).otherwise(F.lit(float(ma))).alias("a"),
                 F.when(v.isNull(), 0.0).otherwise(F.lit(1.0 - ma) * v).alias("b")).alias("_m"))

    def composed(maps: Column, kind: str) -> Column:
        """Each entry with the composition of all maps up to and including its own."""
        none = F.array().cast(f"array<struct<at:{kind},a:double,b:double>>")

        def then(done: Column, m: Column) -> Column:
            last = F.element_at(done, -1)
            first = F.size(done) == 0
            a = F.when(first, m["a"]).otherwise(m["a"] * last["a"])
            b = F.when(first, m["b"]).otherwise(m["a"] * last["b"] + m["b"])
            return F.concat(done, F.array(F.struct(m["at"].alias("at"), a.alias("a"), b.alias("b"))))

        return F.aggregate(maps, none, then)

    def gathered(table: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
        lists = table.groupBy(*by).agg(F.array_sort(F.collect_list("_m")).alias("_maps"))
        return lists.select(*by, composed(F.col("_maps"), kind).alias("_maps"))

    def whole(level: str) -> Column:
        last = F.element_at("_maps", -1)
        return F.struct(F.col(level).alias("at"), last["a"].alias("a"), last["b"].alias("b")).alias("_m")

    def weights_before(table: DataFrame, before: Column, level: str) -> DataFrame:
        """The weight that stands before each entry of the arrays, given the one before the whole array."""
        shifted = F.transform("_maps", lambda m, i: F.struct(
            m["at"].alias(level), F.when(i == 0, before).otherwise(
                F.try_element_at("_maps", i)["a"] * before + F.try_element_at("_maps", i)["b"]).alias("_before")))
        return table.select(*names, F.inline(shifted))

    def met(left: DataFrame, right: DataFrame, level: str) -> DataFrame:
        renamed = right.withColumnsRenamed({c: f"{c}__" for c in (*names, level)})
        same = F.lit(True)
        for c in (*names, level):
            same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
        return left.join(renamed, same).drop(*[f"{c}__" for c in (*names, level)])

    names = [f"_k{i}" for i in range(len(keys))]
    rows = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_array", "_m")
    low = gathered(rows, [*names, "_array"], df.schema[epoch].dataType.simpleString())
    middle = gathered(low.select(*names, blocks.alias("_block"), whole("_array")), [*names, "_block"], "bigint")
    high = gathered(middle.select(*names, whole("_block")), names, "bigint")
    upper = met(middle, weights_before(high, F.lit(float(start)), "_block"), "_block")
    lower = met(low, weights_before(upper, F.col("_before"), "_array"), "_array")
    out = F.transform("_maps", lambda m: F.struct(m["at"].alias(epoch), (m["a"] * F.col("_before") + m["b"]).alias("ema")))
    return lower.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.inline(out))


# --- separability probes ----------------------------------------------------------------------


def _refuse_domains(df: DataFrame, domain: str, source: str, at_least: int) -> None:
    """Stop before any work where a row has no domain, a third domain appears or a domain has too few rows."""
    other = F.when(F.col(domain) != source, F.col(domain))
    low, high, null, m, n = df.agg(
        F.min(other), F.max(other), F.count_if(F.col(domain).isNull()), F.count_if(F.col(domain) == source), F.count(other)).first()
    if null:
        raise ValueError(f"{null} rows without a domain")
    if low != high:
        raise ValueError(f"more than two domains: {source}, {low}, {high}")
    if min(m, n) < at_least:
        raise ValueError(f"each domain needs at least {at_least} rows, found {m} and {n}")


def _is_target(df: DataFrame, domain: str, source: str) -> Column:
    """1 for the target domain, 0 for the source. A null domain stops the job, a third one is refused."""
    named = F.when(F.col(domain) != source, F.col(domain))
    low, high = df.agg(F.min(named), F.max(named)).first()
    if low != high:
        raise ValueError(f"more than two domains: {source}, {low}, {high}")
    return F.when(F.col(domain).isNull(), F.raise_error(F.lit("a row without a domain"))).otherwise((F.col(domain) != source).cast("int"))


def proxy_a_distance(
    df: DataFrame, id_col: str, domain: str, features: str | Sequence[str], seed: int = 0, holdout: float = 0.3,
    source: str = "source",
) -> DataFrame:
    """2*(1-2*error) of a balanced linear domain classifier on a stratified holdout, unclipped.

    `features` is a column of equally long arrays, or a list of a few numeric columns. Columns are standardised
    and fitted by aggregates of the JVM, arrays by vector sums. The result tells sizes, seed and convention.
    Each domain needs two rows at least; rows without a domain, and a third domain, are refused.
    """
    if not 0.0 < holdout < 1.0:
        raise ValueError("the held-out share must lie inside (0, 1)")
    wide = not isinstance(features, str)
    columns = [f"_x{i}" for i in range(len(features))] if wide else ["f"]
    values = [f64(c).alias(n) for c, n in zip(features, columns)] if wide else [F.col(features).cast("array<double>").alias("f")]
    rows = df.select(id_col, _is_target(df, domain, source).alias("y"), *values)
    sizes = rows.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    split = with_group_stats(number_by_hash(rows, ["y"], seed, id_col), sizes, ["y"])
    split = split.withColumn("test", F.col("rn") <= F.round(F.col("_n") * F.lit(holdout)))
    train = split.where(~F.col("test"))
    deviation = lambda v: F.when(v > 0, F.sqrt(v)).otherwise(F.lit(1.0))
    if wide:
        stats = train.agg(*[s for c in columns for s in (F.avg(c).alias(f"{c}_m"), F.var_pop(c).alias(f"{c}_v"))])
        scaled = with_summary(split, stats).withColumns({c: (F.col(c) - F.col(f"{c}_m")) / deviation(F.col(f"{c}_v")) for c in columns})
    else:
        stats = domain_means(train.withColumn("_all", F.lit(1)), "_all", "f")
        packed = stats.agg(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "mean", "var"))),
            lambda s: F.struct(s["mean"].alias("m"), deviation(s["var"]).alias("d")),
        ).alias("_stats"))
        scaled = with_summary(split, packed).withColumn("f", F.zip_with("f", "_stats", lambda x, s: (x - s["m"]) / s["d"]))
    fit = scaled.where(~F.col("test"))
    balance = fit.groupBy("y").agg(F.count(F.lit(1)).alias("_c"))
    total = fit.agg(F.count(F.lit(1)).alias("_t"))
    weighted = with_summary(with_group_stats(fit, balance, ["y"]), total).withColumn("w", F.col("_t") / (F.lit(2.0) * F.col("_c")))
    if wide:
        beta = logistic_fit_columns(weighted, columns, "y", "w")
        decision = sum((F.col(c) * float(b) for c, b in zip(columns, beta)), F.lit(float(beta[-1])))
    else:
        decision = _linear_score("f", logistic_fits(weighted, [], "f", "y", "w")[(-1,)])
    test = scaled.where(F.col("test")).agg(
        F.avg(((decision > 0).cast("int") != F.col("y")).cast("double")).alias("domain_classifier_error"),
        F.count(F.lit(1)).alias("n_holdout"),
    )
    side = lambda y: F.coalesce(F.sum(F.when(F.col("y") == y, F.col("_n"))), F.lit(0))
    counted = with_summary(test, sizes.agg(side(0).alias("n_source"), side(1).alias("n_target")))
    few = F.least("n_source", "n_target") < 2
    return counted.select(
        F.when(few, F.raise_error(F.lit("each domain needs at least two rows"))).otherwise(F.col("domain_classifier_error")).alias("domain_classifier_error"),
        "n_holdout", (F.lit(2.0) * (F.lit(1.0) - F.lit(2.0) * F.col("domain_classifier_error"))).alias("proxy_a_distance"),
        "n_source", "n_target", F.lit(float(holdout)).alias("holdout_fraction"), F.lit(int(seed)).alias("seed"),
        F.lit("2*(1-2*error) of the held-out rows, not clipped").alias("convention"))


def _linear_score(features: str, beta: np.ndarray) -> Column:
    coefs = F.array(*[F.lit(float(b)) for b in beta[:-1]])
    dot = F.aggregate(F.zip_with(features, coefs, lambda x, b: x * b), F.lit(0.0), lambda acc, v: acc + v)
    return dot + F.lit(float(beta[-1]))


def balanced_downsample(df: DataFrame, keys: Sequence[str], domain: str, id_col: str, resamples: int, seed: int) -> DataFrame:
    """min(n_a, n_b) rows of each domain per key and resample, chosen by hash rank.

    Adds `resample` and the 1-based rank `rn` inside (keys, resample, domain).
    """
    sizes = df.groupBy(*keys, domain).agg(F.count(F.lit(1)).alias("_n"))
    smaller = sizes.groupBy(*keys).agg(F.min("_n").alias("_min"), F.count(F.lit(1)).alias("_domains"))
    spread = df.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    keyed = spread.withColumn("_pick", F.concat_ws("|", "resample", id_col))
    ranked = number_by_hash(keyed, [*keys, "resample", domain], seed, "_pick")
    limited = with_group_stats(ranked, smaller, list(keys)) if keys else with_summary(ranked, smaller)
    return limited.where((F.col("rn") <= F.col("_min")) & (F.col("_domains") == 2)).drop("_pick", "_min", "_domains")


def format_probe(
    df: DataFrame, cls: str, domain: str, id_col: str, features: str, source: str = "source",
    resamples: int = 20, folds: int = 5, seed: int = 42,
) -> DataFrame:
    """How well a linear model tells the two domains apart, per class.

    Balanced resamples, stratified folds (as many as the smaller domain has rows, `folds` at most), logistic
    regression; mean and population SD of all fold AUCs, with the counts behind them. A class whose smaller
    domain has less than two rows has no AUC. Rows without a domain, and a third domain, are refused.

    Ranks are drawn on ids alone. A row then stands once with its features and two bit masks per resample: the
    folds whose model it trains, and the fold it is held out from; `masked_logistic_fits` fits all models of
    all classes in the same passes.
    """
    target = _is_target(df, domain, source)
    sides = df.groupBy(F.col(cls).alias("cls")).agg(
        F.count_if(F.col(domain) == source).alias("n_synthetic"), F.count_if(F.col(domain) != source).alias("n_real"))
    counts = cut_lineage(sides.withColumn("n_balanced_per_domain", F.least("n_synthetic", "n_real")).withColumn(
        "folds_per_resample", F.when(F.col("n_balanced_per_domain") >= 2, F.least(F.lit(folds), F.col("n_balanced_per_domain"))).otherwise(0).cast("int")))
    drawn = with_group_stats(
        balanced_downsample(df.select(F.col(cls).alias("cls"), domain, id_col), ["cls"], domain, id_col, resamples, seed),
        counts.select("cls", F.col("folds_per_resample").alias("_folds")), ["cls"]).where("_folds > 0")
    picks = drawn.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("resample", ((F.col("rn") - 1) % F.col("_folds")).cast("int").alias("fold")))).alias("_fold"), F.max("_folds").alias("_folds"))
    one = F.lit(1).cast("bigint")
    words = F.sequence(F.lit(0), F.lit(resamples - 1))
    fold_of = lambda r: F.try_element_at("_fold", r)
    bit = lambda r: F.call_function("shiftleft", one, fold_of(r))
    every = F.call_function("shiftleft", one, F.col("_folds")) - one
    held = F.transform(words, lambda r: F.coalesce(bit(r), F.lit(0).cast("bigint")))
    trained = F.transform(words, lambda r: F.coalesce(every - bit(r), F.lit(0).cast("bigint")))
    masks = picks.select(F.col(id_col).alias("_id"), held.alias("held"), trained.alias("trained"))
    rows = cut_lineage(df.select(
        id_col, F.col(cls).alias("cls"), target.alias("y"), F.col(features).cast("array<double>").alias("f"), F.lit(1.0).alias("w")
    ).join(masks, F.col(id_col) == F.col("_id")).drop(id_col, "_id"))
    shipped = df.sparkSession.sparkContext.broadcast(masked_logistic_fits(rows, "cls", "f", "y", "w", "trained", folds))

    def held_out_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights: dict = {}
        for (g, _, _), beta in sorted(shipped.value.items(), key=lambda m: m[0][1:]):
            weights.setdefault(g, []).append(beta)
        for pdf in batches:
            for key, part in pdf.groupby("cls", sort=False, dropna=False):
                key = next(k for k in weights if k == key or k is None and pd.isna(key))
                beta = np.column_stack(weights[key])
                z = np.stack(part["f"].to_numpy()) @ beta[:-1] + beta[-1]  # every model on one copy of the features
                bits = np.stack(part["held"].to_numpy()).astype(np.int64)[:, :, None] >> np.arange(folds) & 1
                row, model = np.nonzero(bits.reshape(len(part), -1))
                yield pd.DataFrame({
                    "cls": [key] * len(row), "resample": model // folds, "fold": model % folds,
                    "y": part["y"].to_numpy()[row], "score": 1.0 / (1.0 + np.exp(-np.clip(z[row, model], -500, 500)))})

    cls_type = df.schema[cls].dataType.simpleString()
    scored = rows.select("cls", "held", "y", "f").mapInPandas(
        held_out_scores, f"cls {cls_type}, resample int, fold int, y int, score double"
    )
    auc = roc_auc(scored, ["cls", "resample", "fold"], "score", "y", positive=1).groupBy("cls").agg(
        F.avg("roc_auc").alias("auc_mean"), F.stddev_pop("roc_auc").alias("auc_std"), F.count("roc_auc").alias("n_auc_values"))
    named = auc.withColumnRenamed("cls", "_cls")
    joined = counts.join(named, F.col("cls").eqNullSafe(F.col("_cls")), "left")
    return joined.select(
        F.col("cls").alias(cls), "auc_mean", "auc_std", F.coalesce("n_auc_values", F.lit(0)).alias("n_auc_values"), "n_synthetic", "n_real",
        "n_balanced_per_domain", F.lit(resamples).alias("n_resamples"), "folds_per_resample")
