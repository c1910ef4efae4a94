"""Statistics of long rasters (image_id, x, y, v)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import f64
from .running import quantiles, running_totals, with_group_stats, with_summary
from .vectors import _field_types


def affine_match(df: DataFrame, keys: Sequence[str], value: str, mean: Column | float, std: Column | float) -> DataFrame:
    """(v-m)/s*std+mean per item; an item with s < 1e-6 becomes constant.

    Item moments are aggregated and joined back, so an item of any size stays spread over tasks.
    """
    to = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    matched = (f64(value) - F.col("_m")) / F.col("_s") * to(std) + to(mean)
    out = F.when(F.col("_s") < 1e-6, to(mean)).otherwise(matched)
    return with_group_stats(df, stats, list(keys)).withColumn(value, out).drop("_m", "_s")


def widest_gap(df: DataFrame, image: str, x: str, v: str, ratio: float = 0.4, margin: float = 0.5) -> DataFrame:
    """Widest run of dark columns per image (first on ties), widened by int(margin*width) on each side.

    An image without a dark column has a row of nulls.

    Pixels reduce to column means first; a column is dark below ratio times the mean of column means.
    """
    columns = df.groupBy(image, x).agg(F.avg(v).alias("m"))
    level = columns.groupBy(image).agg((F.avg("m") * F.lit(ratio)).alias("cut"))
    dark = columns.join(level, image).where(F.col("m") < F.col("cut"))
    along = Window.partitionBy(image).orderBy(x)
    runs = dark.withColumn("island", F.col(x) - F.row_number().over(along))
    spans = runs.groupBy(image, "island").agg(F.min(x).alias("gap_left"), (F.max(x) + 1).alias("gap_right"))
    width = F.col("gap_right") - F.col("gap_left")
    best = spans.groupBy(image).agg(
        F.max_by(F.struct("gap_left", "gap_right"), F.struct(width.alias("w"), (-F.col("gap_left")).alias("l"))).alias("g")
    )
    pad = F.floor((F.col("g.gap_right") - F.col("g.gap_left")) * F.lit(margin)).cast("int")
    return level.select(image).join(best, image, "left").select(
        image, F.col("g.gap_left").alias("gap_left"), F.col("g.gap_right").alias("gap_right"),
        (F.col("g.gap_right") - F.col("g.gap_left")).alias("gap_width"),
        (F.col("g.gap_left") - pad).alias("left_end"), (F.col("g.gap_right") + pad).alias("right_start"),
    )


def tile_stats(
    df: DataFrame, image: str, x: str, y: str, v: str, size: int = 700, stride: int = 560,
    extent: DataFrame | None = None, min_mean: float = 20.0, min_std: float = 5.0,
) -> DataFrame:
    """Mean and population SD of overlapping tiles, and whether a tile passes the quality bounds.

    Pixels are summed once into cells of gcd(size, stride); a tile is a sum of cells, so overlap
    multiplies cells and not pixels. `extent` gives width and height per image, else the largest
    coordinates are used. Only complete tiles are produced.
    """
    cell = gcd(size, stride)
    per, step = size // cell, stride // cell
    cells = df.groupBy(image, F.floor(F.col(x) / cell).cast("int").alias("cx"), F.floor(F.col(y) / cell).cast("int").alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(f64(v)).alias("s"), F.sum(f64(v) * f64(v)).alias("q"),
        F.max(x).alias("mx"), F.max(y).alias("my"),
    )
    dims = extent if extent is not None else cells.groupBy(image).agg((F.max("mx") + 1).alias("width"), (F.max("my") + 1).alias("height"))
    tiles = lambda c: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - per + 1) / step).cast("int")), F.floor(F.col(c) / step).cast("int"))
    placed = cells.withColumn("tx", F.explode(tiles("cx"))).withColumn("ty", F.explode(tiles("cy")))
    sums = placed.groupBy(image, "tx", "ty").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    whole = (F.col("tx") * stride + size <= F.col("width")) & (F.col("ty") * stride + size <= F.col("height"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    out = sums.join(dims, image).where(whole).select(image, "tx", "ty", "n", mean.alias("mean"), std.alias("std"))
    return out.withColumn("keep", (F.col("mean") >= min_mean) & (F.col("std") >= min_std))


def block_pool_summary(tiles: DataFrame) -> DataFrame:
    """Mean, SD, range and percentiles of the kept tiles' means and SDs."""
    kept = tiles.where("keep")
    aggs = [F.count(F.lit(1)).alias("n_blocks")]
    for c in ("mean", "std"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    out = kept.agg(*aggs)
    for c in ("mean", "std"):
        points = {f"{c}_p5": 0.05, f"{c}_p50": 0.5, f"{c}_p95": 0.95}
        out = with_summary(out, quantiles(kept, [], c, points).drop("n"))
    return out


def image_qc(df: DataFrame, image: str, v: str) -> DataFrame:
    """Mean, population SD and shares of exact 0 and 255 per image."""
    return df.groupBy(image).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.avg((F.col(v) == 0).cast("double")).alias("clip0_frac"), F.avg((F.col(v) == 255).cast("double")).alias("clip255_frac"),
        F.count(F.lit(1)).alias("n_px"),
    )


def grey_histogram(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """Counts per grey level 0..255; everything later works on these at most 256 rows per key.

    A value that is no such level (missing, fractional, out of range) stops the job: it is neither
    rounded nor left out.
    """
    known = F.coalesce(F.col(v).between(0, 255) & (F.floor(F.col(v)) == F.col(v)), F.lit(False))
    message = F.concat(F.lit("not a grey level: "), F.coalesce(F.col(v).cast("string"), F.lit("null")))
    level = F.when(known, F.col(v).cast("int")).otherwise(F.raise_error(message))
    return df.groupBy(*keys, level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def otsu_by_group(df: DataFrame, keys: Sequence[str], v: str, min_px: int = 50) -> DataFrame:
    """Threshold of maximal between-class variance and the bright side's size, medians and contrast.

    Bright is `>=` the threshold; groups below `min_px` pixels get zeros.
    """
    keys = list(keys)
    hist = grey_histogram(df, keys, v)
    upto = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    cum = hist.withColumns({
        "w": F.sum("n").over(upto), "m": F.sum(F.col("n") * F.col("level")).over(upto),
        "tw": F.sum("n").over(whole), "tm": F.sum(F.col("n") * F.col("level")).over(whole),
    })
    w, m, tw, tm = (f64(c) for c in ("w", "m", "tw", "tm"))
    between = F.when(w < tw, F.pow(tm * w / tw - m, 2) / (w * (tw - w))).otherwise(F.lit(0.0))
    scored = cum.withColumn("between", between)
    best = scored.groupBy(*keys).agg(
        F.max_by("level", F.struct(F.col("between"), (-F.col("level")).alias("neg"))).alias("threshold"), F.max("tw").alias("n_px")
    )
    sides = hist.join(best, keys).withColumn("bright_n", F.when(F.col("level") >= F.col("threshold"), F.col("n")).otherwise(F.lit(0)))
    agg = sides.groupBy(*keys).agg(
        F.max("threshold").alias("threshold"), F.max("n_px").alias("n_px"), F.sum("bright_n").alias("n_bright"),
        F.percentile("level", F.lit(0.5), F.col("n")).alias("median"),
        F.percentile("level", F.lit(0.5), F.col("bright_n")).alias("bright_median"),
    )
    usable = F.col("n_px") >= min_px
    zero = lambda c: F.when(usable, f64(c)).otherwise(F.lit(0.0)).alias(c)
    return agg.select(
        *keys, "n_px", zero("threshold"), F.when(usable, F.col("n_bright")).otherwise(F.lit(0)).alias("n_bright"), zero("median"), zero("bright_median"),
        F.when(usable, F.col("bright_median") - F.col("median")).otherwise(F.lit(0.0)).alias("contrast"),
    )


def weibull_fit_by_group(df: DataFrame, keys: Sequence[str], v: str, min_px: int = 50, steps: int = 100) -> DataFrame:
    """Maximum-likelihood Weibull shape and scale with location 0 per group.

    Groups are reduced to their at most 256 grey levels first; the Newton iteration then sees a
    histogram, not pixels. Fewer than `min_px` pixels, or a level at or below 0, give nulls.
    """
    keys = list(keys)
    hist = grey_histogram(df, keys, v).withColumnRenamed("level", "value")
    schema = f"{_field_types(df, keys)}, c double, loc double, scale double, n_px bigint"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf["value"].to_numpy().astype(np.float64), pdf["n"].to_numpy().astype(np.float64)
        size = int(n.sum())
        c = scale = None
        if size >= min_px and x.min() > 0 and len(x) > 1:
            top = x.max()
            logs, mean_log = np.log(x / top), float((n * np.log(x / top)).sum() / n.sum())
            c = 1.0
            for _ in range(steps):
                powered = n * np.exp(c * logs)
                s0, s1, s2 = powered.sum(), (powered * logs).sum(), (powered * logs * logs).sum()
                value = s1 / s0 - 1.0 / c - mean_log
                slope = (s2 * s0 - s1 * s1) / (s0 * s0) + 1.0 / (c * c)
                moved = max(c - value / slope, c / 2)
                done = abs(moved - c) <= 1e-13 * c
                c = moved
                if done:
                    break
            scale = float(top * ((n * np.exp(c * logs)).sum() / n.sum()) ** (1.0 / c))
            if not (np.isfinite(c) and np.isfinite(scale) and c > 0 and scale > 0):
                c = scale = None
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "c": c, "loc": None if c is None else 0.0, "scale": scale, "n_px": size}])

    return hist.groupBy(*keys).applyInPandas(fit, schema)


#: Ranks whose margin values one task adds up.
RANK_CHUNK = 1 << 16
#: Ids of equal values that are placed in one window.
TIED_IDS = 1 << 12


def _rank_moments(sizes: DataFrame, grey) -> DataFrame:
    """Mean and population SD of grey((rank - 1/2) / n) over the ranks 1..n, for every distinct group size `_n`.

    They depend on the size alone, so no row is read: the ranks are generated in chunks, spread over the tasks.
    """
    last = F.floor((F.col("_n") - 1) / F.lit(RANK_CHUNK)).cast("bigint")
    chunks = sizes.select("_n").distinct().select("_n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_chunk")).repartition("_n", "_chunk")
    first = F.col("_chunk") * RANK_CHUNK + 1
    ranks = chunks.select("_n", F.explode(F.sequence(first, F.least(F.col("_n"), first + (RANK_CHUNK - 1)))).alias("_r"))
    value = grey((F.col("_r") - F.lit(0.5)) / F.col("_n"))
    return ranks.groupBy("_n").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))


def weibull_rank_map(
    df: DataFrame, keys: Sequence[str], value: str, id_col: str, shape: float, loc: float, scale: float,
    target_mean: float, target_std: float, lo: float, hi: float, floor: float = 1.5,
) -> DataFrame:
    """Map values by rank onto a Weibull margin, match moments, round and clip to 0..255.

    The rank of a row is the number of rows with smaller values, cumulated over the counts of distinct values, plus
    its place among its ties by the unique integer `id_col`. Ties are cut by ranges of `TIED_IDS` ids, so an image
    with one value for most of its pixels spreads like any other. `lo` and `hi` bound the values; they only cut the
    cumulation into buckets, ranks are exact. The moments of the margin follow from the size of the group alone; sizes and moments
    of the groups reach the rows by a counted broadcast.
    """
    keys = list(keys)
    grey = lambda p: F.lit(loc) + F.lit(scale) * F.pow(-F.log(F.lit(1.0) - p), F.lit(1.0 / max(shape, floor)))
    cut = df.withColumns({"_v": f64(value), "_ids": F.floor(F.col(id_col) / F.lit(TIED_IDS)).cast("bigint")})
    tied = [*keys, "_v", "_ids"]
    span = (F.col("_v") - F.lit(lo)) / F.lit(max(hi - lo, 1e-300))
    fine = F.least(F.greatest(F.floor(span * F.lit(float(2**20))), F.lit(-1)), F.lit(2**20)).cast("bigint")
    counts = running_totals(
        cut.groupBy(*tied).agg(F.count(F.lit(1)).alias("_c")), keys, [F.shiftright(fine, 10), fine], [F.col("_v"), F.col("_ids")], ["_c"], prefix="_upto")
    placed = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*tied).orderBy(id_col)))
    ranked = placed.join(counts, tied).withColumn("_rank", F.col("_upto_c") - F.col("_c") + F.col("_at")).drop("_v", "_ids", "_at", "_c", "_upto_c")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else df.agg(F.count(F.lit(1)).alias("_n"))
    stats = sizes.join(_rank_moments(sizes, grey), "_n")
    joined = with_group_stats(ranked, stats, keys) if keys else with_summary(ranked, stats)
    g = grey((F.col("_rank") - F.lit(0.5)) / F.col("_n"))
    spread = F.when(F.col("_s") < 1e-6, F.lit(1.0)).otherwise(F.col("_s"))
    matched = (g - F.col("_m")) / spread * F.lit(target_std) + F.lit(target_mean)
    out = F.least(F.greatest(F.bround(matched, 0), F.lit(0.0)), F.lit(255.0))
    return joined.withColumn("grey", out).drop("_rank", "_n", "_m", "_s")


def lowlevel_features(df: DataFrame, image: str, x: str, y: str, v: str, size: int, bins: int = 32, grid: int = 8) -> DataFrame:
    """Normalised grey histogram and grid-cell mean thumbnail per image, as one array of bins+grid^2 doubles.

    Pixels fold into (grey bin, cell) counts before anything is collected per image.
    """
    width = 256 // bins
    cell = F.floor(F.col(y) * grid / F.lit(size)).cast("int") * grid + F.floor(F.col(x) * grid / F.lit(size)).cast("int")
    parts = df.groupBy(image, F.floor(F.col(v) / width).cast("int").alias("b"), cell.alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(f64(v)).alias("s")
    )
    hist = [F.sum(F.when(F.col("b") == i, F.col("n")).otherwise(0)) / F.sum("n") for i in range(bins)]
    thumb = [
        F.coalesce(F.sum(F.when(F.col("c") == i, F.col("s"))) / F.sum(F.when(F.col("c") == i, F.col("n"))) / F.lit(255.0), F.lit(0.0))
        for i in range(grid * grid)
    ]
    return parts.groupBy(image).agg(F.array(*hist, *thumb).alias("features"))


def gmm_segment(
    df: DataFrame, v: str, components: int = 3, max_iter: int = 100, tol: float = 1e-3, keys: Sequence[str] = (), floor: float = 1e-6,
) -> DataFrame:
    """Gaussian-mixture label of every grey value, per key; labels ascend with the component means.

    Expectation-maximisation on the grey histogram of each key, at most 256 weighted levels: equal weights, means at
    the levels that hold the quantiles (k + 1/2)/components, and the variance of all values to start with; it ends
    when the mean log-likelihood rises by less than `tol`, or after `max_iter` steps. Variances have `floor` added.
    Equal posteriors go to the lower label. A value that is no grey level stops the job.

    A key's mixture is a row with the label of each level; rows get it by a counted broadcast over the keys, so
    grey values are never joined on.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    hist = grey_histogram(df.withColumns(dict(zip(names, map(F.col, keys)))), names, v)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("level")
        x, n = pdf["level"].to_numpy().astype(np.float64), pdf["n"].to_numpy().astype(np.float64)
        total = n.sum()
        centre = (n * x).sum() / total
        mean = x[[int(np.searchsorted(n.cumsum(), (k + 0.5) / components * total)) for k in range(components)]]
        var = np.full(components, (n * (x - centre) ** 2).sum() / total + floor)
        share, before = np.full(components, 1.0 / components), -np.inf
        for _ in range(max_iter):
            part = np.log(share) - 0.5 * np.log(2 * np.pi * var) - 0.5 * (x[:, None] - mean) ** 2 / var
            top = part.max(axis=1)
            whole = top + np.log(np.exp(part - top[:, None]).sum(axis=1))
            held = n[:, None] * np.exp(part - whole[:, None])
            size = np.maximum(held.sum(axis=0), 1e-300)
            mean = (held * x[:, None]).sum(axis=0) / size
            var = (held * (x[:, None] - mean) ** 2).sum(axis=0) / size + floor
            share = size / total
            now = float((n * whole).sum() / total)
            if abs(now - before) < tol:
                break
            before = now
        order = np.argsort(mean, kind="stable")
        levels = np.arange(256.0)[:, None]
        part = (np.log(share) - 0.5 * np.log(var) - 0.5 * (levels - mean) ** 2 / var)[:, order]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in names}, "_labels": part.argmax(axis=1).tolist()}])

    kind = "".join(f"`{n}` {df.schema[k].dataType.simpleString()}, " for n, k in zip(names, keys))
    fits = hist.groupBy(*names).applyInPandas(fit, f"{kind}_labels array<int>").withColumnsRenamed(dict(zip(names, keys)))
    joined = with_group_stats(df, fits, list(keys), small_rows=2_000) if keys else with_summary(df, fits)
    return joined.withColumn("label", F.element_at("_labels", F.col(v).cast("int") + 1)).drop("_labels")


def explode_images(images: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the `image` source to a long grey raster; the first channel is taken."""
    names = list(keep)
    schema = f"{_field_types(images, names) + ', ' if names else ''}origin string, x int, y int, v int"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                h, w, c = row["height"], row["width"], row["channels"]
                grid = np.frombuffer(row["data"], dtype=np.uint8).reshape(h, w, c)[:, :, 0]
                yy, xx = np.mgrid[0:h, 0:w]
                yield pd.DataFrame({**{k: row[k] for k in names}, "origin": row["origin"],
                                    "x": xx.ravel().astype("int32"), "y": yy.ravel().astype("int32"), "v": grid.ravel().astype("int32")})

    readable = images.where("image.height > 0").select(
        *names, "image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    )
    return readable.mapInPandas(decode, schema)
