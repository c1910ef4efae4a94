"""Parameter banks, frame selection and roll-ups of generated items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import f64

# Accepted Weibull ranges (shape, |location|, scale) of highlight and shadow fits.
HIGHLIGHT_BOUNDS = (10.0, 500.0, 500.0)
SHADOW_BOUNDS = (50.0, 3000.0, 3000.0)
# Smallest highlight area and contrast of a usable frame.
MIN_HIGHLIGHT_PX, MIN_CONTRAST = 200, 20.0


def bound_reasons(prefix: str, bounds: tuple[float, float, float], psd: str) -> list[Column]:
    """Reject reasons of one fit with columns <prefix>_c, _loc, _scale; a missing shape means a failed fit."""
    shape, loc, scale = (f64(f"{prefix}_{s}") for s in ("c", "loc", "scale"))
    failed = shape.isNull() | F.isnan(shape)
    return [
        F.when(failed, f"{prefix}_fit_failed"),
        F.when(~failed & (shape > bounds[0]), f"{prefix}_shape"),
        F.when(~failed & (F.abs(loc) > bounds[1]), f"{prefix}_location"),
        F.when(~failed & (scale > bounds[2]), f"{prefix}_scale"),
        F.when(F.coalesce(F.col(psd), F.lit(0)) == 0, f"{prefix}_psd_failed"),
    ]


def filter_bank(bank: DataFrame) -> DataFrame:
    """Every reject reason per entry and the keep flag."""
    reasons = F.array_compact(F.array(
        *bound_reasons("hl", HIGHLIGHT_BOUNDS, "hl_psd_size"), *bound_reasons("sh", SHADOW_BOUNDS, "sh_psd_size")
    ))
    return bank.withColumn("reasons", reasons).withColumn("keep", F.size("reasons") == 0)


def select_frames(frames: DataFrame, flag: str, site: str, exclude_site: str, disputed: Column) -> DataFrame:
    """Frames with flag 1 outside one site; disputed frames are marked and kept."""
    kept = frames.where((F.col(flag) == 1) & (F.col(site) != exclude_site))
    return kept.withColumn("disputed", disputed)


def frame_funnel(frames: DataFrame, flag: str, site: str, exclude_site: str, disputed: Column) -> DataFrame:
    """Counts at each selection step in one pass."""
    clear = F.col(flag) == 1
    kept = clear & (F.col(site) != exclude_site)
    return frames.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(clear).alias("flagged"),
        F.count_if(clear & (F.col(site) == exclude_site)).alias("excluded"),
        F.count_if(kept).alias("selected"),
        F.count_if(kept & disputed).alias("disputed_kept"),
        F.count_distinct(F.when(kept, F.col(site))).alias("n_sites"),
    )


def quality_gate(df: DataFrame, n_px: str, contrast: str) -> DataFrame:
    ok = (F.col(n_px) >= MIN_HIGHLIGHT_PX) & (F.col(contrast) >= MIN_CONTRAST)
    return df.withColumn("quality_ok", F.coalesce(ok, F.lit(False)))


def stratum_counts(df: DataFrame, *keys: str, usable: Column | None = None) -> DataFrame:
    """Rows per `a_b` key, optionally counting usable rows only."""
    rows = df.where(usable) if usable is not None else df
    return rows.groupBy(F.concat_ws("_", *keys).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def qc_rollup(
    items: DataFrame, expected: int, mean: str, std: str, clip0: str, clip255: str, highlight: str, background: str,
    shadow: str, redrawn: str, max_clip: float = 0.05,
) -> DataFrame:
    """Rule table (check, status, value) over generated items, from one aggregation."""
    agg = items.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.stddev_pop(mean).alias("mean_spread"), F.stddev_pop(std).alias("std_spread"),
        F.max(clip0).alias("clip0"), F.max(clip255).alias("clip255"),
        F.count_if((F.col(highlight) > F.col(background)) & (F.col(background) > F.col(shadow))).cast("double").alias("ordered"),
        F.count_if(F.col(redrawn) > 0).cast("double").alias("redrawn"),
    )
    warn = lambda ok: F.when(ok, "PASS").otherwise("WARN")
    checks = [
        ("generated", warn(F.col("n") == expected), "n"),
        ("mean_spread", F.lit("INFO"), "mean_spread"),
        ("std_spread", F.lit("INFO"), "std_spread"),
        ("clip0_max", warn(F.col("clip0") < max_clip), "clip0"),
        ("clip255_max", warn(F.col("clip255") < max_clip), "clip255"),
        ("brightness_order", warn(F.col("ordered") == F.col("n")), "ordered"),
        ("redrawn", F.lit("INFO"), "redrawn"),
    ]
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), s.alias("status"), f64(v).alias("value")) for c, s, v in checks
    ]))
    return agg.select(rows.alias("r")).select("r.check", "r.status", "r.value")


def fit_rollup(bank: DataFrame) -> DataFrame:
    """Success and range checks of a parameter bank (PASS, WARN or FAIL)."""
    ok = lambda p: F.col(f"{p}_c").isNotNull() & ~F.isnan(f64(f"{p}_c"))
    aggs = [F.count(F.lit(1)).alias("n")]
    for p in ("hl", "sh"):
        aggs += [
            F.count_if(ok(p)).alias(f"{p}_fit"), F.count_if(F.col(f"{p}_psd_size") > 0).alias(f"{p}_psd"),
            F.count_if(ok(p) & ((f64(f"{p}_c") <= 0) | (f64(f"{p}_scale") <= 0))).alias(f"{p}_nonpositive"),
        ]
    agg = bank.agg(*aggs)
    rows = []
    for p in ("hl", "sh"):
        rows += [
            (f"{p}_fit", F.when(F.col(f"{p}_fit") == F.col("n"), "PASS").otherwise("WARN"), f"{p}_fit"),
            (f"{p}_psd", F.when(F.col(f"{p}_psd") > F.col("n") * F.lit(0.8), "PASS").otherwise("WARN"), f"{p}_psd"),
            (f"{p}_positive", F.when(F.col(f"{p}_nonpositive") == 0, "PASS").otherwise("FAIL"), f"{p}_nonpositive"),
        ]
    table: Sequence[Column] = [F.struct(F.lit(c).alias("check"), s.alias("status"), F.col(v).alias("value")) for c, s, v in rows]
    return agg.select(F.explode(F.array(*table)).alias("r")).select("r.check", "r.status", "r.value")


def _rules(checks: Sequence[tuple[str, Column, Column]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(c).alias("check"), s.alias("status"), f64(v).alias("value")) for c, s, v in checks])).alias("r")


def mask_rollup(
    masks: DataFrame, label: str, targets: Mapping[str, int], width: str, height: str, damage: str, max_side: int, share: float = 0.9,
) -> DataFrame:
    """Rule table (check, status, value) over generated masks, verdict included.

    A class short of `share` of its target warns, a side above `max_side` fails; sizes and the number of masks
    of every kind of damage are for information. The verdict fails where a rule fails; without masks the size rule does. One
    aggregation gives the rules, a second one the kinds of damage, a row each; a null kind is named `none`.
    """
    names = list(targets)
    agg = masks.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(names)],
        *[f(c).alias(f"{tag}_{side}") for side, c in (("width", width), ("height", height)) for tag, f in (("min", F.min), ("max", F.max))])
    side = F.greatest("max_width", "max_height")
    counts = [(f"count_{c}", F.when(F.col(f"n{i}") >= share * targets[c], "PASS").otherwise("WARN"), F.col(f"n{i}")) for i, c in enumerate(names)]
    ranges = [(f"{a}_{tag}", F.lit("INFO"), F.col(f"{tag}_{a}")) for a in ("width", "height") for tag in ("min", "max")]
    rules = agg.select(_rules([
        ("masks", F.lit("INFO"), F.col("n")), *counts, *ranges, ("max_side", F.when(side <= max_side, "PASS").otherwise("FAIL"), side)])).select("r.*")
    kinds = masks.groupBy(F.concat(F.lit("damage_"), F.coalesce(F.col(damage).cast("string"), F.lit("none"))).alias("check")).agg(F.count(F.lit(1)).alias("value"))
    return with_verdict(rules, ("FAIL",)).unionByName(kinds.select("check", F.lit("INFO").alias("status"), f64("value").alias("value")))


def with_verdict(rules: DataFrame, failing: Sequence[str] = ("FAIL", "WARN")) -> DataFrame:
    """The rule table and a row `verdict`: FAIL, with their number, where rules have one of the `failing` states, else PASS."""
    bad = F.count_if(F.col("status").isin(list(failing)))
    verdict = rules.agg(F.lit("verdict").alias("check"), F.when(bad > 0, "FAIL").otherwise("PASS").alias("status"), f64(bad).alias("value"))
    return rules.select("check", "status", "value").unionByName(verdict)


def site_rollup(bank: DataFrame, site: str) -> DataFrame:
    """Usable entries (highlight fit and spectrum both there) in all and per site, and the sites that have one."""
    usable = bank.where(F.col("hl_c").isNotNull() & ~F.isnan(f64("hl_c")) & (F.col("hl_psd_size") > 0))
    per_site = usable.groupBy(F.coalesce(F.col(site).cast("string"), F.lit("none")).alias("site")).agg(F.count(F.lit(1)).alias("value"))
    sums = per_site.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("sites"))
    info = F.lit("INFO")
    return sums.select(_rules([("usable_entries", info, F.col("n")), ("effective_sites", info, F.col("sites"))])).select("r.*").unionByName(
        per_site.select(F.concat(F.lit("site_"), "site").alias("check"), info.alias("status"), f64("value").alias("value")))
