"""Record contracts, roster and content differences, label access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.digests import is_sha256, normalise_path, stays_inside
from ..functions.scalars import f64, is_finite, is_integral
from .running import with_summary

Rule = tuple[str, Column]


def violations(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One row per (record, broken rule). A rule holds only where its condition is true; null fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))
    return df.select(*keys, F.explode(failed).alias("rule"))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The table with its broken rules as an array column, empty for clean rows."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))
    return df.withColumn("broken_rules", failed)


def label_rules(label: str, classes: Sequence[int] = (0, 1)) -> list[Rule]:
    return [
        ("label_missing", F.col(label).isNotNull()),
        ("label_not_finite", F.col(label).isNull() | is_finite(label)),
        ("label_not_integer", ~F.coalesce(is_finite(label), F.lit(False)) | is_integral(label)),
        ("label_unknown_class", ~F.coalesce(is_integral(label), F.lit(False)) | f64(label).isin([float(c) for c in classes])),
    ]


def validate_labels(df: DataFrame, keys: Sequence[str], label: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    return violations(df, keys, label_rules(label, classes))


def validate_probabilities(df: DataFrame, keys: Sequence[str], probs: str, n_classes: int = 2, atol: float = 1e-6) -> DataFrame:
    """Array of class probabilities: right width, finite, in [0, 1], summing to 1."""
    p = F.col(probs)
    finite = F.forall(p, is_finite)
    total = F.aggregate(p, F.lit(0.0), lambda acc, v: acc + f64(v))
    usable = p.isNotNull() & (F.size(p) == n_classes) & finite
    return violations(df, keys, [
        ("wrong_width", p.isNotNull() & (F.size(p) == n_classes)),
        ("not_finite", p.isNull() | finite),
        ("outside_unit_interval", ~F.coalesce(usable, F.lit(False)) | F.forall(p, lambda v: v.between(0.0, 1.0))),
        ("row_sum", ~F.coalesce(usable, F.lit(False)) | (F.abs(total - 1.0) <= atol)),
    ])


def validate_cross_record_consistency(
    df: DataFrame, keys: Sequence[str], shared: Sequence[str] = (), all_or_none: Sequence[str] = ()
) -> DataFrame:
    """Group rules: `shared` fields have one value; `all_or_none` fields are absent everywhere or common to all."""
    fields = [*shared, *all_or_none]
    agg = df.groupBy(*keys).agg(
        *[F.count_distinct(f).alias(f"_d_{f}") for f in fields], *[F.count(f).alias(f"_n_{f}") for f in fields],
        F.count(F.lit(1)).alias("_n"),
    )
    rules = [(f"{f}_not_shared", (F.col(f"_d_{f}") == 1) & (F.col(f"_n_{f}") == F.col("_n"))) for f in shared]
    for f in all_or_none:
        rules.append((f"{f}_partly_present", F.col(f"_n_{f}").isin(0) | (F.col(f"_n_{f}") == F.col("_n"))))
        rules.append((f"{f}_not_common", F.col(f"_d_{f}") <= 1))
    return violations(agg, keys, rules)


def close(a: Column | str, b: Column | str, tol: float = 1e-12) -> Column:
    """Relative or absolute closeness of two doubles."""
    x, y = f64(a), f64(b)
    return F.abs(x - y) <= F.greatest(F.lit(tol) * F.greatest(F.abs(x), F.abs(y)), F.lit(tol))


def run_record_rules(
    protocol: dict[str, object], matrix: str, row_sums: Sequence[int], metrics: dict[str, Column],
    losses: str, n_losses: int, ends: str, ceiling: float, gap: str, digests: Sequence[str] = (), digest32: Sequence[str] = (),
) -> list[Rule]:
    """Contract of one run record.

    `metrics` maps stored metric path to its recomputation from the matrix; `digests` may be null.
    """
    from ..functions.digests import is_md5

    cell = lambda i, j: F.col(matrix)[i][j]
    n = len(row_sums)
    shape = (F.size(matrix) == n) & F.forall(matrix, lambda r: (F.size(r) == n) & F.forall(r, lambda v: v >= 0))
    rules: list[Rule] = [(f"protocol_{k.replace('.', '_')}", F.col(k).eqNullSafe(F.lit(v))) for k, v in protocol.items()]
    rules += [(f"digest_{d}", F.col(d).isNull() | is_sha256(d)) for d in digests]
    rules += [(f"digest_{d}", is_md5(d)) for d in digest32]
    rules.append(("matrix_shape", shape))
    for i, want in enumerate(row_sums):
        row = cell(i, 0)
        for j in range(1, n):
            row = row + cell(i, j)
        rules.append((f"matrix_row_{i}", row == want))
    for path, again in metrics.items():
        tag = path.split(".")[-1]
        rules.append((f"metric_range_{tag}", is_finite(path) & f64(path).between(0.0, 1.0)))
        rules.append((f"metric_recomputed_{tag}", close(path, again)))
    macro = next(p for p in metrics if p.endswith("macro_f1"))
    rules.append(("ceiling_gap", close(gap, F.lit(ceiling) - f64(macro))))
    rules.append(("loss_curve", (F.size(losses) == n_losses) & F.forall(losses, is_finite)))
    first, last = F.element_at(losses, 1), F.element_at(losses, -1)
    rules.append(("loss_endpoints", (F.size(ends) == 2) & close(F.col(ends)[0], first) & close(F.col(ends)[1], last)))
    rules.append(("loss_decreased", last < first))
    return rules


def score_record_rules(
    contract: str, class_order: Sequence[str], k: int, low: float = 0.02, high: float = 0.60
) -> list[Rule]:
    """Contract of one score record with its stored collapse evidence.

    Expects analysis_contract, class_order, authorized, n_checkpoints, mode, route counts n0/n1 with
    their stored flag, the two epoch routes and the stored verdict.
    """
    from .health import collapsed_share

    again = collapsed_share(f64("last_k_n0"), f64("last_k_n1"), low, high)
    votes = F.col("last_epoch_collapsed").cast("int") + again.cast("int") + F.col("any_epoch_collapsed").cast("int")
    return [
        ("contract", F.col("analysis_contract") == contract),
        ("class_order", F.col("class_order") == F.array(*[F.lit(c) for c in class_order])),
        ("authorization", F.col("authorized")),
        ("authorization_reason", F.length(F.trim("reason")) > 0),
        ("checkpoint_count", F.col("n_checkpoints") == k),
        ("prediction_rule", F.col("mode") == "argmax"),
        ("stored_route", F.col("last_k_collapsed") == again),
        ("same_totals", F.col("last_k_n0") + F.col("last_k_n1") == F.col("epoch_total")),
        ("stored_verdict", F.col("collapsed") == (votes >= 2)),
    ]


def probe_record_rules(counts: dict[str, tuple[int, int, int]], n_resamples: int = 20, folds: int = 5) -> list[Rule]:
    """Contract of one probe row (one class): counts, resamples, AUC in [0, 1], SD >= 0."""
    def want(position: int) -> Column:
        out = F.lit(None).cast("int")
        for name, values in counts.items():
            out = F.when(F.col("class") == name, values[position]).otherwise(out)
        return out

    return [
        ("n_synthetic", F.col("n_synthetic") == want(0)),
        ("n_real", F.col("n_real") == want(1)),
        ("n_balanced", F.col("n_balanced_per_domain") == want(2)),
        ("n_resamples", F.col("n_resamples") == n_resamples),
        ("folds", F.col("folds_per_resample") == folds),
        ("n_auc_values", F.col("n_auc_values") == n_resamples * folds),
        ("auc_mean", is_finite("auc_mean") & f64("auc_mean").between(0.0, 1.0)),
        ("auc_std", is_finite("auc_std") & (f64("auc_std") >= 0)),
    ]


# --- rosters and content ------------------------------------------------------------------------


def align_labels(pred: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Strict 1:1 join on id; duplicate, missing or extra ids stop the job."""
    bad = align_violations(pred, labels, id_col).agg(F.count(F.lit(1)).alias("_bad"))
    checked = with_summary(pred.join(labels, id_col), bad)
    guard = F.when(F.col("_bad") == 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.col("_bad").cast("string"), F.lit(" ids are duplicated or unmatched")))
    )
    return checked.where(guard).drop("_bad")


def align_violations(pred: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    a = pred.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_pred"))
    b = labels.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_label"))
    both = a.join(b, id_col, "full").na.fill(0, ["n_pred", "n_label"])
    rule = (
        F.when(F.col("n_label") == 0, "missing_label").when(F.col("n_pred") == 0, "extra_label")
        .when((F.col("n_pred") > 1) | (F.col("n_label") > 1), "duplicate_id")
    )
    return both.withColumn("rule", rule).where("rule is not null")


def roster_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names present on one side only. One exchange: both rosters fold into per-name flags."""
    tagged = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per = tagged.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    side = F.when(F.col("_b") == 0, "a").when(F.col("_a") == 0, "b")
    return per.select(*keys, side.alias("only_in")).where("only_in is not null")


def content_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], digest: str, strict: bool = True) -> DataFrame:
    """Names on both sides with state changed or unchanged; `strict` refuses different rosters."""
    left = a.select(*keys, F.col(digest).alias("digest_a"))
    right = b.select(*keys, F.col(digest).alias("digest_b"))
    joined = left.join(right, list(keys), "full" if strict else "inner")
    state = F.when(F.col("digest_a") == F.col("digest_b"), "unchanged").otherwise("changed")
    if strict:
        one_sided = F.col("digest_a").isNull() | F.col("digest_b").isNull()
        state = F.when(one_sided, F.raise_error(F.lit("an entry is on one roster only"))).otherwise(state)
    return joined.select(*keys, state.alias("state"))


def control_equal(df: DataFrame, name: Sequence[str], arm: str, digest: str, n_arms: int) -> DataFrame:
    """Names whose content differs across arms or that some arm lacks."""
    per = df.groupBy(*name).agg(F.count_distinct(digest).alias("n_digests"), F.count_distinct(arm).alias("n_arms"))
    return per.where((F.col("n_digests") != 1) | (F.col("n_arms") != n_arms))


def restrict_to(df: DataFrame, cls: str, value, names: DataFrame, name: str) -> DataFrame:
    """Keep only whitelisted names of one class; other classes pass untouched."""
    allowed = df.where(F.col(cls) == value).join(names.select(name).distinct(), name, "left_semi")
    return allowed.unionByName(df.where((F.col(cls) != value) | F.col(cls).isNull()))


def cache_lookup(ids: DataFrame, cache: DataFrame, key: str, score: str) -> DataFrame:
    """Left join to a score cache; a miss keeps its row with error 'cache_miss', a non-finite hit stops the job."""
    joined = ids.join(cache.select(key, f64(score).alias(score)), key, "left")
    checked = F.when(F.col(score).isNull() | is_finite(score), F.col(score)).otherwise(F.raise_error(F.lit("non-finite cached score")))
    return joined.withColumn(score, checked).withColumn("error", F.when(F.col(score).isNull(), "cache_miss"))


def cache_summary(looked_up: DataFrame, score: str) -> DataFrame:
    return looked_up.agg(
        F.count(F.lit(1)).alias("n"), F.count(score).alias("n_scored"), F.count("error").alias("n_missed"),
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
    )


def parse_sha256sums(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines `digest␠␠path` to (path, digest); malformed lines stop the job, repeated paths are refused later."""
    parts = F.split(F.col(value), "  ", 2)
    ok = (F.size(parts) == 2) & is_sha256(parts[0]) & (F.length(parts[1]) > 0)
    digest = F.when(ok, F.lower(parts[0])).otherwise(F.raise_error(F.concat(F.lit("invalid line "), F.col(value))))
    return lines.select(normalise_path(parts[1]).alias("path"), digest.alias("digest"))


def verify_sha256sums(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Violations between a parsed manifest and the digests found: roster, repeats, escapes, content."""
    want = manifest.groupBy("path").agg(F.min("digest").alias("want"), F.count(F.lit(1)).alias("n"))
    have = actual.select("path", F.lower("digest").alias("have"))
    joined = want.join(have, "path", "full")
    rule = (
        F.when(~stays_inside("path"), "escapes_root").when(F.col("n") > 1, "duplicate_path")
        .when(F.col("have").isNull(), "missing_file").when(F.col("want").isNull(), "unlisted_file")
        .when(F.col("want") != F.col("have"), "digest_mismatch")
    )
    return joined.select("path", rule.alias("rule")).where("rule is not null")


def event_order_check(log: DataFrame, keys: Sequence[str], ts: str, kind: str, read: str = "label_read", train: str = "train_step") -> DataFrame:
    """Label reads not after the end of training of their run.

    The training end per key is an aggregate joined back, so no run's log is held in one task.
    """
    ends = log.where(F.col(kind) == train).groupBy(*keys).agg(F.max(ts).alias("training_end"))
    reads = log.where(F.col(kind) == read)
    return reads.join(ends, list(keys), "left").where(F.col("training_end").isNull() | (F.col(ts) <= F.col("training_end")))


def dataset_contract(files: DataFrame, cls: str, expected: dict[str, int], width: str, height: str, canonical: int, native_class: str) -> DataFrame:
    """Rule table of a dataset: exact count per class, and at least one native class file of another size."""
    counts = files.groupBy(cls).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col(width) != canonical) | (F.col(height) != canonical)).alias("n_other_size"),
    )
    want: Column = F.lit(None).cast("bigint")
    for name, n in expected.items():
        want = F.when(F.col(cls) == name, F.lit(n)).otherwise(want)
    spark = files.sparkSession
    roster = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in expected])).alias(cls))
    full = roster.join(counts, cls, "full").na.fill(0, ["n", "n_other_size"])
    return violations(full, [cls, "n", "n_other_size"], [
        ("class_count", F.coalesce(F.col("n") == want, F.lit(False))),
        ("native_size", (F.col(cls) != native_class) | (F.col("n_other_size") > 0)),
    ])


# --- label access -------------------------------------------------------------------------------


def authorized_labels(
    df: DataFrame, label: str, reason: str, caller: str, audit_path: str, scope: dict[str, object] | None = None
) -> tuple[DataFrame, "LabelAccess"]:
    """Labels with an explicit reason and caller. The returned handle appends the audit row with the
    number of rows actually read, counted while the labels are used.
    """
    if not reason or not reason.strip() or not caller or not caller.strip():
        raise PermissionError("reading labels needs a non-empty reason and caller")
    if label not in df.columns:
        raise ValueError(f"no column {label!r}")
    rows = df
    for key, value in (scope or {}).items():
        rows = rows.where(F.col(key) == value)
    seen = Observation(f"labels-{caller}")
    observed = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    return observed, LabelAccess(df.sparkSession, seen, reason.strip(), caller.strip(), audit_path, scope or {})


class LabelAccess:
    def __init__(self, spark, seen: Observation, reason: str, caller: str, path: str, scope: dict):
        self._spark, self._seen, self._path = spark, seen, path
        self._row = (caller, reason, ",".join(f"{k}={v}" for k, v in sorted(scope.items())))

    def record(self) -> None:
        """Append the audit row; call after the action that consumed the labels."""
        n = int(self._seen.get["n"])
        row = self._spark.createDataFrame([(*self._row, n)], "caller string, reason string, scope string, n_labels_read bigint")
        row.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(self._path)
