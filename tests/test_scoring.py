"""Golden values and edge rules of scoring and calibration."""

import math

import pytest
from pyspark.sql import functions as F

from gradeline.operators import calibration, metrics, predictions, ranking

Y = [0, 0, 0, 0, 1, 1, 1, 1]
P0 = [0.90, 0.80, 0.60, 0.40, 0.55, 0.70, 0.20, 0.10]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, "r", y, p, 1.0 - p) for i, (y, p) in enumerate(zip(Y, P0))]
    return spark.createDataFrame(rows, "sample_id int, run string, y_true int, p0 double, p1 double")


def test_confusion_f1_and_ap(golden):
    scored = predictions.predict(golden)
    row = metrics.classification_metrics(scored, ["run"]).first()
    assert [row["c00"], row["c01"], row["c10"], row["c11"]] == [3, 1, 2, 2]
    assert row["macro_f1"] == pytest.approx(0.6190476190476191, abs=1e-15)
    assert ranking.average_precision(golden, ["run"]).first()["average_precision"] == pytest.approx(0.8541666666666666, abs=1e-15)


def test_run_metrics_equals_separate_passes(golden):
    row = ranking.run_metrics(golden, ["run"]).first()
    assert row["average_precision"] == pytest.approx(0.8541666666666666, abs=1e-15)
    assert row["macro_f1"] == pytest.approx(0.6190476190476191, abs=1e-15)


def test_average_precision_null_for_one_class(spark):
    rows = spark.createDataFrame([(1, 0, 0.3), (1, 0, 0.9), (2, 1, 0.4)], "run int, y_true int, p0 double")
    got = {r["run"]: r["average_precision"] for r in ranking.average_precision(rows, ["run"]).collect()}
    assert got == {1: None, 2: None}


def test_ranking_against_brute_force_with_ties_and_saturation(spark):
    scores = [0.0, 1e-17, 1e-9, 0.25, 0.25, 0.25, 0.5, 0.999999999, 1.0, 1.0, 1 - 1e-12, 0.75]
    truth = [1, 0, 1, 0, 1, 0, 1, 0, 0, 1, 0, 1]
    rows = spark.createDataFrame([("r", t, s) for t, s in zip(truth, scores)], "run string, y_true int, p0 double")
    pos = [s for s, t in zip(scores, truth) if t == 0]
    neg = [s for s, t in zip(scores, truth) if t == 1]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert ranking.roc_auc(rows, ["run"]).first()["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-14)
    ap, tp, seen = 0.0, 0, 0
    for s in sorted(set(scores), reverse=True):
        hits = sum(1 for x, t in zip(scores, truth) if x == s and t == 0)
        n = sum(1 for x in scores if x == s)
        tp, seen = tp + hits, seen + n
        ap += hits / len(pos) * tp / seen
    assert ranking.average_precision(rows, ["run"]).first()["average_precision"] == pytest.approx(ap, abs=1e-14)


def test_tie_goes_to_lowest_class_and_threshold_is_closed(spark):
    rows = spark.createDataFrame([(0.5, 0.5), (0.499, 0.501)], "p0 double, p1 double")
    assert [r["y_pred"] for r in predictions.predict(rows).collect()] == [0, 1]
    assert [r["y_pred"] for r in predictions.predict(rows, mode="threshold", threshold=0.5).collect()] == [0, 1]


def test_checkpoint_mean_in_double_and_k(spark):
    values = [0.49999997] * 4 + [0.5]
    rows = spark.createDataFrame([(0, e, 1, v, 1 - v) for e, v in enumerate(values)], "sample_id int, epoch int, y_true int, p0 double, p1 double")
    mean = predictions.mean_checkpoints(rows, ["sample_id"], expected_k=5)
    assert predictions.predict(mean).first()["y_pred"] == 1
    single = predictions.mean_checkpoints(rows.where("epoch = 0"), ["sample_id"])
    assert single.first()["p0"] == 0.49999997
    with pytest.raises(Exception, match="expected exactly 4"):
        predictions.mean_checkpoints(rows, ["sample_id"], expected_k=4).collect()


def test_brier_and_ece_extremes(spark):
    perfect = spark.createDataFrame([("r", 0, 1.0, 0.0), ("r", 1, 0.0, 1.0)], "run string, y_true int, p0 double, p1 double")
    uniform = spark.createDataFrame([("r", 0, 0.5, 0.5), ("r", 1, 0.5, 0.5)], "run string, y_true int, p0 double, p1 double")
    assert calibration.brier(perfect, ["run"]).first()["brier"] == 0.0
    assert calibration.brier(uniform, ["run"]).first()["brier"] == 0.5
    ece = {r["target"]: r for r in calibration.calibration_error(uniform, ["run"]).collect()}
    assert ece["top_label"]["calibration_error"] == 0.0 and ece["top_label"]["sparse"]


def test_equal_width_bins_match_edges(spark):
    from gradeline.functions.scalars import equal_width_bin

    for bins in (10, 15, 7):
        step = 1.0 / bins
        values = sorted({x for i in range(bins + 1) for x in (i * step, i / bins, math.nextafter(i * step, 0), math.nextafter(i * step, 2)) if 0 <= x <= 1})
        df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("b", equal_width_bin("x", bins))
        edges = [i * step for i in range(1, bins)]
        for r in df.collect():
            assert r["b"] == sum(e <= r["x"] for e in edges), (bins, r)


def test_threshold_sweep_matches_direct_counts(golden):
    cuts = [0.0, 0.2, 0.55, 0.9, 1.0]
    got = {r["threshold"]: r for r in metrics.threshold_sweep(golden, ["run"], cuts, authorized=True, reason="test").collect()}
    for t in cuts:
        direct = metrics.classification_metrics(predictions.predict(golden, mode="threshold", threshold=t), ["run"]).first()
        assert got[t]["macro_f1"] == direct["macro_f1"]
    with pytest.raises(ValueError):
        metrics.threshold_sweep(golden, ["run"], [0.5, 0.5], authorized=True, reason="test")


def test_stratified_metrics_edges_and_nulls(spark):
    rows = [(i, i % 2, i % 2, float(v) if v is not None else None) for i, v in enumerate([1, 2, 3, 4, None, 3])]
    df = spark.createDataFrame(rows, "sample_id int, y_true int, y_pred int, cov double")
    out = {r["bin"]: r for r in calibration.stratified_metrics(df, "cov", 2).collect()}
    assert sum(r["support_0"] + r["support_1"] for r in out.values()) == 5
    assert out[0]["excluded"] == 1
    assert out[1]["support_0"] + out[1]["support_1"] == 3  # the median value 3 belongs to the upper bin
    flat = spark.createDataFrame([(0, 0, 7.0), (1, 1, 7.0)], "y_true int, y_pred int, cov double")
    assert calibration.stratified_metrics(flat, "cov", 3).first()["status"] == "degenerate_equal_covariate"


def test_imbalance_undefined_status(spark):
    counts = spark.createDataFrame([(5, 0, 0, 0), (2, 1, 1, 2)], "c00 int, c01 int, c10 int, c11 int")
    one, two = sorted(metrics.imbalance_metrics(counts).collect(), key=lambda r: -r["c00"])
    assert one["status"] == "undefined_class_recall" and one["balanced_accuracy"] is None and one["mcc"] == 0.0
    assert two["status"] == "ok" and two["mcc"] == pytest.approx(1 / 3)


def test_class_weights(spark):
    counts = spark.createDataFrame([(0, 90), (1, 400)], "cls int, n bigint")
    inv = {r["cls"]: r["weight"] for r in metrics.class_weights(counts, "cls", "n").collect()}
    assert inv == {0: pytest.approx(490 / 180), 1: pytest.approx(490 / 800)}
    eff = [r["weight"] for r in metrics.class_weights(counts, "cls", "n", "effective_number").collect()]
    assert sum(eff) == pytest.approx(2.0)
    empty = spark.createDataFrame([(0, 0), (1, 4)], "cls int, n bigint")
    with pytest.raises(Exception, match="empty class ship"):
        two = spark.createDataFrame([("airplane", 3)], "cls string, n bigint")
        metrics.class_weights(two, "cls", "n", classes=["airplane", "ship"]).collect()
    with pytest.raises(Exception, match="empty class"):
        metrics.class_weights(empty, "cls", "n").collect()


def test_row_order_and_partitions_do_not_matter(golden):
    a = ranking.run_metrics(golden.orderBy(F.desc("sample_id")).coalesce(1), ["run"]).first()
    b = ranking.run_metrics(golden.repartition(7, "sample_id"), ["run"]).first()
    assert a == b


def test_extract_metric_refuses_nan(spark):
    df = spark.createDataFrame([(1, (float("nan"),))], "k int, metrics struct<macro_f1: double>")
    with pytest.raises(Exception, match="must be finite"):
        metrics.extract_metric(df, ["k"], "macro_f1").collect()
    with pytest.raises(ValueError, match="must be numeric"):
        flags = spark.createDataFrame([(1, (True,))], "k int, metrics struct<ok: boolean>")
        metrics.extract_metric(flags, ["k"], "ok")


def test_select_last_k_is_numeric_and_refuses_duplicates(spark):
    names = [("r", f"run_epoch{e}.pth") for e in (9, 10, 100, 11, 2)] + [("r", "run_epoch7.txt"), ("r", "other_epoch999.pth")]
    df = spark.createDataFrame(names, "run string, name string")
    assert sorted(r["epoch"] for r in predictions.select_last_k(df, ["run"], "name", "run", 3).collect()) == [10, 11, 100]
    twice = spark.createDataFrame([("r", "run_epoch9.pth"), ("r", "run_epoch009.pth")], "run string, name string")
    with pytest.raises(Exception, match="duplicate epoch"):
        predictions.select_last_k(twice, ["run"], "name", "run", 3).collect()


def test_stratified_metrics_returns_every_bin(spark):
    """A key without rows in a bin keeps it with zero support; infinities stop, nothing valid is a status."""
    rows = [("a", float(i), i % 2, i % 2) for i in range(1, 5)] + [("b", 1.0, 0, 0), ("b", None, 1, 1)]
    df = spark.createDataFrame(rows, "run string, cov double, y_true int, y_pred int")
    out = {(r["run"], r["bin"]): r for r in calibration.stratified_metrics(df, "cov", 2, ["run"]).collect()}
    assert set(out) == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    assert out["b", 1]["support_0"] == out["b", 1]["support_1"] == 0 and out["b", 1]["f1_0"] == 0.0
    assert out["a", 0]["support_0"] + out["a", 0]["support_1"] + out["a", 1]["support_0"] + out["a", 1]["support_1"] == 4
    none = calibration.stratified_metrics(df.withColumn("cov", F.lit(None).cast("double")), "cov", 2).collect()
    assert [(r["bin"], r["status"], r["support_0"], r["excluded"]) for r in none] == [(None, "no_valid_covariates", 0, 6)]
    with pytest.raises(Exception, match="infinite value"):
        calibration.stratified_metrics(df.withColumn("cov", F.lit(float("inf"))), "cov", 2).collect()


def test_threshold_sweep_counts_as_single_comparisons_do(spark):
    df = spark.range(2000).select(F.lit("r").alias("run"), (F.col("id") % 2).cast("int").alias("y_true"), (F.col("id") * 37 % 1001 / F.lit(1000.0)).alias("p0"))
    cuts = [i / 40 for i in range(41)]
    got = {r["threshold"]: (r["c00"], r["c01"], r["c10"], r["c11"]) for r in metrics.threshold_sweep(df, ["run"], cuts, authorized=True, reason="test").collect()}
    rows = [(r["y_true"], r["p0"]) for r in df.collect()]
    for t in cuts:
        assert got[t] == tuple(sum(1 for y, p in rows if y == c and (p >= t) == hit) for c in (0, 1) for hit in (True, False))
