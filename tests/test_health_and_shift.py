"""Collapse rules, triangulation, shift estimators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.operators import health, shift, vectors


def test_collapse_edges(spark):
    pairs = [(0, 100), (2, 98), (3, 97), (59, 41), (60, 40)]
    df = spark.createDataFrame(pairs, "n0 int, n1 int")
    got = {r["n0"]: r["collapsed"] for r in health.collapse_from_counts(df, "n0", "n1").collect()}
    assert [got[a] for a, _ in pairs] == [True, True, False, False, True]
    for bad in [(0.0, 0.0), (-1.0, 5.0), (1.5, 2.0), (float("nan"), 1.0)]:
        with pytest.raises(Exception, match="non-negative integers"):
            health.collapse_from_counts(spark.createDataFrame([bad], "n0 double, n1 double"), "n0", "n1").collect()


def test_triangulation_truth_table(spark):
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate([
        (True, True, True), (True, True, False), (True, False, False), (False, False, False),
        (True, None, None), (True, False, None), (True, True, None), (None, None, None)])]
    df = spark.createDataFrame(rows, "i int, a boolean, b boolean, c boolean")
    out = health.triangulate(df, ["a", "b", "c"]).collect()
    got = {r["i"]: (r["verdict"], r["unanimous"], r["disagreement_warning"]) for r in out}
    assert got[0] == (True, True, False) and got[1] == (True, False, True) and got[2] == (False, False, True)
    assert got[3] == (False, True, False) and got[4] == (None, True, True) and got[5] == (None, False, True)
    assert got[6] == (True, True, False) and got[7] == (None, False, True)


def test_epoch_routes_refuse_bad_histories(spark):
    ok = spark.createDataFrame([("r", 1, 50, 50), ("r", 2, 100, 0), ("r", 3, 30, 70)], "run string, epoch int, n0 int, n1 int")
    r = health.epoch_collapse_routes(ok, ["run"], "epoch", "n0", "n1").first()
    assert (r["last_epoch"], r["last_epoch_collapsed"], r["any_epoch_single_class"], r["collapsed_epochs"]) == (3, False, True, [2])
    with pytest.raises(Exception, match="duplicate epoch"):
        health.epoch_collapse_routes(ok.unionByName(ok.where("epoch = 1")), ["run"], "epoch", "n0", "n1").collect()
    with pytest.raises(Exception, match="totals differ"):
        health.epoch_collapse_routes(ok.withColumn("n0", F.col("n0") + F.col("epoch")), ["run"], "epoch", "n0", "n1").collect()


def vec_df(spark, source, target):
    rows = [(i, "source", [float(x) for x in np.atleast_1d(v)]) for i, v in enumerate(source)]
    rows += [(1000 + i, "target", [float(x) for x in np.atleast_1d(v)]) for i, v in enumerate(target)]
    return spark.createDataFrame(rows, "id int, domain string, f array<double>")


def test_mmd_golden(spark):
    want = 1.5 * math.exp(-0.5) - math.exp(-2) - 0.5 * math.exp(-4.5)
    got = shift.rbf_mmd2(vec_df(spark, [0, 1], [2, 3]), "id", "domain", "f", bandwidth=1.0).first()["mmd2"]
    assert got == pytest.approx(want, abs=1e-14)


def test_mmd_and_median_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(23, 4)), rng.normal(0.7, 1.3, size=(31, 4))
    df = vec_df(spark, a, b)
    pooled = np.vstack([a, b])
    d = np.sqrt(((pooled[:, None] - pooled[None]) ** 2).sum(-1))
    median = float(np.median(d[np.triu_indices(len(pooled), 1)]))
    assert shift.median_distance(df, "id", "domain", "f", block_rows=8) == pytest.approx(median, rel=1e-12)
    g = 1 / (2 * median**2)
    k = lambda x, y: np.exp(-g * ((x[:, None] - y[None]) ** 2).sum(-1))
    m, n = len(a), len(b)
    want = (k(a, a).sum() - m) / (m * (m - 1)) + (k(b, b).sum() - n) / (n * (n - 1)) - 2 * k(a, b).mean()
    got = shift.rbf_mmd2(df, "id", "domain", "f", block_rows=8).first()
    assert got["mmd2"] == pytest.approx(want, abs=1e-12)


def test_coral_golden(spark):
    r = shift.coral_distance(vec_df(spark, [0, 1, 2], [0, 2, 4]), "domain", "f").first()
    assert r["coral_distance"] == pytest.approx(2.25) and r["mean_difference_l2"] == pytest.approx(1.0)


def test_moments_far_from_zero(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1.0, size=(200, 3))
    df = vec_df(spark, x, x).where("domain = 'source'").repartition(4)
    r = vectors.moments(df, ["domain"], "f").first()
    want = (x - x.mean(0)).T @ (x - x.mean(0))
    assert np.array(r["scatter"]).reshape(3, 3) == pytest.approx(want, rel=1e-3, abs=0.5)
    assert r["n"] == 200


def test_pad_separable(spark):
    r = shift.proxy_a_distance(vec_df(spark, np.linspace(0, 1, 40), np.linspace(5, 6, 40)), "id", "domain", "f").first()
    assert (r["domain_classifier_error"], r["proxy_a_distance"]) == (0.0, 2.0)
    assert r["n_holdout"] == 24


def test_logistic_fit_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=120) > 0).astype(int)
    rows = [(i, int(t), [float(v) for v in r], 1.0) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, y int, f array<double>, w double").repartition(3)
    beta = vectors.logistic_fits(df, [], "f", "y", "w")[(-1,)]
    design = np.column_stack([x, np.ones(len(x))])
    grad = beta + design.T @ (1 / (1 + np.exp(-design @ beta)) - y)
    assert np.abs(grad).max() < 1e-6


def test_format_probe_separable_and_random(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        dom = "source" if i % 2 else "target"
        rows.append((i, "easy", dom, [float(i % 2), 0.0]))
        rows.append((i + 100, "noise", dom, [float(v) for v in rng.normal(size=2)]))
    df = spark.createDataFrame(rows, "id int, cls string, domain string, f array<double>")
    out = {r["cls"]: r for r in shift.format_probe(df, "cls", "domain", "id", "f", resamples=2, folds=3).collect()}
    assert out["easy"]["auc_mean"] == 1.0 and out["easy"]["n_auc_values"] == 6
    assert 0.2 < out["noise"]["auc_mean"] < 0.8


def bbse_df(spark, src, target_p0):
    rows = [("source", y, p, 1 - p) for y, p in src] + [("target", 0, target_p0, 1 - target_p0)] * 4
    return spark.createDataFrame(rows, "domain string, y_true int, p0 double, p1 double")


SRC = [(0, 0.9), (0, 0.9), (0, 0.9), (0, 0.1), (1, 0.1), (1, 0.1), (1, 0.1), (1, 0.9)]


def test_bbse_golden(spark):
    r = shift.bbse(bbse_df(spark, SRC, 0.65), "domain", reference_prior=0.5).first()
    assert r["target_prior0"] == pytest.approx(0.8) and r["prior_gap"] == pytest.approx(0.3)
    r = shift.bbse(bbse_df(spark, SRC, 0.95), "domain").first()
    assert r["target_prior0"] == 1.0 and r["negative_weights_clipped"]
    with pytest.raises(Exception, match="ill-conditioned"):
        shift.bbse(bbse_df(spark, [(0, 0.9), (1, 0.9)], 0.5), "domain").collect()
    with pytest.raises(Exception, match="no row of one class"):
        shift.bbse(bbse_df(spark, [(0, 0.9), (0, 0.1)], 0.5), "domain").collect()


def test_importance_weights_golden_and_grid(spark):
    row = dict(c00=0.5, c01=0.0, c10=0.0, c11=0.5, s0=0.5, s1=0.5, t0=1.0, t1=0.0)
    names = list(row)
    r = shift.solve_importance_weights(spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} double" for n in names))).first()
    assert (r["w0"], r["w1"]) == (pytest.approx(2.0), pytest.approx(0.0))
    rng = np.random.default_rng(6)
    cases = []
    for _ in range(20):
        s0 = rng.uniform(0.1, 0.9)
        c = rng.dirichlet(np.ones(4))
        t0 = rng.uniform(0, 1)
        cases.append((*[float(v) for v in c], float(s0), float(1 - s0), float(t0), float(1 - t0)))
    got = shift.solve_importance_weights(spark.createDataFrame(cases, ", ".join(f"{n} double" for n in names))).collect()
    for r in got:
        cm = np.array([[r["c00"], r["c01"]], [r["c10"], r["c11"]]])
        p, q = cm.T @ cm, -cm @ np.array([r["t0"], r["t1"]])
        grid = np.linspace(0, 1 / r["s0"], 20001)
        w = np.stack([grid, (1 - r["s0"] * grid) / r["s1"]])
        cost = 0.5 * np.einsum("in,ij,jn->n", w, p, w) + q @ w
        mine = np.array([r["w0"], r["w1"]])
        assert 0.5 * mine @ p @ mine + q @ mine <= cost.min() + 1e-9
    bad = spark.createDataFrame([(float("nan"), *list(row.values())[1:])], ", ".join(f"{n} double" for n in names))
    assert shift.solve_importance_weights(bad).first()["status"] == "skipped"


def test_ema_skips_missing_epochs(spark):
    df = spark.createDataFrame([("r", 2, None), ("r", 1, 3.0), ("r", 3, 0.0)], "run string, epoch int, w double")
    got = {r["epoch"]: r["ema"] for r in shift.ema_over_epochs(df, ["run"], "epoch", "w").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 1.0}


def test_domain_standardize_modes(spark):
    df = vec_df(spark, [0, 2], [10, 14])
    for mode, want in {"target": [-12 / 2, -10 / 2, -1, 1], "frozen": [-1, 1, 9, 13], "per_domain": [-1, 1, -1, 1]}.items():
        out = shift.domain_standardize(df, "domain", "f", mode, eps=0.0).orderBy("id").collect()
        assert [r["f"][0] for r in out] == pytest.approx(want)


def test_domain_means_of_far_off_features(spark):
    """Vector sums over tasks agree with the moments of all rows, also far from zero and for empty domains."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 6)) + 1e6
    rows = [("source" if i % 3 else "target", [float(v) for v in x[i]]) for i in range(500)]
    df = spark.createDataFrame(rows, "domain string, f array<double>").repartition(7)
    for r in shift.domain_means(df, "domain", "f").collect():
        mine = x[[i for i in range(500) if ("source" if i % 3 else "target") == r["domain"]], r["pos"]]
        assert r["n"] == len(mine) and r["mean"] == pytest.approx(mine.mean(), rel=1e-12) and r["var"] == pytest.approx(mine.var(), rel=1e-6)
    assert shift.domain_means(df.limit(0), "domain", "f").count() == 0


def test_mmd_does_not_depend_on_tiles(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(i, "source" if i % 2 else "target", [float(v) for v in rng.normal(size=4) + (i % 2) * 0.3]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, domain string, f array<double>")
    a, b = (shift.rbf_mmd2(df, "id", "domain", "f", block_rows=n).first() for n in (100_000, 200))
    assert a["mmd2"] == pytest.approx(b["mmd2"], rel=1e-9) and a["bandwidth"] == pytest.approx(b["bandwidth"], rel=1e-9)
    x = np.array([r[2] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(1500, 1)]
    assert a["bandwidth"] == pytest.approx(np.median(d), rel=1e-9)


def test_ema_over_batches_and_null_keys(spark):
    rows = [(k, e, None if e % 3 == 0 else float(e)) for k in (None, 1, 2) for e in range(1, 400)]
    df = spark.createDataFrame(rows, "run bigint, epoch int, v double").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r["run"], r["epoch"]): r["ema"] for r in shift.ema_over_epochs(df, ["run"], "epoch", "v", 0.9, 0.5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for k in (None, 1, 2):
        w = 0.5
        for e in range(1, 400):
            w = w if e % 3 == 0 else (1.0 - 0.9) * e + 0.9 * w
            assert got[k, e] == pytest.approx(w, rel=1e-12)
