"""Iterative fits, affine prefixes and rank maps: optimality, brute force, refusals and plan shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.operators import raster, shift, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_masked_fits_reach_every_optimum(spark):
    """Models of overlapping row sets, in two groups one of which is null, each against its own gradient."""
    rng = np.random.default_rng(3)
    n, sets, folds = 300, 3, 4
    x = rng.normal(size=(n, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=n) > 0).astype(int)
    group = [None if i % 3 == 0 else "a" for i in range(n)]
    masks = rng.integers(0, 1 << folds, size=(n, sets))
    masks[:, 2] = 0  # models without rows stay at zero
    rows = [(group[i], [float(v) for v in x[i]], int(y[i]), 1.0 + i % 2, [int(m) for m in masks[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, f array<double>, y int, w double, t array<bigint>").repartition(5)
    fits = vectors.masked_logistic_fits(df, "g", "f", "y", "w", "t", folds)
    assert set(fits) == {(g, s, k) for g in (None, "a") for s in range(sets) for k in range(folds)}
    design = np.column_stack([x, np.ones(n)])
    weight = np.array([1.0 + i % 2 for i in range(n)])
    for (g, s, k), beta in fits.items():
        own = np.array([group[i] == g and bool(masks[i, s] >> k & 1) for i in range(n)])
        p = 1 / (1 + np.exp(-design[own] @ beta))
        assert np.abs(beta + design[own].T @ (weight[own] * (p - y[own]))).max() < 1e-6
        assert own.any() or not beta.any()


def test_columns_and_arrays_give_one_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] > rng.normal(size=200)).astype(int)
    df = spark.createDataFrame([(int(t), [float(a), float(b)], float(a), float(b), 1.0) for t, (a, b) in zip(y, x)], "y int, f array<double>, a double, b double, w double")
    one, other = vectors.logistic_fits(df, [], "f", "y", "w")[(-1,)], vectors.logistic_fit_columns(df, ["a", "b"], "y", "w")
    assert one == pytest.approx(other, abs=1e-9)
    doubled = df.withColumn("k", F.lit(7)).unionByName(df.withColumn("k", F.lit(None).cast("int")))
    both = vectors.logistic_fits(doubled, ["k"], "f", "y", "w")
    assert set(both) == {(7, -1), (None, -1)} and all(b == pytest.approx(one, abs=1e-9) for b in both.values())
    with pytest.raises(RuntimeError):
        vectors.logistic_fit_columns(df, ["a", "b"], "y", "w", max_iter=1)


def test_a_newton_pass_multiplies_no_rows(spark, monkeypatch):
    """Below the Arrow step of every pass there is the checkpointed matrix alone: no generator, no exchange."""
    seen = []
    true = vectors.sum_vectors
    monkeypatch.setattr(vectors, "sum_vectors", lambda partials, keys: (seen.append(plan(partials)), true(partials, keys))[1])
    rng = np.random.default_rng(5)
    rows = [(i, "c", "source" if i % 2 else "target", [float(v) for v in rng.normal(size=3) + i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, cls string, domain string, f array<double>")
    out = shift.format_probe(df, "cls", "domain", "id", "f", resamples=3, folds=4).first()
    assert out["n_auc_values"] == 12 and seen
    assert all("Generate" not in p and "Exchange" not in p and "MapInPandas" in p for p in seen)


def test_format_probe_of_small_classes(spark):
    """Fewer rows than folds take fewer folds; a class with one row on a side has no AUC."""
    sides = {"few": (3, 9), "one": (1, 5), "none": (0, 4), "even": (4, 4)}
    rows, i = [], 0
    for cls, (a, b) in sides.items():
        for k in range(a + b):
            rows.append((i := i + 1, cls, "source" if k < a else "target", [float(k < a), float(k)]))
    df = spark.createDataFrame(rows, "id int, cls string, domain string, f array<double>")
    got = {r["cls"]: r for r in shift.format_probe(df, "cls", "domain", "id", "f", resamples=4).collect()}
    assert {c: (r["n_synthetic"], r["n_real"], r["n_balanced_per_domain"], r["folds_per_resample"], r["n_auc_values"]) for c, r in got.items()} == {
        "few": (3, 9, 3, 3, 12), "one": (1, 5, 1, 0, 0), "none": (0, 4, 0, 0, 0), "even": (4, 4, 4, 4, 16)}
    assert got["one"]["auc_mean"] is None and got["few"]["auc_mean"] == 1.0


def test_domains_are_two_and_known(spark):
    rows = [(i, "source" if i % 2 else "target", [float(i)]) for i in range(20)]
    make = lambda extra: spark.createDataFrame([*rows, *extra], "id int, domain string, f array<double>")
    with pytest.raises(ValueError):
        shift.proxy_a_distance(make([(90, "third", [1.0])]), "id", "domain", "f")
    with pytest.raises(Exception, match="without a domain"):
        shift.proxy_a_distance(make([(90, None, [1.0])]), "id", "domain", "f").collect()
    with pytest.raises(Exception, match="at least two rows"):
        shift.proxy_a_distance(spark.createDataFrame([r for r in rows if r[0] == 1 or r[0] % 2 == 0], "id int, domain string, f array<double>"), "id", "domain", "f").collect()
    told = shift.proxy_a_distance(make([]), "id", "domain", "f", seed=3).first()
    assert (told["n_source"], told["n_target"], told["seed"], told["holdout_fraction"]) == (10, 10, 3, 0.3)


@pytest.mark.parametrize("ma", [0.0, 0.5, 0.999, 1.0])
def test_ema_of_long_runs(spark, ma):
    """Arrays, arrays of arrays and a run over several blocks; negative epochs, gaps, nulls; no Python."""
    rng = np.random.default_rng(6)
    epochs = {"long": [*range(-700, 900), *range(70_000, 70_300), 200_000], "short": [5], None: [1, 2]}
    values = {(k, e): None if rng.random() < 0.3 else float(rng.normal()) for k, v in epochs.items() for e in v}
    df = spark.createDataFrame([(k, e, v, "x") for (k, e), v in values.items()], "run string, epoch int, w double, _array string").repartition(4)
    out = shift.ema_over_epochs(df, ["run"], "epoch", "w", ma, 0.25)
    assert out.columns == ["run", "epoch", "ema"] and "Python" not in plan(out) and "MapIn" not in plan(out)
    got = {(r["run"], r["epoch"]): r["ema"] for r in out.collect()}
    for k, own in epochs.items():
        w = 0.25
        for e in own:
            v = values[k, e]
            w = w if v is None else (1.0 - ma) * v + ma * w
            assert got[k, e] == pytest.approx(w, rel=1e-9, abs=1e-12)
    assert len(got) == len(values) and shift.ema_over_epochs(df.limit(0), ["run"], "epoch", "w").count() == 0
    pair = spark.createDataFrame([(1, 2, e, float(e)) for e in range(600)], "a int, b int, e bigint, v double")
    assert shift.ema_over_epochs(pair, ["a", "b"], "e", "v").count() == 600


def rank_map(values, ids, shape, loc, scale, mean, std):
    order = np.lexsort((ids, values))
    n = len(values)
    rank = np.empty(n)
    rank[order] = np.arange(1, n + 1)
    g = loc + scale * (-np.log(1 - (rank - 0.5) / n)) ** (1 / shape)
    return np.clip(np.round((g - g.mean()) / (g.std() if g.std() >= 1e-6 else 1.0) * std + mean), 0, 255)


def test_rank_map_with_mostly_one_value(spark, monkeypatch):
    """Nine pixels of ten are equal: no window holds more than TIED_IDS of them, and ranks are those of a full sort."""
    monkeypatch.setattr(raster, "TIED_IDS", 64)
    monkeypatch.setattr(raster, "RANK_CHUNK", 100)
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for image, n in ((1, 3000), (2, 500), (3, 500), (4, 1)):
        v = np.where(rng.random(n) < 0.9, 10.0, rng.integers(0, 256, n) / 4)
        ids = rng.permutation(n) + 10**9 * image
        rows += [(image, int(i), float(x)) for i, x in zip(ids, v)]
        want |= dict(zip(ids.tolist(), rank_map(v, ids, 1.8, 3.0, 40.0, 120.0, 30.0)))
    df = spark.createDataFrame(rows, "image_id int, pixel bigint, v double").repartition(6)
    out = raster.weibull_rank_map(df, ["image_id"], "v", "pixel", 1.8, 3.0, 40.0, 120.0, 30.0, 0.0, 64.0)
    assert out.columns == ["image_id", "pixel", "v", "grey"]
    assert {r["pixel"]: r["grey"] for r in out.collect()} == want
    windows = df.groupBy("image_id", "v", F.floor(F.col("pixel") / 64)).count().agg(F.max("count")).first()[0]
    assert windows <= 64
    whole = raster.weibull_rank_map(df.where("image_id = 2").drop("image_id"), [], "v", "pixel", 1.8, 3.0, 40.0, 120.0, 30.0, 0.0, 64.0)
    assert {r["pixel"]: r["grey"] for r in whole.collect()} == {i: g for i, g in want.items() if i // 10**9 == 2}


def test_mixture_of_every_image(spark):
    rng = np.random.default_rng(8)
    rows = [(image, int(np.clip(round(rng.normal(m + 5 * image, 4)), 0, 255))) for image in (0, 1) for m in (20, 120, 220) for _ in range(200)]
    rows += [(2, 7)] * 30 + [(None, 9), (None, 200)]
    df = spark.createDataFrame(rows, "image_id int, v int").repartition(3)
    out = raster.gmm_segment(df, "v", keys=["image_id"])
    assert out.columns == ["image_id", "v", "label"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["image_id"] in (0, 1):
            assert r["label"] == (0 if r["v"] < 72 else 1 if r["v"] < 172 else 2)
    assert len({r["label"] for r in got if r["image_id"] == 2}) == 1
    with pytest.raises(Exception, match="not a grey level"):
        raster.gmm_segment(spark.createDataFrame([(1.5,)], "v double"), "v").collect()
