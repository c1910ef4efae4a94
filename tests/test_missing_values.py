"""Null and foreign domains and predictions are refused; approximate quantiles against the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.operators import health, running, shift


def features(spark, extra=()):
    rows = [(i, "source" if i % 2 else "target", [float(i), float(i % 3)]) for i in range(20)]
    return spark.createDataFrame([*rows, *extra], "id int, domain string, f array<double>")


def test_mmd_refuses_other_domains(spark):
    for extra in ([(90, None, [1.0, 2.0])], [(90, "third", [1.0, 2.0])]):
        with pytest.raises(ValueError):
            shift.rbf_mmd2(features(spark, extra), "id", "domain", "f", bandwidth=1.0)
    with pytest.raises(ValueError):
        shift.rbf_mmd2(features(spark).where("domain = 'source' or id = 0"), "id", "domain", "f", bandwidth=1.0)
    for bandwidth in (float("inf"), float("nan"), 0.0, -1.0):
        with pytest.raises(ValueError):
            shift.rbf_mmd2(features(spark), "id", "domain", "f", bandwidth=bandwidth)
    assert shift.rbf_mmd2(features(spark), "id", "domain", "f", bandwidth=1.0).first()["mmd2"] is not None


def test_no_row_is_lost_in_standardising(spark):
    df = features(spark, [(90, None, [1.0, 2.0])])
    with pytest.raises(Exception, match="without a domain"):
        shift.domain_standardize(df, "domain", "f", "per_domain").collect()
    assert shift.domain_standardize(df, "domain", "f", "target").count() == 21
    assert shift.domain_standardize(features(spark), "domain", "f", "per_domain").count() == 20


@pytest.mark.parametrize("foreign", [None, 2, -1])
def test_collapse_refuses_foreign_predictions(spark, foreign):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", foreign), ("b", 1)], "run string, y_pred int")
    with pytest.raises(Exception, match="1 predictions are neither"):
        health.collapse_from_predictions(df, ["run"]).collect()
    assert health.collapse_from_predictions(df.where("run = 'a'"), ["run"]).count() == 1


def test_approximate_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=20_000), "b": rng.exponential(size=5_000), "c": np.array([3.0])}
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [("a", None), ("a", float("nan")), ("b", float("inf")), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    points = {"low": 0.01, "mid": 0.5, "high": 0.99}
    exact = {r["k"]: r for r in running.quantiles(df, ["k"], "v", points).collect()}
    got = {r["k"]: r for r in running.approx_quantiles(df, ["k"], "v", points).collect()}
    assert set(got) == set(exact) == set(values)
    for k, own in values.items():
        assert got[k]["n"] == exact[k]["n"] == len(own)
        for name, q in points.items():
            assert got[k][name] in own and abs((own <= got[k][name]).mean() - q) <= 0.012 + 1 / len(own)
    assert {r["k"]: (r["n_left_out"], r["n"]) for r in running.left_out(df, ["k"], "v").collect()} == {"a": (2, 20_000), "b": (1, 5_000), "c": (0, 1), "d": (1, 0)}
    plan = running.approx_quantiles(df, ["k"], "v", points)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Window" not in plan
    assert running.approx_quantiles(df.limit(0), [], "v", points).count() == 0
