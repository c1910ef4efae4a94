"""Golden values of pairing, t tests and multiplicity correction."""

import math

import pytest
from pyspark.sql import functions as F

from gradeline.functions.student import critical_value, two_sided_p
from gradeline.operators import grid, inference


def one(spark, values, confidence=0.95):
    df = spark.createDataFrame([("g", float(v)) for v in values], "k string, difference double")
    return inference.paired_t(df, ["k"], confidence=confidence).first()


def test_paired_t_golden(spark):
    r = one(spark, [0.1, 0.2, 0.3, 0.4, 0.5])
    assert r["sample_sd"] == pytest.approx(0.158113883, abs=1e-9)
    assert r["t_statistic"] == pytest.approx(4.242640687119285, rel=1e-12)
    assert r["p_value"] == pytest.approx(0.0132355995636827, rel=1e-12)
    assert (r["ci_lo"], r["ci_hi"]) == (pytest.approx(0.1036756838, abs=1e-9), pytest.approx(0.4963243161, abs=1e-9))


def test_paired_t_degenerate(spark):
    r = one(spark, [0, 0, 0, 0, 0])
    assert (r["t_statistic"], r["p_value"], r["ci_lo"], r["ci_hi"]) == (0.0, 1.0, 0.0, 0.0)
    r = one(spark, [-0.25] * 5)
    assert (r["t_statistic"], r["p_value"], r["ci_lo"]) == (-math.inf, 0.0, -0.25)
    r = one(spark, [0.1] * 3)  # 0.1 has no exact binary form, the spread is still exactly zero
    assert r["sample_sd"] == 0.0 and r["t_statistic"] == math.inf
    assert one(spark, [0.5])["insufficient"]


def _p_reference(t, df):
    """Simpson integration of the density, substituting x = sqrt(df) tan(theta)."""
    const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    lo, hi, n = math.atan(t / math.sqrt(df)), math.pi / 2, 4000
    h = (hi - lo) / n
    f = lambda a: max(math.cos(a), 0.0) ** (df - 1)
    s = f(lo) + f(hi) + sum((4 if i % 2 else 2) * f(lo + i * h) for i in range(1, n))
    return 2 * const * s * h / 3


@pytest.mark.parametrize("df", [1, 2, 3, 4, 5, 11, 24, 63, 250])
def test_student_p_matches_integration(spark, df):
    ts = [0.0, 0.3, 1.0, 2.0, 4.5, 9.0]
    rows = spark.createDataFrame([(t, df) for t in ts], "t double, d int").withColumn("p", two_sided_p("t", "d")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(_p_reference(r["t"], df), rel=1e-7, abs=1e-300), (r["t"], df)


def test_student_tail_keeps_relative_accuracy(spark):
    r = spark.createDataFrame([(100.0, 4)], "t double, d int").select(two_sided_p("t", "d").alias("p")).first()
    # closed form for df = 4: p = 6/t^4 - 40/t^6 + O(t^-8)
    assert r["p"] == pytest.approx(6e-8 - 4e-11 + 2.1e-13, rel=1e-6)


def test_critical_values(spark):
    df = spark.createDataFrame([(4,), (11,), (1,)], "d int").select("d", critical_value(0.95, "d").alias("t"))
    got = {r["d"]: r["t"] for r in df.collect()}
    assert got[4] == pytest.approx(2.7764451051977987, rel=1e-12)
    assert got[11] == pytest.approx(2.2009851600916399, rel=1e-13)  # 50-digit evaluation
    assert got[11] == pytest.approx(2.200985160082949, rel=1e-11)  # the commonly quoted table value
    assert got[1] == pytest.approx(12.706204736174694, rel=1e-11)


P = [0.041, 0.008, 0.2, 0.008, 0.029]


@pytest.fixture(scope="module")
def family(spark):
    return spark.createDataFrame([("f", i, p) for i, p in enumerate(P)], "family string, i int, p_value double")


def test_holm_and_bh_golden(family):
    holm = {r["i"]: r["holm_p"] for r in inference.holm(family, ["family"], order=["i"]).collect()}
    assert [holm[i] for i in range(5)] == pytest.approx([0.087, 0.04, 0.2, 0.04, 0.087])
    bh = {r["i"]: r["bh_p"] for r in inference.benjamini_hochberg(family, ["family"], order=["i"]).collect()}
    assert [bh[i] for i in range(5)] == pytest.approx([0.05125, 0.02, 0.2, 0.02, 29 / 600])


def test_small_family_form_agrees(family):
    a = {r["i"]: (r["holm_p"], r["bh_p"]) for r in inference.adjust_small_families(family, ["family"], order=["i"]).collect()}
    holm = {r["i"]: r["holm_p"] for r in inference.holm(family, ["family"], order=["i"]).collect()}
    bh = {r["i"]: r["bh_p"] for r in inference.benjamini_hochberg(family, ["family"], order=["i"]).collect()}
    assert a == {i: (holm[i], bh[i]) for i in a}


def test_tiny_p_values_keep_their_order(spark):
    ps = [1e-300, 1e-200, 0.0, 1e-18, 1e-17, 0.5, 1.0]
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "family string, i int, p_value double")
    got = {r["i"]: r["holm_p"] for r in inference.holm(df, ["family"], order=["i"]).collect()}
    m, running = len(ps), 0.0
    for k, i in enumerate(sorted(range(m), key=lambda j: (ps[j], j))):
        running = max(running, (m - k) * ps[i])
        assert got[i] == min(1.0, running)


def test_pairing_ignores_row_order(spark):
    a = spark.createDataFrame([(3, 0.5), (1, 0.25), (2, 1.0)], "seed int, v double")
    b = spark.createDataFrame([(1, 0.125), (2, 0.5), (3, 0.25)], "seed int, v double")
    out = {r["seed"]: r["difference"] for r in grid.pair_runs(a, b, [], "seed", "v").collect()}
    assert out == {1: 0.125, 2: 0.5, 3: 0.25}
    with pytest.raises(Exception, match="seed sets differ"):
        grid.pair_runs(a.where("seed < 3"), b, [], "seed", "v").collect()
    assert grid.pair_runs(a.where("seed < 3"), b, [], "seed", "v", strict=False).count() == 2


def test_fold_mean_keeps_collapsed_folds(spark):
    rows = [("a", 0, f, 1.0 if f < 4 else 0.0, f == 4) for f in range(5)]
    df = spark.createDataFrame(rows, "arm string, seed int, fold int, v double, c boolean")
    r = grid.aggregate_folds(df, ["arm", "seed"], "fold", "v", range(5), "c").first()
    assert r["mean"] == 0.8 and r["collapsed_folds"] == [4] and r["n_folds"] == 5
    for broken in (df.where("fold <> 2"), df.unionByName(df.where("fold = 2"))):
        with pytest.raises(Exception, match="invalid folds"):
            grid.aggregate_folds(broken, ["arm", "seed"], "fold", "v", range(5)).collect()


def test_pair_long_needs_complete_reference(spark):
    schema = "arm_id string, points array<struct<seed: int, values: map<string, double>>>"
    arms = spark.createDataFrame([("ref", [(0, {"m": 1.0})]), ("x", [(0, {"m": 3.0}), (1, {"m": 4.0})])], schema)
    with pytest.raises(Exception, match="incomplete"):
        grid.pair_long(arms, "ref").collect()


def test_bootstrap_is_deterministic_and_close_to_t(spark):
    df = spark.createDataFrame([("g", s, 0.1 * (s + 1)) for s in range(12)], "k string, seed int, difference double")
    a = inference.bootstrap_paired_ci(df, ["k"], n_boot=2000).first()
    b = inference.bootstrap_paired_ci(df.repartition(5).orderBy(F.desc("seed")), ["k"], n_boot=2000).first()
    assert a == b and a["n_boot"] == 2000
    both = inference.paired_t(df, ["k"]).join(inference.bootstrap_paired_ci(df, ["k"], n_boot=2000), "k")
    assert inference.ci_agreement(both).first()["consistent"]


def test_decide_and_effect(spark):
    df = spark.createDataFrame([("up", 0.1, 0.3, 0.2, 0.05), ("flat", -0.1, 0.3, 0.1, 0.0)], "k string, ci_lo double, ci_hi double, mean_difference double, standard_error double")
    got = {r["k"]: r for r in inference.effect_over_se(inference.decide(df)).collect()}
    assert got["up"]["verdict"] == "EFFECTIVE" and got["up"]["direction"] == "improve" and got["up"]["effect_over_se"] == pytest.approx(4.0)
    assert got["flat"]["verdict"] == "INCONCLUSIVE" and got["flat"]["direction"] == "n/a" and got["flat"]["effect_over_se"] == math.inf


# Macro F1 per seed 0..11 of two arms, and the published result of their comparison.
ARM_0 = [0.3091155473294553, 0.5499799717496258, 0.36592956592956594, 0.4649735449735449, 0.5383449505592479, 0.35325538766742737,
         0.27771724862168545, 0.15918532213731434, 0.22601700457815566, 0.3967550400441867, 0.41121310199678107, 0.20252121449943594]
ARM_2 = [0.535385983987348, 0.6210021321961621, 0.4943906296332905, 0.6025368480725624, 0.5758311551896818, 0.5169094442935066,
         0.6094632768361582, 0.5773531777956558, 0.4561341571050309, 0.5885919856508092, 0.517141544117647, 0.48552003816793887]
DELTA, LOW, HIGH = 0.193771039413280, 0.123311926195007, 0.264230152631554


def test_published_comparison_of_two_arms(spark):
    side = lambda values: spark.createDataFrame([("macro_f1", s, v) for s, v in enumerate(values)], "metric string, seed int, value double")
    pairs = grid.pair_runs(side(ARM_2), side(ARM_0), ["metric"], "seed", "value")
    r = inference.paired_t(pairs, ["metric"]).first()
    assert (r["n"], r["mean_difference"]) == (12, pytest.approx(DELTA, rel=1e-9))
    assert (r["ci_lo"], r["ci_hi"]) == (pytest.approx(LOW, rel=1e-9), pytest.approx(HIGH, rel=1e-9))
