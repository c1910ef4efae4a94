"""No row, run, image or comparison is lost silently: it is returned, or the job stops."""

import pytest

from gradeline.operators import grid, health, inference, metrics, raster, running, splits
from gradeline.sources import writers


def stops(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_running_folds_refuse_nulls(spark):
    df = spark.createDataFrame([("a", 1, 1), (None, 2, 1)], "k string, id long, v long")
    stops(running.number_by_id(df, ["k"], "id"), "null in k")
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 1)], "k string, id long, v long")
    stops(running.number_by_id(df, ["k"], "id"), "null in _bucket")


@pytest.mark.parametrize("p", [1.7, float("nan"), None, -0.1])
@pytest.mark.parametrize("adjust", [inference.holm, inference.benjamini_hochberg])
def test_corrections_refuse_invalid_p(spark, p, adjust):
    stops(adjust(spark.createDataFrame([("f", 0.1), ("f", p)], "family string, p_value double"), ["family"]), "invalid p-value")


def test_corrections_with_ties(spark):
    p = [0.01, 0.02, 0.02, 0.02, 1.0, 1.0]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, i int, p_value double")
    holm = {r["i"]: r["holm_p"] for r in inference.holm(df, ["family"]).collect()}
    bh = {r["i"]: r["bh_p"] for r in inference.benjamini_hochberg(df, ["family"]).collect()}
    assert [round(holm[i], 9) for i in range(6)] == [0.06, 0.1, 0.1, 0.1, 1.0, 1.0]
    assert [round(bh[i], 9) for i in range(6)] == [0.03, 0.03, 0.03, 0.03, 1.0, 1.0]


def test_insufficient_rows_stay_out_of_their_family(spark):
    df = spark.createDataFrame([("f", 0, 0.01), ("f", 1, 0.04), ("f", 2, None)], "family string, i int, p_value double")
    got = {r["i"]: (r["holm_p"], r["bh_p"]) for r in inference.adjust_small_families(df, ["family"]).collect()}
    assert got == {0: (0.02, 0.02), 1: (0.04, 0.04), 2: (None, None)}


def _means(spark, rows):
    return spark.createDataFrame(rows, "arm int, seed int, metric string, value double")


def test_compare_arms_refuses_unequal_seeds(spark):
    full = [(a, s, "m", 0.1 * a + 0.01 * s * s) for a in (0, 1) for s in range(3)]
    assert inference.compare_arms(_means(spark, full), "arm", 0, "seed", "metric", "value", ["m"], seeds=range(3)).count() == 2
    stops(inference.compare_arms(_means(spark, full[:-1]), "arm", 0, "seed", "metric", "value", ["m"]), "seed sets differ")
    stops(inference.compare_arms(_means(spark, full[1:]), "arm", 0, "seed", "metric", "value", ["m"]), "lacks seed")
    stops(inference.compare_arms(_means(spark, full), "arm", 0, "seed", "metric", "value", ["m"], seeds=range(4)), "seed sets differ")


def test_declared_comparison_without_pairs(spark):
    block = [{"name": "b", "x": 0, "y": 9, "primary": ["m"], "secondary": []}]
    row = inference.comparison_blocks(_means(spark, [(0, s, "m", 0.5) for s in range(3)]), block, "arm", "seed", "metric", "value").first()
    assert (row["n"], row["insufficient"], row["effect_over_se"], row["verdict"]) == (0, True, None, "INCONCLUSIVE")


def test_collapse_enrich_refuses_a_lost_run(spark):
    last_k = spark.createDataFrame([(1, 5, 5), (2, 5, 5)], "run int, n0 int, n1 int")
    epochs = spark.createDataFrame([(1, 0, 5, 5)], "run int, epoch int, n0 int, n1 int")
    stops(health.collapse_enrich(last_k, epochs, ["run"]), "disagree on the number")


def test_image_without_a_gap(spark):
    df = spark.createDataFrame([(1, x, 1.0) for x in range(5)] + [(2, x, float(x != 2)) for x in range(5)], "image int, x int, v double")
    got = {r["image"]: r["gap_left"] for r in raster.widest_gap(df, "image", "x", "v").collect()}
    assert got == {1: None, 2: 2}


def test_slots_outside_the_matrix(spark):
    stops(writers.churn_matrix(spark.createDataFrame([(1, 7, 0)], "epoch int, slot int, pred int"), ["epoch"], "slot", "pred", 5), "slot outside")


def test_gates(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, float("nan"))], "run int, epoch int, f1 double")
    with pytest.raises(PermissionError):
        health.oracle_best_epoch(df, ["run"], "epoch", ["f1"], authorized=True, reason=" ")
    with pytest.raises(PermissionError):
        metrics.threshold_sweep(df, ["run"], [0.5], authorized=False, reason="x")
    stops(health.oracle_best_epoch(df, ["run"], "epoch", ["f1"], authorized=True, reason="test"), "not finite")
    twice = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.6)], "run int, epoch int, f1 double")
    stops(health.oracle_best_epoch(twice, ["run"], "epoch", ["f1"], authorized=True, reason="test"), "twice")


def test_strict_pairing(spark):
    df = _means(spark, [(1, 0, "m", 0.5)])
    assert grid.pair_against(df, "arm", 0, ["metric"], "seed", "value").count() == 0
    stops(grid.pair_against(df, "arm", 0, ["metric"], "seed", "value", strict=True), "lacks seed")


def test_tied_tags_enter_once(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", 5, "z"), (None, None, "w")]
    df = spark.createDataFrame(rows, "g string, tag int, v string")
    three = splits.representative_sample(df, ["g"], "tag", 3).collect()
    assert sorted(str(r["g"]) for r in three) == ["None", "a", "b"]
    whole = splits.representative_sample(df, ["g"], "tag", 9).collect()
    assert sorted(map(str, map(tuple, whole))) == sorted(map(str, rows))


@pytest.mark.parametrize("value", [256.0, -1.0, 3.5, None])
def test_what_is_no_grey_level_is_refused(spark, value):
    df = spark.createDataFrame([("g", float(v)) for v in range(1, 80)] + [("g", value)], "g string, v double")
    for fn in (raster.weibull_fit_by_group, raster.otsu_by_group):
        with pytest.raises(Exception, match="not a grey level"):
            fn(df, ["g"], "v").collect()


def test_an_unset_shared_folder_on_a_local_master(monkeypatch):
    from types import SimpleNamespace

    from gradeline import session

    held = {}
    context = SimpleNamespace(
        getConf=lambda: {}, master="local[2]", getCheckpointDir=lambda: held.get("dir"), setCheckpointDir=lambda d: held.update(dir=d))
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    assert session.shared_dir(spark) == session.shared_dir(spark) == held["dir"]
    held.clear()
    context.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="shared by all executors"):
        session.shared_dir(spark)


def test_json_numbers_are_numbers_and_nan_is_refused_at_any_depth(spark, tmp_path):
    kind = "a double, b array<double>, c struct<d:float,e:map<string,double>>, f string"
    inf, nan = float("inf"), float("nan")
    writers.write_strict_json(spark.createDataFrame([(0.5, [1.5, inf, None], (2.0, {"k": -inf}), "x"), (None, None, None, None)], kind).coalesce(1), str(tmp_path / "a"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert lines[0] == '{"a":0.5,"b":[1.5,"Infinity",null],"c":{"d":2.0,"e":{"k":"-Infinity"}},"f":"x"}'
    for i, row in enumerate([(nan, [], None, "x"), (1.0, [1.0, nan], None, "x"), (1.0, [], (nan, {}), "x"), (1.0, [], (1.0, {"k": nan}), "x")]):
        with pytest.raises(Exception, match="refusing to write NaN"):
            writers.write_strict_json(spark.createDataFrame([row], kind), str(tmp_path / f"b{i}"))
