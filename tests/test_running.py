"""Distributed running folds against plain sequential results."""

import random

import pytest
from pyspark.sql import functions as F

from gradeline.operators import running


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, values repeat and span many magnitudes."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("ab"), i, rng.choice([0.0, -1.5, 1e-9, 3.25, 1e12]) * rng.randint(1, 5)) for i in range(600)]
    return spark.createDataFrame(rows, "k string, i bigint, v double"), rows


def test_numbering_by_id_and_hash_is_dense(skewed):
    df, rows = skewed
    for out in (running.number_by_id(df, ["k"], "i", width=16), running.number_by_hash(df, ["k"], 3, "i")):
        got = out.groupBy("k").agg(F.sort_array(F.collect_list("rn")).alias("rn")).collect()
        for r in got:
            assert r["rn"] == list(range(1, sum(x[0] == r["k"] for x in rows) + 1))


def test_two_bucket_levels_keep_order(skewed):
    df, rows = skewed
    got = {r["i"]: r["rn"] for r in running.number_by_id(df, ["k"], "i", width=4).collect()}
    seen: dict = {}
    for k, i, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]


def test_value_bucket_is_monotone(spark):
    values = sorted([0.0, -0.0, 1e-300, 5e-10, 1.0, 2.0, 4.0, 1 - 2**-53, 2 - 2**-52, 4 + 2**-50, 7.999999999999999, 8.0, 1e200, -3.0, -1e-9, -1e30])
    values = sorted(values + [1.7e9 + i for i in range(0, 5000, 61)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    coarse, fine = running.value_buckets(F.col("v"))
    pairs = [(r["c"], r["f"]) for r in df.select("i", coarse.alias("c"), fine.alias("f")).orderBy("i").collect()]
    assert pairs == sorted(pairs)
    assert len({f for _, f in pairs}) > 80  # crowded values separate


def test_quantiles_match_linear_interpolation(skewed):
    np = pytest.importorskip("numpy")
    df, rows = skewed
    points = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q97": 0.975, "q100": 1.0}
    for r in running.quantiles(df, ["k"], "v", points).collect():
        mine = [v for k, _, v in rows if k == r["k"]]
        for name, q in points.items():
            assert r[name] == pytest.approx(float(np.quantile(mine, q)), rel=1e-12, abs=1e-300)
        assert r["n"] == len(mine)


def test_no_task_holds_a_whole_group(skewed):
    """The plan never orders a window by the group key alone."""
    df, _ = skewed
    plan = running.number_by_hash(df, ["k"], 3, "i")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_bucket" in line for line in windows)


def test_no_registered_operator_plans_a_cross_join(spark, sf_dir):
    """Summaries arrive as scalar subqueries and fan-outs as generators, never as products of tables."""
    from gradeline.plans import catalog

    for name in ("stratified_metrics", "threshold_sweep", "round_robin_assign", "draw_pairs", "weighted_draw", "grid_complete",
                 "class_weights_inverse", "align_labels", "block_pool_summary", "comparison_blocks", "bootstrap_paired_ci"):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_checkpoint_mean_needs_no_exchange_of_predictions(spark, sf_dir):
    """Only the narrow orders table is shuffled; the 125-fold predictions are averaged in place."""
    from gradeline.plans import scoring

    plan = scoring.averaged(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_run_metrics_reads_predictions_once(spark, sf_dir):
    """Both branches of the running totals share the exchange of the distinct-score table."""
    from gradeline.operators import ranking
    from gradeline.plans import scoring

    df = ranking.run_metrics(scoring.averaged(spark, sf_dir), scoring.RUN)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan[: plan.index("Initial Plan")]


def test_numbers_of_ids_spread_over_all_longs(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("i"))
    got = {r["i"]: r["rn"] for r in running.number_by_id(df, [], "i").collect()}
    assert got == {v: k + 1 for k, v in enumerate(sorted(r["i"] for r in df.collect()))}
    outer = df.select(F.shiftright(F.floor(F.col("i") / F.lit(1 << 18)).cast("bigint"), 30).alias("b")).agg(F.min("b"), F.max("b")).first()
    assert outer[1] - outer[0] < 1 << 16


def test_group_stats_reach_every_row(spark, monkeypatch):
    """Null keys keep their rows; above the bound the join is planned without a hint and gives the same rows."""
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5)], "k string, v int")
    stats = df.groupBy("k").agg(F.sum("v").alias("s"))
    want = [("None", 1, 3), ("None", 2, 3), ("a", 3, 3), ("b", 4, 9), ("b", 5, 9)]
    for bound in (running.SMALL_ROWS, 1):
        monkeypatch.setattr(running, "SMALL_ROWS", bound)
        out = running.with_group_stats(df, stats, ["k"])
        assert sorted((str(r["k"]), r["v"], r["s"]) for r in out.collect()) == want and out.columns == ["k", "v", "s"]
