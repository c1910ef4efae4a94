"""Roll-up rules with every state, verdicts, empty inputs; loose pairing without pairs."""

from gradeline.operators import bank, grid


def rules(df):
    return {r["check"]: (r["status"], r["value"]) for r in df.collect()}


def test_masks(spark):
    rows = [("ship", 10, 20, "bent")] * 9 + [("airplane", 30, 40, None)] * 2
    df = spark.createDataFrame(rows, "label string, w int, h int, damage string")
    got = rules(bank.mask_rollup(df, "label", {"ship": 10, "airplane": 10}, "w", "h", "damage", 40))
    assert got["count_ship"] == ("PASS", 9.0) and got["count_airplane"] == ("WARN", 2.0) and got["max_side"] == ("PASS", 40.0)
    assert got["verdict"] == ("PASS", 0.0) and got["damage_bent"] == ("INFO", 9.0) and got["damage_none"] == ("INFO", 2.0)
    assert (got["width_min"], got["height_max"], got["masks"]) == (("INFO", 10.0), ("INFO", 40.0), ("INFO", 11.0))
    large = rules(bank.mask_rollup(df, "label", {"ship": 10}, "w", "h", "damage", 39))
    assert large["max_side"] == ("FAIL", 40.0) and large["verdict"] == ("FAIL", 1.0)
    empty = rules(bank.mask_rollup(df.limit(0), "label", {"ship": 10}, "w", "h", "damage", 39))
    assert empty["max_side"] == ("FAIL", None) and empty["count_ship"] == ("WARN", 0.0) and empty["verdict"][0] == "FAIL"


def test_verdict_of_generated_items(spark):
    table = lambda *states: spark.createDataFrame([(str(i), s, 1.0) for i, s in enumerate(states)], "check string, status string, value double")
    assert rules(bank.with_verdict(table("PASS", "INFO")))["verdict"] == ("PASS", 0.0)
    assert rules(bank.with_verdict(table("WARN", "FAIL")))["verdict"] == ("FAIL", 2.0)
    assert rules(bank.with_verdict(table("WARN", "PASS"), ("FAIL",)))["verdict"] == ("PASS", 0.0)


def test_effective_sites(spark):
    rows = [("a", 1.0, 3), ("a", None, 3), ("b", float("nan"), 3), ("c", 2.0, 0), (None, 2.0, 1)]
    df = spark.createDataFrame(rows, "site string, hl_c double, hl_psd_size int")
    assert rules(bank.site_rollup(df, "site")) == {"usable_entries": ("INFO", 2.0), "effective_sites": ("INFO", 2.0), "site_a": ("INFO", 1.0), "site_none": ("INFO", 1.0)}
    assert rules(bank.site_rollup(df.limit(0), "site")) == {"usable_entries": ("INFO", 0.0), "effective_sites": ("INFO", 0.0)}


def test_loose_pairs_without_pairs(spark):
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0), ("y", 1, 1.0), ("z", 1, None)], "k string, seed int, v double")
    b = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.5), ("y", 1, 3.0), ("z", 1, 1.0), ("w", 9, 1.0)], "k string, seed int, v double")
    got = {r["k"]: (r["n_pairs"], r["used_seeds"], r["insufficient"], r["mean_difference"]) for r in grid.loose_pairs(a, b, ["k"], "seed", "v").collect()}
    assert got == {"x": (2, [1, 2], False, 1.0), "y": (1, [1], True, None), "z": (0, [], True, None), "w": (0, [], True, None)}
    alone = grid.loose_pairs(a.where("seed = 1 and k = 'x'").drop("k"), b.where("seed = 9").drop("k"), [], "seed", "v").first()
    assert (alone["n_pairs"], alone["used_seeds"], alone["insufficient"], alone["mean_difference"]) == (0, [], True, None)
