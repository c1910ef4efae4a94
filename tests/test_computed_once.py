"""The arms of a pairing are computed once."""

from pyspark.sql import functions as F

from gradeline.operators import grid


def test_pair_long_computes_its_arms_once(spark):
    points = F.array(*[F.struct(F.lit(s).alias("seed"), F.create_map(F.lit("m"), F.col("id") + F.lit(s / 4)).alias("values")) for s in (0, 1)])
    arms = spark.range(3).select(F.concat(F.lit("arm"), "id").alias("arm_id"), points.alias("points"))
    out = grid.pair_long(arms, "arm0")
    assert "Range (" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["arm_id"], r["seed"], r["value"], r["ref_value"], r["difference"]) for r in out.collect())
    assert got == [(f"arm{i}", s, i + s / 4, s / 4, float(i)) for i in (1, 2) for s in (0, 1)]
