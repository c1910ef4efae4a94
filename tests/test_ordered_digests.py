"""Sequential digests as streams: bytes, nulls, hot keys and memory."""

import hashlib

from pyspark.sql import functions as F

from gradeline.functions import digests


def signature(names):
    h = hashlib.sha256()
    for n in sorted(names, key=str.encode):
        h.update(len(n.encode()).to_bytes(4, "big") + n.encode())
    return h.hexdigest()


def test_keys_nulls_and_many_chunks(spark, monkeypatch):
    """Chunks of a few bytes; null keys, null names, a key with null names only, two key columns, none at all."""
    monkeypatch.setattr(digests, "CHUNK_BYTES", 20)
    names = {("a", 1): [f"é{i}" for i in range(300)] + [None], ("a", 2): ["x", "x", ""], (None, 1): ["z"], ("b", None): [None, None]}
    rows = [(*k, n, "extra") for k, v in names.items() for n in v]
    df = spark.createDataFrame(rows, "g string, h int, name string, _entry string").repartition(7)
    got = {(r["g"], r["h"]): (r["signature"], r["n_names"]) for r in digests.name_set_signature(df, ["g", "h"], "name").collect()}
    assert got == {k: (signature([n for n in v if n is not None]), len(v)) for k, v in names.items()}
    every = digests.name_set_signature(df, [], "name").collect()
    assert [(r["signature"], r["n_names"]) for r in every] == [(signature([r[2] for r in rows if r[2] is not None]), len(rows))]
    assert digests.name_set_signature(df.limit(0), ["g"], "name").count() == 0


def test_manifest_order_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(digests, "CHUNK_BYTES", 30)
    rows = [(k, c, n, f"d{n}") for k in (1, 2) for c in ("ship", "airplane") for n in (10, 9, 100, 1)] + [(1, "ship", None, "q"), (2, None, 5, "q")]
    df = spark.createDataFrame(rows, "k int, c string, n int, d string").repartition(5)
    got = {r["k"]: (r["fingerprint"], r["n_entries"]) for r in digests.manifest_fingerprint(df, ["k"], "c", "n", "d").collect()}
    for k in (1, 2):
        lines = sorted((c, str(n), d) for q, c, n, d in rows if q == k and c and n is not None)
        assert got[k] == (hashlib.md5("|".join(f"{c}/{n}:{d}" for c, n, d in lines).encode()).hexdigest(), 9)


def test_a_folder_of_a_million_names(spark):
    """One key holds nearly all names; nothing gathers them: no collected list, no row above a chunk."""
    df = spark.range(1_000_000).select(F.when(F.col("id") % 1000 == 0, "small").otherwise("large").alias("g"), F.concat(F.lit("img_"), F.lpad("id", 7, "0")).alias("name"))
    out = digests.name_set_signature(df, ["g"], "name")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("MapInArrow") == 2
    got = {r["g"]: (r["signature"], r["n_names"]) for r in out.collect()}
    assert got["large"] == (signature([f"img_{i:07d}" for i in range(1_000_000) if i % 1000]), 999_000) and got["small"][1] == 1000
