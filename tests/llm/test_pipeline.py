"""The pipeline against brute force, stage by stage."""

import corpus_pipeline
import brute
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradeline.llm import quality, queries


def test_stages(spark, small_dir, documents):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    text = dict(documents)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "secrets", "packing"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    one = corpus_pipeline.quality_stage(spark, docs, small_dir)
    assert one.columns == docs.columns
    first = ids(one)
    assert first == {i for i in text if not brute.quality(text[i])[-1]} & first and len(first) > 0.6 * len(text)

    two = corpus_pipeline.exact_stage(spark, one, small_dir)
    exact = brute.exact([(i, text[i]) for i in first])
    assert two.columns == docs.columns and ids(two) == {i for i, r in exact.items() if r[2]}

    three = corpus_pipeline.near_stage(spark, two, small_dir)
    near = brute.near({i: text[i] for i in ids(two)})
    assert three.columns == docs.columns and ids(three) == {i for i, r in near.items() if r[2]}

    four = corpus_pipeline.secret_stage(spark, three, small_dir)
    assert four.schema == docs.schema and ids(four) == ids(three)
    changed = 0
    for r in four.collect():
        assert r["n_chars"] == len(r["text"])
        changed += r["text"] != text[r["doc_id"]]
        assert brute.secret(r["text"])[:3] == (0, 0, 0) or r["text"] == text[r["doc_id"]]
    five = corpus_pipeline.packing_stage(spark, four, small_dir)
    tokens = {r["doc_id"]: r["n"] for r in five.groupBy("doc_id").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "n").collect()}
    library = Tokenizer.from_file(queries.tokenizer_path())
    assert tokens == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in four.collect()}


def test_run(spark, small_dir):
    out = corpus_pipeline.run(spark, small_dir)
    assert out.columns == ["doc_id", "piece", "start_token", "n_tokens", "bucket_tokens", "batch"]
    assert 0 < out.select("doc_id").distinct().count()


def test_nulls_and_clashing_names(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, "word " * 60, "en", "s", 300)] + [
        (i, " ".join(f"w{k}x{i % 7}" for k in range(60)), "en", None, 1) for i in range(3, 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in docs.collect()} == set(range(3, 10))
    assert quality.BASE_RULES == ("few_words", "repeated_words")
    again = spark.createDataFrame([], docs.schema)
    empty = again
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_rows_that_share_an_id(spark):
    """One id on a copy and on a text of its own, copies without ids, rows repeated with one id."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    near = text(1).replace("w1x79", "other")
    rows = [
        (5, text(1)), (7, text(1)), (7, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (8, text(5)), (8, text(5)),
        (9, near), (9, text(6)), (3, None), (3, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string")
    some = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    one = corpus_pipeline.exact_stage(spark, docs, "")
    assert one.columns == docs.columns
    want = [(5, text(1)), (7, text(2)), (None, text(3)), (None, text(4)), (8, text(5)), (9, near), (9, text(6)), (3, None)]
    assert some(one) == sorted(want, key=str)

    two = corpus_pipeline.near_stage(spark, docs, "")
    want = [(5, text(1)), (7, text(2)), (None, text(3)), (None, text(4)), (8, text(5)), (9, text(6)), (3, None), (4, "")]
    assert two.columns == docs.columns and some(two) == sorted(want, key=str)

    secret = docs.withColumn("text", F.when(F.col("doc_id") == 7, F.concat(F.lit("password=Zx81kq77 "), "text")).otherwise(F.col("text")))
    three = corpus_pipeline.secret_stage(spark, secret, "")
    assert three.columns == docs.columns and three.count() == len(rows)
    assert {r["text"].split(" ")[0] for r in three.where("doc_id = 7").collect()} == {corpus_pipeline.MARK}


def test_quality_stage_keeps_what_no_rule_rejects(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_stage(spark, docs, small_dir).collect()}
    report = quality.quality_report(docs.select(F.col("doc_id").alias("sample_id"), F.col("text").alias("content")))
    assert kept == {r["sample_id"] for r in report.where("kept").collect()}
