"""The numbered operators over the table `documents`: a document is an evidence record.

Each query maps doc_id, text and source to a record's sample_id, content and domain, and the
operator's results back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, exact_dedup, filter_audit, licences, log_trie, near_dedup, packing, passages, pii, quality, secrets, sharding, spans, sql,
    token_counts)
from .records import settled

#: Tokens of the context that `op13_token_counts` asks about.
TOKEN_LIMIT = 1024
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def evidence(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("content"), F.col("source").alias("domain"),
        F.concat_ws("/", "source", "lang").alias("filepath"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("sample_id", "doc_id")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


@registered
def op1_pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(packing.pack_texts(_records(spark, sf_dir), tokenizer_path()))


@registered
def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(near_dedup.near_copies(_records(spark, sf_dir)))


@registered
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_records(spark, sf_dir))
    every = F.concat("base", "added")
    return _named(found.select(
        "sample_id", *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        _digest(spans.ordered(F.col("base"), secrets.KINDS, False)).alias("base_sha256"),
        spans.ordered(every, secrets.KINDS, False).alias("spans"),
        F.size("owner_specific").cast("bigint").alias("n_owner_specific"), F.size("widely_copied").cast("bigint").alias("n_widely_copied"),
        F.size("live_credentials").cast("bigint").alias("live_count")))


@registered
def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(bpe.encode_digests(_records(spark, sf_dir), tokenizer_path()))


@registered
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(quality.quality_report(_records(spark, sf_dir)))


@registered
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(sharding.assign_shards(_records(spark, sf_dir), sql.SHARD_BYTES))


@registered
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(_records(spark, sf_dir)).drop("expressions")
    return _named(found.withColumns({c: F.array_join(c, ",") for c in ("needed_terms", "chosen_terms")}))


@registered
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_records(spark, sf_dir))
    return _named(found.select(
        "sample_id", *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        _digest(spans.ordered(F.col("base"), pii.KINDS, True)).alias("base_sha256"),
        spans.ordered(F.concat("base", "added"), pii.KINDS, True).alias("spans")))


@registered
def op9_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(exact_dedup.exact_copies(_records(spark, sf_dir)).select("sample_id", "keep_id", "group_size", "kept", "text_sha256"))


@registered
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(passages.repeated_passages(_records(spark, sf_dir)))


@registered
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("content"), F.col("lang").alias("domain"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("sample_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    failed = filter_audit.labelled(filter_audit.text_failures(records), labels, ["good", "toxic"])
    survivors = filter_audit.subset_survivors(failed, len(filter_audit.TEXT_FILTERS), ["good", "toxic"])
    return filter_audit.interactions(survivors, filter_audit.TEXT_FILTERS, ["good", "toxic"]).withColumnRenamed("domain", "part")


def rebuilt(paths: DataFrame) -> DataFrame:
    """The first h steps of run c - c % 5, then run c's own steps after its first h; h is crc32(c) % 9."""
    run = F.col("run_id")
    paths = settled(paths, "paths")
    heads = paths.select(run.alias("_head_id"), F.slice("steps", 1, 8).alias("_head"))
    h = (F.crc32(run.cast("string")) % 9).cast("int")
    none = F.array().cast(paths.schema["steps"].dataType)
    return paths.join(heads, run - run % 5 == F.col("_head_id"), "left").select("run_id", F.concat(
        F.slice(F.coalesce("_head", none), F.lit(1), h), F.slice("steps", h + 1, F.greatest(F.size("steps") - h, F.lit(0)))).alias("steps"))


@registered
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("step"), F.col("role").alias("event"), F.col("text").alias("content"))
    nodes = log_trie.prefix_trie(rebuilt(log_trie.run_paths(steps)))
    return nodes.withColumnsRenamed({
        "run_id": "conv_id", "parent_run_id": "parent_conv_id", "n_runs": "n_convs", "saved_bytes": "saved_tokens"})


@registered
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.lit(TOKEN_LIMIT)
    return _named(token_counts.prefix_counts(_records(spark, sf_dir), tokenizer_path()).select(
        "sample_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), token_counts.chars_within(limit).alias("limit_chars")))


ORACLES = dict(sql.ORACLES)
