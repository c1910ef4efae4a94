"""Exact copies of evidence texts, with only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import SPACE, settled


def normalised(content: Column) -> Column:
    """The text without its white space; null is empty."""
    return F.regexp_replace(F.coalesce(content, F.lit("")), SPACE + "+", "")


def exact_copies(records: DataFrame) -> DataFrame:
    """Which record of equal texts stays.

    Reads `sample_id`, `content`; returns one row per input row: `sample_id`, `keep_id`, `group_size`,
    `kept`, `text_sha256`. Texts are equal when they are identical without white space; the record with
    the most code points, then the smallest `sample_id`, stays.

    A narrow pass writes size and 128-bit hash of every record; groups form on these alone, and a group's
    leader is a partial aggregate, so a group of any size passes through the shuffle as one row per task.
    Only members of groups with copies bring their bytes, and meet their leader's in a join that adaptive
    execution can split. To find them all texts move once, by hash, alike at every size. A member whose bytes
    differ from its leader's (a hash collision) goes on with its own text as the key.

    Null text is empty, and all empty texts are one group. Ties of length go to the smaller id, null
    ids last; rows repeated with the same id and size are all counted and stay or go together. Further
    columns are ignored. An empty table gives an empty result.
    """
    rows = records.select(
        F.col("sample_id").alias("_id"),
        F.length(F.coalesce("content", F.lit(""))).cast("long").alias("_size"),
        normalised(F.col("content")).alias("_text"),
    ).select("*", F.unhex(F.md5("_text")).alias("_hash"))
    narrow = settled(rows.select("_id", "_size", "_hash", F.sha2("_text", 256).alias("text_sha256")), "hashed")
    rank = F.struct((-F.col("_size")).alias("s"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"))
    groups = narrow.groupBy("_hash").agg(F.min(rank).alias("_top"), F.count("*").alias("_n"))
    shared = settled(groups.where("_n > 1").select("_hash", "_top"), "shared")
    members = settled(rows.join(shared.hint("merge"), "_hash"), "members")
    leaders = members.where(rank == F.col("_top")).groupBy("_hash").agg(F.max("_text").alias("_lead"))
    compared = members.join(leaders, "_hash").select(
        "_id", "_size", "_hash", F.sha2("_text", 256).alias("text_sha256"),
        F.when(F.col("_lead") != F.col("_text"), F.col("_text")).alias("_odd"),
    )
    single = narrow.join(shared, "_hash", "left_anti").select(
        F.col("_id").alias("sample_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    return single.unionAll(_leaders(settled(compared, "compared")))


def _leaders(compared: DataFrame) -> DataFrame:
    rank = F.struct((-F.col("_size")).alias("s"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"))
    odd = F.coalesce(F.concat(F.lit("="), "_odd"), F.lit(""))
    keyed = compared.select("_id", "_hash", "text_sha256", odd.alias("_odd"), rank.alias("_rank"))
    classes = keyed.groupBy("_hash", "_odd").agg(F.min("_rank").alias("_best"), F.count("*").alias("group_size"))
    return keyed.join(classes, ["_hash", "_odd"]).select(
        F.col("_id").alias("sample_id"), F.col("_best.i").alias("keep_id"), "group_size",
        (F.col("_rank") == F.col("_best")).alias("kept"), "text_sha256",
    )
