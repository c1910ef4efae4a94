"""Byte-limited shards of evidence records by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import settled

#: Bits of the hash; a directory can not be deeper.
BITS = 60
#: Bits that a pass looks beyond the depth at which even shards would fit.
AHEAD = 6
LIMIT_BYTES = 64 << 20


def hash_bits(key: Column, content: Column) -> Column:
    """The first 60 bits of an MD5 over the key and the text's own MD5, so that rows under one key can part."""
    mark = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.md5(content))
    return F.conv(F.substring(F.md5(mark), 1, 15), 16, 10).cast("bigint")


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def assign_shards(records: DataFrame, limit_bytes: int = LIMIT_BYTES, key: str = "sample_id") -> DataFrame:
    """The shard of every record, none above `limit_bytes` of UTF-8 text.

    Reads `sample_id`, `content` and the `key` column; returns one row per input row: `sample_id`,
    `n_bytes`, `shard` (the directory's hash prefix as bits, with a part number after a dot where equal
    rows overflow), `depth` (bits of the prefix).

    The directory is indexed by hash-prefix bits. Bytes are summed for all cells of one depth, a table
    of some tens of cells per shard, and upwards for all shorter prefixes; a record's bucket is the
    shortest prefix that fits, so only oversized buckets are split on another bit. Cells that are
    still too large go through a deeper pass by themselves. Rows with equal key and text can not part
    by hashing: they count as one entry with a multiplicity, and are dealt into parts that fit.

    A text larger than the limit is a shard of its own. Null text is empty, a null key an empty string.
    Ties do not arise; repeated rows have a row each. Further columns are ignored. An empty table gives
    an empty result.
    """
    rows = records.select(
        F.col("sample_id").alias("_id"), F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("_bytes"),
        hash_bits(F.col(key), F.coalesce("content", F.lit(""))).alias("_h"))
    todo = settled(rows.groupBy("_id", "_bytes", "_h").agg(F.count("*").alias("_n")), "entries")
    total = todo.agg(F.sum(F.col("_bytes") * F.col("_n"))).first()[0] or 0
    deep = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit_bytes))) + AHEAD)
    done = []
    while True:
        cells = todo.withColumn("_cell", _prefix(F.col("_h"), F.lit(deep))).groupBy("_cell").agg(
            F.sum(F.col("_bytes") * F.col("_n")).alias("_sum"), F.min("_h").alias("_low"), F.max("_h").alias("_high"))
        levels = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(deep))).alias("depth")).withColumn(
            "prefix", F.call_function("shiftright", F.col("_cell"), F.lit(deep) - F.col("depth")))
        fitting = levels.groupBy("depth", "prefix").agg(F.sum("_sum").alias("_sum"), F.min("_low").alias("_low"), F.max("_high").alias("_high")).where(
            (F.col("_sum") <= limit_bytes) | (F.col("_low") == F.col("_high"))).select("depth", "prefix", F.col("_sum").alias("_held"))
        found = levels.select("_cell", "depth", "prefix").join(fitting, ["depth", "prefix"]).groupBy("_cell").agg(
            F.min(F.struct("depth", "prefix", "_held")).alias("_bucket"))
        placed = todo.withColumn("_cell", _prefix(F.col("_h"), F.lit(deep))).join(found, "_cell", "left")
        done.append(placed.where("_bucket is not null").select("_id", "_bytes", "_n", F.col("_bucket.depth").alias("depth"), F.col("_bucket.prefix").alias("prefix"), F.col("_bucket._held").alias("_held")))
        if deep == BITS:
            break
        todo = settled(placed.where("_bucket is null").select("_id", "_bytes", "_h", "_n"), "entries")
        if todo.isEmpty():
            break
        deep = min(BITS, deep + 2 * AHEAD)
    every = done[0]
    for more in done[1:]:
        every = every.unionAll(more)
    per_part = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(F.col("_bytes"), F.lit(1)))).cast("bigint")
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    split = F.when((F.col("_held") > limit_bytes) & (F.col("_n") > 1), F.floor(F.col("_copy") / per_part))
    return every.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_copy")).select(
        F.col("_id").alias("sample_id"), F.col("_bytes").alias("n_bytes"),
        F.concat_ws(".", bits, split.cast("string")).alias("shard"), "depth")


def write_shards(records: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> None:
    """Write the records below `path`, one folder per shard; ids must be unique there.

    The folders' column is `shard`, with as many underscores in front as keep it apart from the records' own columns.
    """
    taken = {c.lower() for c in records.columns}
    name, key = (next(p + word for p in ("_" * i for i in range(len(taken) + 1)) if p + word not in taken) for word in ("shard", "placed_id"))
    shards = assign_shards(records, limit_bytes).select(F.col("sample_id").alias(key), F.col("shard").alias(name))
    placed = records.join(shards, F.col("sample_id").eqNullSafe(F.col(key))).drop(key)
    placed.repartition(name).write.partitionBy(name).parquet(path)
