"""Evidence records: reading a tree, stable intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Characters that separate words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_evidence(spark: SparkSession, root: str, pattern: str = "*.{json,jsonl,csv,tsv,txt,md,yaml}") -> DataFrame:
    """Evidence records of the text files below `root`; the domain is the file's folder."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    return files.select(
        F.xxhash64("path").alias("sample_id"),
        F.decode("content", "UTF-8").alias("content"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("domain"),
        F.col("path").alias("filepath"),
    )


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Several branches then read the same rows instead of recomputing them, and a lost executor takes
    nothing with it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
