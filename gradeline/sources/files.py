"""File trees, manifests and image sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def scan_labeled_tree(spark: SparkSession, root: str, extensions: Sequence[str] = ("png",)) -> DataFrame:
    """Files below `root` with their label (parent folder), relative path, size and digests.

    Ordered by relative path. Contents are read by the tasks that digest them and dropped at once. Spark's
    binary source leaves out empty files and fails above 2 GiB; `ranges.digest_files` takes both.
    """
    pattern = "|".join(extensions)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .where(F.lower("path").rlike(rf"\.({pattern})$"))
    )
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    relative = F.regexp_extract(path, f"{_quoted(root)}/?(.*)$", 1)
    return files.select(
        relative.alias("filepath"),
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("label"),
        F.regexp_extract(path, r"([^/]+)$", 1).alias("name"),
        F.col("length"),
        F.md5("content").alias("md5"),
        F.sha2("content", 256).alias("sha256"),
    ).orderBy("filepath")


def _quoted(root: str) -> str:
    trimmed = root.removeprefix("file:").rstrip("/")
    return r"\Q" + "/" + trimmed.lstrip("/") + r"\E"


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """`image` source over a tree; a file that can not be decoded keeps its row."""
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)


def image_area(images: DataFrame) -> DataFrame:
    """width*height per image; an unreadable image has a null area and an error, the batch goes on."""
    ok = F.col("image.height") > 0
    return images.select(
        F.col("image.origin").alias("origin"),
        F.when(ok, F.col("image.width")).alias("width"),
        F.when(ok, F.col("image.height")).alias("height"),
        F.when(ok, (F.col("image.width") * F.col("image.height")).cast("double")).alias("area"),
        F.when(~ok, "unreadable").alias("error"),
    )


def read_manifest(spark: SparkSession, path: str, sha256: str | None = None, n: int | None = None) -> DataFrame:
    """Path list, one per line; refused when its bytes or line count differ from the anchor.

    The digest is taken over the whole text on one executor: a manifest is one file by contract.
    """
    if sha256 is not None:
        row = spark.read.text(path, wholetext=True).agg(F.first(F.sha2("value", 256)).alias("d")).first()
        if row["d"] != sha256:
            raise ValueError(f"manifest digest {row['d']} does not match")
    lines = spark.read.text(path).select(F.trim("value").alias("path")).where(F.length("path") > 0)
    if n is not None:
        found = lines.count()
        if found != n:
            raise ValueError(f"manifest has {found} lines, expected {n}")
    return lines


def read_sha256sums(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.audit import parse_sha256sums

    return parse_sha256sums(spark.read.text(path))


def directory_digests(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, digest) of every file below `root`, relative, for comparison with a manifest.

    As in `scan_labeled_tree`, empty files and those above 2 GiB need `ranges.directory_digests_of_any_size`.
    """
    path = F.regexp_replace("path", "^file:/*", "/")
    relative: Column = F.regexp_extract(path, f"{_quoted(root)}/?(.*)$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    out = files.select(relative.alias("path"), F.sha2("content", 256).alias("digest"))
    return out.where(~F.col("path").isin(list(exclude))) if exclude else out


