"""Digests of files of any size, read in ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file in memory at a time.
RANGE_BYTES = 8 << 20
#: Bytes of files that one task digests; a larger file is a task of its own.
TASK_BYTES = 256 << 20


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, root: str, extensions: tuple[str, ...], task_bytes: int, range_bytes: int):
        self.root, self.extensions, self.task_bytes, self.range_bytes = root, extensions, task_bytes, range_bytes

    def _store(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.root if "://" in self.root else "file://" + self.root.removeprefix("file:"))

    def partitions(self) -> list[_Files]:
        store, base = self._store()
        found = sorted((f.path, f.size) for f in store.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)) if f.is_file)
        tasks: list[list[tuple[str, int]]] = []
        held = self.task_bytes
        for path, size in found:
            if self.extensions and path.rsplit(".", 1)[-1].lower() not in self.extensions:
                continue
            if held + size > self.task_bytes:
                tasks.append([])
                held = 0
            tasks[-1].append((path, size))
            held += size
        return [_Files(t) for t in tasks] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, base = self._store()
        rows = []
        for path, _ in partition.files:
            md5, sha, length = hashlib.md5(), hashlib.sha256(), 0
            with store.open_input_file(path) as file:
                while data := file.read_at(self.range_bytes, length):
                    md5.update(data)
                    sha.update(data)
                    length += len(data)
            rows.append((path[len(base) :].lstrip("/"), length, md5.hexdigest(), sha.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))],
            ["filepath", "length", "md5", "sha256"])


class FileDigests(DataSource):
    """Data source `file_digests`: one row per file below `path`."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "filepath string, length bigint, md5 string, sha256 string"

    def reader(self, schema) -> _Reader:
        extensions = tuple(x for x in self.options.get("extensions", "").lower().split(",") if x)
        return _Reader(
            self.options["path"], extensions, int(self.options.get("taskBytes", TASK_BYTES)), int(self.options.get("rangeBytes", RANGE_BYTES)))


def digest_files(
    spark: SparkSession, root: str, extensions: Sequence[str] = (), task_bytes: int = TASK_BYTES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Every file below `root` with its label (parent folder), relative path, size and digests, whatever its size.

    The binary source holds a file in one row, so it ends at 2 GiB. Here a task reads one range after the other into
    both digests and holds a single range; small files share a task. `root` is a folder of any file system that Arrow
    opens on the executors. The columns are those of `scan_labeled_tree`; an empty folder gives an empty table.
    """
    spark.dataSource.register(FileDigests)
    files = spark.read.format("file_digests").option("extensions", ",".join(extensions)).option(
        "taskBytes", str(task_bytes)).option("rangeBytes", str(range_bytes)).load(root)
    parent = root.rstrip("/").rsplit("/", 1)[-1]
    return files.select(
        "filepath", F.coalesce(F.nullif(F.regexp_extract("filepath", r"([^/]+)/[^/]+$", 1), F.lit("")), F.lit(parent)).alias("label"),
        F.regexp_extract("filepath", r"([^/]+)$", 1).alias("name"), "length", "md5", "sha256")


def directory_digests_of_any_size(spark: SparkSession, root: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, digest) of every file below `root` for `audit.verify_sha256sums`, files above 2 GiB included."""
    out = digest_files(spark, root).select(F.col("filepath").alias("path"), F.col("sha256").alias("digest"))
    return out.where(~F.col("path").isin(list(exclude))) if exclude else out
