"""Content digests and fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import ColumnLike, col

# Digest text formats.
HEX32 = "^[0-9a-fA-F]{32}$"
HEX64 = "^[0-9a-fA-F]{64}$"
# Machine paths that must not appear in published text: drive letters, home folders, UNC shares.
LOCAL_PATH = r"([A-Za-z]:[\\/](?![\\/])|/home/|/Users/|\\\\[A-Za-z0-9])"


def is_md5(c: ColumnLike) -> Column:
    return col(c).isNotNull() & col(c).rlike(HEX32)


def is_sha256(c: ColumnLike) -> Column:
    return col(c).isNotNull() & col(c).rlike(HEX64)


def canonical_json_sha256(fields: Sequence[str]) -> Column:
    """SHA-256 of compact JSON with sorted keys; ASCII strings and integers only."""
    ordered = [F.col(f).alias(f) for f in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)


def normalise_path(c: ColumnLike) -> Column:
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def stays_inside(c: ColumnLike) -> Column:
    """True when a relative path never climbs above its root and is not absolute."""
    path = normalise_path(c)
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, part: F.struct(
            (acc["at"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(
                acc["low"],
                acc["at"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1),
            ).alias("low"),
        ),
        lambda acc: acc["low"],
    )
    return ~path.startswith("/") & ~path.rlike("^[A-Za-z]:") & (depth >= 0)


def leaks_local_path(c: ColumnLike) -> Column:
    return col(c).rlike(LOCAL_PATH)


def _length_prefixed(name: ColumnLike) -> Column:
    size = F.unhex(F.lpad(F.hex(F.octet_length(col(name))), 8, "0"))
    return F.concat(size, F.encode(col(name), "UTF-8"))


#: Bytes of joined entries that travel as one row.
CHUNK_BYTES = 1 << 20


def ordered_digest(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], entry: Column, algorithm: str, separator: bytes, digest: str, counted: str,
) -> DataFrame:
    """Digest of the entries of every key in `order`, joined by `separator`, and the number of rows.

    The digest of a key is sequential by definition, but no row, array or task holds the key's entries: rows are
    range-partitioned and sorted by key and order, so a large key sorts in many tasks; each task joins
    neighbours to chunks of about `CHUNK_BYTES`; a key's chunks then stream in order through one hash
    state, carried from batch to batch. A null entry is counted and not digested. Null keys are keys.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    by = [*names, *[f"_o{i}" for i in range(len(order))]]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c.alias(f"_o{i}") for i, c in enumerate(order)], entry.cast("binary").alias("_entry"))
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*names, F.spark_partition_id().alias("_shard"), "_entry")
    kinds = "".join(f"{n} {df.schema[k].dataType.simpleString()}, " for n, k in zip(names, keys))
    nothing = lambda batch: [tuple()] * batch.num_rows
    key_rows = lambda batch: list(zip(*[batch.column(n).to_pylist() for n in names])) if names else nothing(batch)

    def table(types: pa.Schema, found: list[tuple], rest: dict[str, pa.DataType]) -> pa.RecordBatch:
        fields = [pa.field(n, types.field(n).type) for n in names] + [pa.field(n, t) for n, t in rest.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size, n, at = None, [], 0, 0, 0
        fields = {"_shard": pa.int32(), "_at": pa.int64(), "_n": pa.int64(), "_chunk": pa.binary()}
        types = shard = None
        for batch in batches:
            types, out = batch.schema, []
            for own, shard, data in zip(key_rows(batch), batch.column("_shard").to_pylist(), batch.column("_entry").to_pylist()):
                if n and (own != key or size >= CHUNK_BYTES):
                    out.append((*key, shard, at, n, separator.join(parts) if parts else None))
                    parts, size, n, at = [], 0, 0, at + 1
                key, n = own, n + 1
                if data is not None:
                    parts.append(data)
                    size += len(data)
            if out:
                yield table(types, out, fields)
        if n:
            yield table(types, [(*key, shard, at, n, separator.join(parts) if parts else None)], fields)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n, begun = None, None, 0, False
        types = None
        for batch in batches:
            types, out = batch.schema, []
            for own, rows_of, chunk in zip(key_rows(batch), batch.column("_n").to_pylist(), batch.column("_chunk").to_pylist()):
                if own != key or state is None:
                    if state is not None:
                        out.append((*key, state.hexdigest(), n))
                    key, state, n, begun = own, hashlib.new(algorithm), 0, False
                n += rows_of
                if chunk is not None:
                    state.update(separator + chunk if begun else chunk)
                    begun = True
            if out:
                yield table(types, out, {"_digest": pa.string(), "_rows": pa.int64()})
        if state is not None:
            yield table(types, [(*key, state.hexdigest(), n)], {"_digest": pa.string(), "_rows": pa.int64()})

    chunks = ordered.mapInArrow(joined, f"{kinds}_shard int, _at bigint, _n bigint, _chunk binary")
    placed = (chunks.repartition(*names) if names else chunks.repartition(1)).sortWithinPartitions(*names, "_shard", "_at")
    out = placed.select(*names, "_n", "_chunk").mapInArrow(hashed, f"{kinds}_digest string, _rows bigint")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("_digest").alias(digest), F.col("_rows").alias(counted))


def name_set_signature(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """SHA-256 over the sorted names, each preceded by its byte length (4 bytes, big endian); see `ordered_digest`.

    A null name is counted and not digested. `tree_signature` is the order-free form, whose digest is parallel too.
    """
    return ordered_digest(df, keys, [F.col(name)], _length_prefixed(name), "sha256", b"", "signature", "n_names")


def manifest_fingerprint(df: DataFrame, keys: Sequence[str], cls: str, name: str, digest: str) -> DataFrame:
    """MD5 over `class/name:md5` entries sorted by class then name and joined with a bar; see `ordered_digest`.

    An entry with a null part is counted and not digested.
    """
    text = F.col(name).cast("string")
    line = F.concat(F.col(cls).cast("string"), F.lit("/"), text, F.lit(":"), F.col(digest))
    return ordered_digest(df, keys, [F.col(cls), text, F.col(digest)], F.encode(line, "UTF-8"), "md5", b"|", "fingerprint", "n_entries")


def tree_signature(
    df: DataFrame, keys: Sequence[str], cls: str, name: str, digest: str, depth: int = 6, step: int = 3
) -> DataFrame:
    """Order-free digest tree over a snapshot of any size.

    Entries fall into leaves by the first `depth` hex digits of their name's hash, each leaf digests
    its sorted entries, and every level above digests at most 16^step children. Any changed, added,
    removed or renamed entry changes the root. Raise `depth` with the snapshot so that a leaf stays
    small; the root is comparable only between equal depths and is not byte-compatible with the
    sequential forms.
    """
    line = F.concat_ws(":", F.concat_ws("/", F.col(cls), F.col(name).cast("string")), F.col(digest))
    nodes = (
        df.select(*keys, F.substring(F.md5(F.col(name).cast("string")), 1, depth).alias("node"), line.alias("entry"))
        .groupBy(*keys, "node")
        .agg(_digest_of("entry").alias("entry"), F.count(F.lit(1)).alias("n"))
    )
    width = depth
    while width > 0:
        width = max(0, width - step)
        child = F.concat_ws(":", "node", "entry").alias("entry")
        nodes = (
            nodes.select(*keys, F.substring("node", 1, width).alias("node"), child, "n")
            .groupBy(*keys, "node")
            .agg(_digest_of("entry").alias("entry"), F.sum("n").alias("n"))
        )
    return nodes.select(*keys, F.col("entry").alias("root"), F.col("n").alias("n_entries"))


def _digest_of(entry: str) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256)
