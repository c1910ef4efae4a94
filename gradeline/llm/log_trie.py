"""The prefix trie of step logs: which runs begin alike, and what keeping shared beginnings once would save."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .records import settled

#: Bytes of a step's digest.
WIDTH = 16
#: Bytes of distinct border paths up to which the skeleton is broadcast; above it the shards are halved in number.
SKELETON_BYTES = 32 << 20
#: Run ids of one record on its way to the digest of a skeleton node.
CHUNK_IDS = 4096
ROWS = 8192
NOTHING = hashlib.sha256().hexdigest()

#: kind 0: a finished node; 1: a shard's share of a skeleton node; 2: ids of runs that end at a skeleton node.
_FIELDS = [
    ("kind", "int", pa.int32()), ("node", "int", pa.int32()), ("run_id", "bigint", pa.int64()), ("depth", "bigint", pa.int64()),
    ("parent_run_id", "bigint", pa.int64()), ("parent_node", "int", pa.int32()), ("n_runs", "bigint", pa.int64()),
    ("n_children", "bigint", pa.int64()), ("n_leaves", "bigint", pa.int64()), ("saved_bytes", "bigint", pa.int64()),
    ("last_bytes", "bigint", pa.int64()), ("shard", "int", pa.int32()), ("chunk", "bigint", pa.int64()), ("ends", "string", pa.string()),
]


def step_digest(event: Column, content: Column) -> Column:
    """Hexadecimal MD5 of a step; the length of the event keeps event and content apart."""
    event, content = F.coalesce(event, F.lit("")), F.coalesce(content, F.lit(""))
    return F.md5(F.concat(F.length(event).cast("string"), F.lit(":"), event, content))


def run_paths(steps: DataFrame) -> DataFrame:
    """Every run's steps in order: `run_id` and `steps`, an array of struct<digest: string, n_bytes: bigint>.

    Reads step-log rows `run_id`, `step`, `event`, `content`. Steps go by `step`, null first; rows of one step go
    by digest. A null event or content is empty. `n_bytes` is the UTF-8 length of the content. Rows without a
    run_id belong to no run and are left out. Contents stay where they are: a digest of 16 bytes travels, and a
    run's digests form one row, so a run may have some ten million steps.
    """
    rows = steps.where(F.col("run_id").isNotNull()).select(
        F.col("run_id").cast("bigint").alias("run_id"),
        F.struct(
            F.col("step").alias("step"), step_digest(F.col("event"), F.col("content")).alias("digest"),
            F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("n_bytes")).alias("_step"))
    ordered = rows.groupBy("run_id").agg(F.sort_array(F.collect_list("_step")).alias("steps"))
    return ordered.select("run_id", F.transform("steps", lambda s: F.struct(s["digest"].alias("digest"), s["n_bytes"].alias("n_bytes"))).alias("steps"))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """Node by node, the trie of all beginnings of the runs.

    `paths` is what `run_paths` returns, one row per run. A node is a distinct sequence of first steps, from the
    root of depth 0; its members are the runs that begin with it. Returns `run_id` (smallest member), `depth`,
    `parent_run_id` (the parent's run_id; root: null), `n_runs` (members), `n_children`, `n_leaves` (childless nodes of the
    subtree, itself included), `saved_bytes` (over the subtree, n_runs - 1 times the bytes of a node's last content) and
    `ends_sha256` (of the ascending, comma-joined ids of the runs that end there).

    Runs are range-partitioned and sorted by path and run_id, so that copies of one run spread too. A node
    whose runs lie in several shards is a prefix that two neighbouring shards share at their border. The trie of
    these border prefixes, the skeleton, is broadcast: at most one path a border, counted, and with fewer
    shards where it is above a bound. Each shard streams through its sorted runs with a stack of open nodes and
    finishes all others; of skeleton nodes it returns its share, and the shares are reduced. Ids of
    runs that end in a skeleton node are hashed as a stream in order. The sorted runs are checkpointed in the
    shared folder, so borders stay as they are when executors are lost.

    A run without steps belongs to the root. Runs with equal steps share all nodes. Run ids are integers and
    unique in `paths`; rows with a null run_id are left out. Further columns are ignored. An empty table has no node.
    """
    runs = settled(paths.where(F.col("run_id").isNotNull()).select(
        F.col("run_id").cast("bigint").alias("run_id"), F.unhex(F.array_join(F.col("steps.digest"), "")).alias("path"),
        F.col("steps.n_bytes").alias("sizes")), "run-paths")
    shards = None
    while True:
        spread = runs.repartitionByRange("path", "run_id") if shards is None else runs.repartitionByRange(shards, "path", "run_id")
        ordered = cut_lineage(spread.sortWithinPartitions("path", "run_id"))
        shared = _borders(ordered)
        held, used = shared.agg(F.sum(F.length("shared")), F.count(F.lit(1))).first()
        if (held or 0) <= SKELETON_BYTES or used < 2:
            break
        shards = max(1, used // 2)
    skeleton = Skeleton(r["shared"] for r in shared.select("shared").collect())
    return _reduced(paths.sparkSession, _shards(ordered, skeleton), skeleton)


def _borders(ordered: DataFrame) -> DataFrame:
    """The distinct prefixes that shards share with the next one; a row a border at most."""
    ends = ordered.groupBy(F.spark_partition_id().alias("shard")).agg(F.min("path").alias("first"), F.max("path").alias("last"))
    pairs = ends.select("last", F.lead("first").over(Window.orderBy("shard")).alias("next")).where("next is not null")

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("last").to_pylist(), batch.column("next").to_pylist()):
                n = 0
                while n < min(len(a), len(b)) and a[n : n + WIDTH] == b[n : n + WIDTH]:
                    n += WIDTH
                out.append(a[:n])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["shared"])

    return cut_lineage(pairs.mapInArrow(common, "shared binary").distinct())


class Skeleton:
    """The trie of the border prefixes, numbered so that a subtree is a range of numbers; the root is 0."""

    def __init__(self, shared):
        self.children: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [None], [0]
        previous, trail = b"", [0]
        for path in sorted(shared):  # in this order, a node comes before what begins with it
            n = 0
            while n < min(len(path), len(previous)) and path[n : n + WIDTH] == previous[n : n + WIDTH]:
                n += WIDTH
            del trail[n // WIDTH + 1 :]
            for at in range(n, len(path), WIDTH):
                node = len(self.parent)
                self.children[trail[-1], path[at : at + WIDTH]] = node
                self.parent.append(trail[-1])
                self.depth.append(at // WIDTH + 1)
                trail.append(node)
            previous = path

    def rows(self) -> list[tuple[int, int | None, int, int, int]]:
        """Number, parent, depth, last number of the subtree and skeleton children of every node."""
        last, children = list(range(len(self.parent))), [0] * len(self.parent)
        for node in range(len(self.parent) - 1, 0, -1):
            up = self.parent[node]
            last[up] = max(last[up], last[node])
            children[up] += 1
        return [(i, self.parent[i], self.depth[i], last[i], children[i]) for i in range(len(self.parent))]


class _Node:
    __slots__ = ("skeleton", "size", "runs", "least", "children", "leaves", "saved", "ends", "waiting", "chunk")

    def __init__(self, skeleton, size):
        self.skeleton, self.size = skeleton, size
        self.runs, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.waiting, self.chunk = None, [], 0


class _Stack:
    """Open nodes of the sorted runs of one shard, from the root down to the last run's end."""

    def __init__(self, children: dict[tuple[int, bytes], int], shard: int):
        self.of, self.shard = children, shard
        self.path, self.nodes, self.out = [], [_Node(0, 0)], []

    def add(self, run: int, path: bytes, sizes: list[int]) -> None:
        steps = [path[i : i + WIDTH] for i in range(0, len(path), WIDTH)]
        common = 0
        for a, b in zip(self.path, steps):
            if a != b:
                break
            common += 1
        self.close(common)
        for i in range(common, len(steps)):
            up = self.nodes[-1].skeleton
            self.nodes.append(_Node(None if up is None else self.of.get((up, steps[i])), sizes[i]))
        self.path = steps
        node = self.nodes[-1]
        node.runs += 1
        node.least = run if node.least is None else min(node.least, run)
        if node.skeleton is None:
            if node.ends is None:
                node.ends = hashlib.sha256(str(run).encode())
            else:
                node.ends.update(f",{run}".encode())
        else:
            node.ends = node.ends or []
            node.ends.append(str(run))
            if len(node.ends) >= CHUNK_IDS:
                self._chunk(node)

    def _chunk(self, node: _Node) -> None:
        if node.ends:
            self.out.append((2, node.skeleton, *[None] * 9, self.shard, node.chunk, ",".join(node.ends)))
            node.ends, node.chunk = [], node.chunk + 1

    def close(self, depth: int) -> None:
        """Finish the open nodes below `depth`; -1 finishes the root too."""
        while len(self.nodes) > depth + 1:
            node, at = self.nodes.pop(), len(self.nodes)
            up = self.nodes[-1] if self.nodes else None
            if node.skeleton is None:
                leaves = node.leaves if node.children else 1
                saved = node.saved + (node.runs - 1) * node.size
                for row in node.waiting:
                    self.out.append((*row[:4], node.least, *row[5:]))
                up.children += 1
                up.leaves += leaves
                up.saved += saved
                row = (0, None, node.least, at, None, up.skeleton, node.runs, node.children, leaves, saved, None, None, None, node.ends.hexdigest() if node.ends else NOTHING)
                (up.waiting if up.skeleton is None else self.out).append(row)
            else:
                self._chunk(node)
                self.out.append((1, node.skeleton, node.least, at, None, None, node.runs, node.children, node.leaves, node.saved, node.size, self.shard, None, None))
            if up is not None:
                up.runs += node.runs
                up.least = node.least if up.least is None else min(up.least, node.least)


def _batches(rows: list[tuple], size: int) -> Iterator[pa.RecordBatch]:
    while len(rows) >= size:
        part = rows[: size or len(rows)]
        del rows[: len(part)]
        if not part:
            return
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in part], f[2]) for i, f in enumerate(_FIELDS)], [f[0] for f in _FIELDS])


def _shards(ordered: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Finished nodes of all shards, and their shares of skeleton nodes, written once."""
    children = ordered.sparkSession.sparkContext.broadcast(skeleton.children)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("run_id", "path", "sizes", "shard")]
            for run, path, sizes, shard in zip(*columns):
                if stack is None:
                    stack = _Stack(children.value, shard)
                stack.add(run, path, sizes)
            if stack:
                yield from _batches(stack.out, ROWS)
        if stack:
            stack.close(-1)
            yield from _batches(stack.out, ROWS)
            yield from _batches(stack.out, 0)

    rows = ordered.select("run_id", "path", "sizes", F.spark_partition_id().alias("shard"))
    return settled(rows.mapInArrow(work, ", ".join(f"{n} {t}" for n, t, _ in _FIELDS)), "trie-shards")


def _streamed(chunks: DataFrame) -> DataFrame:
    """SHA-256 of the joined chunks of every node, in order; the digest is carried from batch to batch."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([state.hexdigest()])], ["ends_node", "ends_sha256"])
        for batch in batches:
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if node == now:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        yield done()
                    now, state = node, hashlib.sha256(ids.encode())
        if state is not None:
            yield done()

    ordered = chunks.select("node", "shard", "chunk", "ends").repartition("node").sortWithinPartitions("node", "shard", "chunk")
    return ordered.select("node", "ends").mapInArrow(work, "ends_node int, ends_sha256 string")


def _reduced(spark, rows: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Reduce the shares of skeleton nodes, add up their subtrees, and give their children the parent's run_id.

    The tables of skeleton nodes are as small as the skeleton itself.
    """
    trie = spark.createDataFrame(skeleton.rows(), "node int, up int, at bigint, last int, own_children bigint")
    shares = rows.where("kind = 1").groupBy("node").agg(
        F.min("run_id").alias("run_id"), *[F.sum(c).alias(c) for c in ("n_runs", "n_children", "n_leaves", "saved_bytes")], F.max("last_bytes").alias("last_bytes"))
    joined = trie.join(shares, "node").join(_streamed(rows.where("kind = 2")), F.col("node") == F.col("ends_node"), "left")
    children = F.col("n_children") + F.col("own_children")
    own = joined.select(
        "node", "up", "at", "last", "run_id", "n_runs", children.alias("n_children"),
        (F.col("n_leaves") + F.when(children == 0, 1).otherwise(0)).alias("leaves"),
        (F.col("saved_bytes") + F.when(F.col("at") > 0, (F.col("n_runs") - 1) * F.col("last_bytes")).otherwise(0)).alias("saved"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    upto = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut_lineage(own.select("*", F.sum("leaves").over(upto).alias("leaves_to"), F.sum("saved").over(upto).alias("saved_to")))
    ends = summed.select(F.col("node").alias("last"), F.col("leaves_to").alias("leaves_end"), F.col("saved_to").alias("saved_end"))
    parents = summed.select(F.col("node").alias("up"), F.col("run_id").alias("up_run_id"))
    top = summed.join(ends, "last").join(parents, "up", "left").select(
        "run_id", F.col("at").alias("depth"), F.col("up_run_id").alias("parent_run_id"), "n_runs", "n_children",
        (F.col("leaves_end") - F.col("leaves_to") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_bytes"), "ends_sha256")
    finished = rows.where("kind = 0").join(F.broadcast(parents), F.col("parent_node") == F.col("up"), "left")
    return finished.select(
        "run_id", "depth", F.coalesce("parent_run_id", "up_run_id").alias("parent_run_id"), "n_runs", "n_children", "n_leaves", "saved_bytes",
        F.col("ends").alias("ends_sha256")).unionAll(top)
