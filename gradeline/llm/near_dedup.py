"""Near copies of evidence texts: min-max hashing, banding, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .records import settled
from .shingles import band_shape, distinct_sets, mix, permutations, slices, text_shingles

SIMILARITY = 0.75
SHINGLE = 5
#: Each permutation gives two signature values, its minimum and its maximum.
PERMUTATIONS = 64
#: Least probability that the bands find a pair right at the threshold.
RECALL = 0.99999
#: Rows of one side of a block when rows of a bucket are compared with each other.
BLOCK = 512
#: Sketch agreement below which a pair cannot reach the threshold but by a deviation of five sigma.
SKETCH_FLOOR = 0.55


def signatures(records: DataFrame, shingle: int = SHINGLE, n_permutations: int = PERMUTATIONS,
               threshold: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(sample_id, n_shingles, set1, set2, bands, sketch) of every record.

    `set1`, `set2` are a 128-bit fingerprint of the set of shingles. `bands` mix the minima and maxima
    of as many permutations as a band needs; `sketch` keeps one byte of each signature value. A record
    without words has an empty set and no bands.
    """
    n_bands, rows = band_shape(threshold, recall, 2 * n_permutations)
    kind = records.select("sample_id").dtypes[0][1]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, plus = permutations(n_permutations)
        salts = mix(np.arange(1, rows + 1, dtype=np.uint64))
        for batch in slices(batches, "content"):
            values, bounds = text_shingles(batch.column("content"), shingle)
            sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            full = np.flatnonzero(np.diff(bounds))
            signature = np.empty((len(full), 2 * n_permutations), np.uint64)
            for k in range(n_permutations if len(full) else 0):
                v = values * mult[k] + plus[k]
                signature[:, 2 * k] = np.minimum.reduceat(v, bounds[full])
                signature[:, 2 * k + 1] = np.maximum.reduceat(v, bounds[full])
            banded = mix((signature[:, : n_bands * rows].reshape(len(full), n_bands, rows) * (salts | np.uint64(1))).sum(axis=2, dtype=np.uint64))
            sketch = (mix(signature) & np.uint64(255)).astype(np.uint8)
            n = len(sets)
            sizes = np.zeros(n, np.int64)
            sizes[full] = n_bands
            near = np.full(n, None, object)
            for place, row in zip(full, sketch):
                near[place] = row.tobytes()
            prints = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64))) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("sample_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([p[0] for p in prints], np.uint64).view(np.int64)),
                pa.array(np.array([p[1] for p in prints], np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(banded.reshape(-1).view(np.int64))),
                pa.array(list(near), pa.binary()),
            ], ["sample_id", "n_shingles", "set1", "set2", "bands", "sketch"])

    return records.select("sample_id", "content").mapInArrow(
        sign, f"sample_id {kind}, n_shingles bigint, set1 bigint, set2 bigint, bands array<bigint>, sketch binary")


def confirmed(pairs: DataFrame, records: DataFrame, shingle: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose full sets have a Jaccard similarity of at least `threshold`.

    Texts travel in one exchange on the id, which both joins share; a much-used partner is a hot join
    key that adaptive execution splits.
    """
    texts = records.select(F.col("sample_id").alias("_id"), F.col("content").alias("_text")).where("_id is not null")
    left = texts.join(pairs, F.col("_id") == F.col("a")).select("a", "b", F.col("_text").alias("text_a"))
    both = texts.join(left, F.col("_id") == F.col("b")).select("a", "b", "text_a", F.col("_text").alias("text_b"))
    percent = round(threshold * 100)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", "text_b"):
            keep = []
            for x, y in zip(distinct_sets(batch.column("text_a"), shingle), distinct_sets(batch.column("text_b"), shingle)):
                small, large = min(len(x), len(y)), max(len(x), len(y))
                common = 0 if 100 * small < percent * large or not small else len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(small) and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.select("a").dtypes[0][1]
    return both.mapInArrow(check, f"a {kind}, b {kind}")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal leading columns; a group may span batches and is bounded by two blocks."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of a block together, in one task."""
    keys = ["band", "key", "i", "j"]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *keys).sortWithinPartitions(*keys)


def _partners(group: pa.Table, floor: float, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each asking row of a block with the asked rows it may link with.

    They are of another component, of a size that allows the similarity, agree on the sketch, and share
    no earlier band, in whose bucket the pair is met as well.
    """
    side, band = group.column("side").to_numpy(), group.column("band")[0].as_py()
    parts, sizes = group.column("component").to_numpy(), group.column("n_shingles").to_numpy()
    n = len(side)
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(n, -1)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)[:, :band]
    other = np.flatnonzero(side == 1)
    for x in np.flatnonzero(side == 0):
        y = other[(parts[other] != parts[x]) & (np.minimum(sizes[other], sizes[x]) >= threshold * np.maximum(sizes[other], sizes[x]) - 1e-9)]
        if len(y):
            y = y[(sketch[y] == sketch[x]).mean(axis=1) >= floor]
        if len(y) and band:
            y = y[~(bands[y] == bands[x]).any(axis=1)]
        if len(y):
            yield x, y


def _across(members: DataFrame, labels: DataFrame, records: DataFrame, shingle: int = SHINGLE,
            threshold: float = SIMILARITY, block: int = BLOCK, floor: float = SKETCH_FLOOR) -> DataFrame:
    """Links (a, b) inside buckets whose members are in more than one component so far.

    Rows of a bucket outside its largest component are the questioners; they are dealt into blocks, and
    each block meets each block of all members in a group of its own. Sketches pick the rows of a block
    that may have a link; their texts join them there, and full sets decide inside the task. What leaves
    it are links that join components of the block, not pairs. A bucket that its star joined into one
    component sends nothing.
    """
    rows = members.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = rows.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    open_ = (parts.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"))
             .where("parts > 1").select("band", "key", "n", F.col("top.component").alias("main"), (F.col("n") - F.col("top.n")).alias("asking")))
    cells = lambda n: F.ceil(F.col(n) / block).cast("int")
    cell = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), cells(n).cast("bigint")).cast("int")
    met = rows.join(open_, ["band", "key"])
    held = ["id", "component", "n_shingles", "sketch", "bands"]
    asking = met.where("component <> main").select(
        "band", "key", cell(1, "asking").alias("i"), F.explode(F.sequence(F.lit(0), cells("n") - 1)).alias("j"), F.lit(0).alias("side"), *held)
    asked = met.select(
        "band", "key", F.explode(F.sequence(F.lit(0), cells("asking") - 1)).alias("i"), cell(2, "n").alias("j"), F.lit(1).alias("side"), *held)
    dealt = asking.unionAll(asked)
    fields = dealt.columns

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 4):
            used = np.zeros(group.num_rows, bool)
            for x, y in _partners(group, floor, threshold):
                used[x] = True
                used[y] = True
            if used.any():
                yield from group.filter(pa.array(used)).select(fields).to_batches()

    likely = settled(_dealt(dealt).mapInArrow(pick, dealt.schema), "likely")
    texts = records.select(F.col("sample_id").alias("_id"), F.col("content").alias("_text")).where("_id is not null")
    carried = texts.join(likely, F.col("_id") == F.col("id")).select(*fields, F.col("_text").alias("text"))
    percent = round(threshold * 100)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 4):
            sets = [s for part in slices(iter(group.to_batches()), "text") for s in distinct_sets(part.column("text"), shingle)]
            ids, parts = group.column("id").to_numpy(), group.column("component").to_numpy()
            root: dict = {}

            def top(c):
                while c in root:
                    c = root[c]
                return c

            links = []
            for x, ys in _partners(group, floor, threshold):
                for y in ys:
                    a, b = top(parts[x]), top(parts[y])
                    if a == b:
                        continue
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                        root[max(a, b)] = min(a, b)
                        links.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links)], ["a", "b"])

    kind = members.select("id").dtypes[0][1]
    return _dealt(carried).mapInArrow(decide, f"a {kind}, b {kind}")


def near_copies(records: DataFrame, shingle: int = SHINGLE, threshold: float = SIMILARITY,
                n_permutations: int = PERMUTATIONS, recall: float = RECALL) -> DataFrame:
    """Components of near copies, by min-max hashing with exact confirmation.

    Reads `sample_id` (an integer type), `content`; returns one row per input row: `sample_id`,
    `n_shingles`, `component_id` (smallest id reachable, itself included), `kept` (it is its own
    component's smallest). Two records are linked when 100 * intersection >= 100 * threshold * union of
    their sets of shingles of `shingle` lower-cased words.

    1. Every permutation keeps its minimum and its maximum, so half the hash evaluations fill the
       signature; bands of both are shaped by the recall wanted at the threshold.
    2. Records with equal sets (128-bit fingerprint) collapse to the smallest id.
    3. In every band each bucket's members meet its smallest id only: no pairs within buckets.
    4. Full sets confirm those links; components form.
    5. Where a bucket still spans several components, members of different components meet in blocks;
       sketches pick those whose texts are needed, and full sets decide inside the block.

    Null and empty texts and texts without words have no set and link with nothing. A text with fewer
    words than `shingle` has its whole sequence as one shingle. Ties go to the smaller id. Rows repeated
    with one id are one node; a null id has a null component and is kept. Further columns are ignored.
    An empty table gives an empty result.
    """
    signed = settled(signatures(records, shingle, n_permutations, threshold, recall), "signatures")
    full = signed.where("n_shingles > 0 and sample_id is not null")
    classes = full.groupBy("set1", "set2").agg(F.min("sample_id").alias("b"))
    same = full.join(classes, ["set1", "set2"]).where("sample_id <> b").select(F.col("sample_id").alias("a"), "b")
    rows = full.join(classes, ["set1", "set2"]).where("sample_id = b").select(
        "sample_id", F.posexplode("bands").alias("band", "key")).select(F.col("sample_id").alias("id"), "band", "key")
    stars = rows.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = settled(rows.join(stars, ["band", "key"]), "members")
    links = settled(confirmed(members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), records, shingle, threshold)
                    .unionAll(same), "near-links")
    labels = settled(connected_components(links), "labels")
    sketches = full.select(F.col("sample_id").alias("id"), "n_shingles", "sketch", "bands").dropDuplicates(["id"])
    more = settled(_across(members.select("band", "key", "id").join(sketches, "id"), labels, records, shingle, threshold), "more-links")
    if not more.isEmpty():
        labels = connected_components(links.unionAll(more))
    named = labels.select(F.col("node").alias("_node"), "component")
    out = signed.join(named, F.col("sample_id") == F.col("_node"), "left")
    component = F.coalesce("component", "sample_id")
    return out.select("sample_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("sample_id"), F.lit(True)).alias("kept"))
