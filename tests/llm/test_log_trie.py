"""Prefix tries of step logs against brute force, with any number of shards."""

import hashlib
import random
import zlib

import pytest

from gradeline.llm import log_trie, queries
from gradeline.sources.records import read_log
from gradeline.sources.writers import append_log


def trie(runs):
    """runs: {run_id: [(event, content), ...]}; one row for each distinct beginning."""
    members = {}
    for run, steps in runs.items():
        for d in range(len(steps) + 1):
            members.setdefault(tuple(steps[:d]), []).append(run)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    rows = []

    def walk(node):
        below = [walk(c) for c in children.get(node, [])]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        ends = ",".join(str(r) for r in sorted(members[node]) if len(runs[r]) == len(node))
        rows.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                     len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if runs:
        walk(())
    return sorted(rows, key=str)


def got(df):
    names = ["run_id", "depth", "parent_run_id", "n_runs", "n_children", "n_leaves", "saved_bytes", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def runs_of(seed, n=220):
    rng = random.Random(seed)
    step = lambda k: (rng.choice(["train", "eval"]), rng.choice(["é loss", "a", "", "bb"]) + str(rng.randrange(k)))
    heads = [[step(2) for _ in range(rng.randrange(7))] for _ in range(6)]
    runs = {rng.randrange(-10**6, 10**12): heads[rng.randrange(6)] + [step(2) for _ in range(rng.randrange(5))] for _ in range(n)}
    return runs | {5 * 10**12 + i: heads[0] + [("eval", "same")] for i in range(n)} | {7 * 10**12 + i: [] for i in range(9)}


def frame(spark, runs):
    steps = [(run, k, e or None, c or None, "d", 1) for run, s in runs.items() for k, (e, c) in enumerate(s)]
    random.Random(0).shuffle(steps)
    return spark.createDataFrame(steps, "run_id bigint, step bigint, event string, content string, digest string, n_runs int").repartition(3)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_any_number_of_shards(spark, shards):
    """Copies of one run fill several shards; borders fall into equal runs."""
    runs = {r: s for r, s in runs_of(shards).items() if s}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(shards))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert got(log_trie.prefix_trie(log_trie.run_paths(frame(spark, runs)))) == trie(runs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_skeleton_above_its_bound_takes_fewer_shards(spark, monkeypatch):
    runs = {r: s for r, s in runs_of(8).items() if s}
    monkeypatch.setattr(log_trie, "SKELETON_BYTES", 40)
    monkeypatch.setattr(log_trie, "CHUNK_IDS", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(log_trie.prefix_trie(log_trie.run_paths(frame(spark, runs)))) == trie(runs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_without_steps_and_long_runs(spark):
    runs = {3: [], 1: [], 2: [("e", "x" * 100_000)] + [("e", str(i)) for i in range(3000)], 4: [("e", "x" * 100_000)]}
    paths = log_trie.run_paths(frame(spark, runs)).unionByName(spark.createDataFrame(
        [(1, []), (3, []), (None, [])], "run_id bigint, steps array<struct<digest:string,n_bytes:bigint>>"))
    assert len(got(log_trie.prefix_trie(paths))) == 3002
    short = {r: s[:3] for r, s in runs.items()}
    short_paths = log_trie.run_paths(frame(spark, short)).unionByName(spark.createDataFrame(
        [(1, []), (3, []), (None, [])], "run_id bigint, steps array<struct<digest:string,n_bytes:bigint>>"))
    assert got(log_trie.prefix_trie(short_paths)) == trie(short)
    assert log_trie.prefix_trie(paths.limit(0)).count() == 0


def test_order_of_steps(spark):
    """Null steps first, rows of one step by digest, repeated rows are steps of their own, null runs left out."""
    rows = [(1, 2, "e", "c"), (1, None, "e", "n"), (1, 1, "e", "b"), (1, 1, "e", "a"), (1, 1, "e", "a"), (None, 0, "e", "z"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "run_id bigint, step bigint, event string, content string")
    by = lambda e, c: hashlib.md5(f"{len(e)}:{e}{c}".encode()).hexdigest()
    found = {r["run_id"]: [s["digest"] for s in r["steps"]] for r in log_trie.run_paths(df).collect()}
    assert found == {1: [by("e", "n"), *sorted([by("e", "a"), by("e", "a"), by("e", "b")]), by("e", "c")], 2: [by("", "")]}
    assert by("e", "ab") != by("ea", "b")


def test_step_log_files(spark, tmp_path):
    """The project's own step log: two runs that resume from one beginning."""
    log = spark.createDataFrame(
        [(s, run, s / 10, 0.01, 0.01 if s < 4 else 0.01 * run, 0.5) for run in (1, 2) for s in range(6)],
        "step bigint, run_id bigint, progress double, base_lr double, lr double, coeff double")
    append_log(log, str(tmp_path / "steps"))
    steps = read_log(spark, str(tmp_path / "steps")).selectExpr("run_id", "step", "'update' as event", "to_json(struct(progress, lr, coeff)) as content")
    rows = got(log_trie.prefix_trie(log_trie.run_paths(steps)))
    assert sorted((r[1], r[3]) for r in rows) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 2), (5, 1), (5, 1), (6, 1), (6, 1)]


def test_query(spark, small_dir):
    told = {}
    for r in spark.read.parquet(f"{small_dir}/conversations.parquet").collect():
        told.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    told = {c: [t[2:] for t in sorted(v)] for c, v in told.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in told}
    runs = {c: told.get(c - c % 5, [])[: h[c]] + v[h[c] :] for c, v in told.items()}
    df = queries.QUERIES["op12_prefix_trie"](spark, small_dir)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == trie(runs)
