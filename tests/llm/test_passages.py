"""Shared passages against brute force over all pairs of stretches."""

import random

import numpy as np
import pytest

from gradeline.llm import passages

WIDTH = passages.PARAGRAPH - passages.SHINGLE + 1


def grams(words):
    return [tuple(words[k : k + passages.SHINGLE]) for k in range(len(words) - passages.SHINGLE + 1)]


def hashed(words):
    return np.array([hash(g) & (2**63 - 1) for g in grams(words)], np.uint64)


def covered(a, b, threshold=passages.SIMILARITY):
    """Shingles of both texts that stand in a stretch with a match in the other text."""
    x, y = ([set(g[i : i + WIDTH]) for i in range(len(g) - WIDTH + 1)] for g in (grams(a), grams(b)))
    found = (set(), set())
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            c = len(p & q)
            if c >= threshold * (len(p) + len(q) - c) - 1e-9:
                found[0].update(range(i, i + WIDTH))
                found[1].update(range(j, j + WIDTH))
    return found


def reported(a, b):
    runs = passages.matching_stretches(hashed(a), hashed(b), WIDTH, passages.SIMILARITY)
    return {k for s, e, _, _ in runs for k in range(s, e)}, {k for _, _, s, e in runs for k in range(s, e)}


def pieces(passage, words):
    """A record that holds every shingle of the passage with half a stretch before or after it, never a match."""
    out = []
    for k in range(len(passage)):
        out += [*words(30), *passage[max(0, k - 23) : k + 5], *words(30), *passage[k : k + 28]]
    return out + words(30)


@pytest.fixture
def words():
    rng = random.Random(8)
    return lambda n: [f"w{rng.randrange(10**6):06d}" for _ in range(n)]


def test_stretches_with_repeated_lines_and_several_places():
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line = words(11)
    for size in (0, 8, 14, 30):
        passage = words(22) + line + words(17 + size)
        a = words(30) + passage + words(20)
        for b in (line + words(30) + passage + words(9),  # the line also stands earlier
                  words(5) + passage + words(60) + passage + words(9),  # the passage stands twice
                  line + words(8) + line + words(30) + passage[:40] + words(1) + passage[41:] + words(9)):
            want = covered(a, b)
            assert want[0] and reported(a, b) == want and reported(b, a) == want[::-1]
    for period in (1, 3, 9, 20):  # few distinct words
        passage = (words(period) * 90)[:80]
        a, b = words(30) + passage + words(20), words(50) + passage + words(10)
        assert reported(a, b) == covered(a, b)


def test_passages_are_whole_where_their_keys_have_another_smallest_id(spark, words):
    passage = words(300)
    edited = [w if k % 44 else "edited" for k, w in enumerate(passage)]
    rows = [(0, pieces(passage[80:], words)), (1, words(40) + passage + words(40)), (2, words(90) + edited + words(40)), (3, words(50))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "sample_id bigint, content string")
    found = {r["sample_id"]: (r["start"], r["end"]) for r in passages.repeated_passages(df).collect()}
    want = covered(rows[1][1], rows[2][1])
    at = lambda i, c: (sum(len(w) + 1 for w in rows[i][1][: min(c)]), sum(len(w) + 1 for w in rows[i][1][: max(c) + passages.SHINGLE]) - 1)
    assert len(want[0]) > 250 and found == {1: at(1, want[0]), 2: at(2, want[1])}


def test_near_copies_around_a_hot_phrase_meet(spark, words):
    """Smaller ids hold every key in every context, so no star joins the copies; single blocks and several find them."""
    from gradeline.llm.records import settled

    rng, phrase = random.Random(2), words(7)
    originals = [words(28) + phrase + words(35) for _ in range(8)]
    rows = [(i, pieces(p, words)) for i, p in enumerate(originals)] + [(20 + i, words(30) + phrase + words(30)) for i in range(90)]
    for k, passage in enumerate(originals):
        for copy in range(3):
            edited = list(passage)
            for at in rng.sample((3, 20, 45, 66), copy):
                edited[at] = words(1)[0]
            rows.append((1000 + 10 * k + copy, words(rng.randint(20, 60)) + edited + words(rng.randint(20, 60))))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "sample_id bigint, content string")
    got = {(r["sample_id"], r["component_id"]) for r in passages.repeated_passages(df).collect()}
    assert got == {(i, i // 10 * 10) for i, _ in rows if i >= 1000}
    text = dict(rows)
    assert all(covered(text[1000 + 10 * k], text[1000 + 10 * k + c])[0] for k in range(8) for c in (1, 2))
    members = settled(passages.key_members(passages.paragraph_keys(df)), "members")
    alone = spark.createDataFrame([], "id bigint, start bigint, end bigint, component struct<id: bigint, start: bigint>")
    for block in (4, 70, 2048):
        met = {(r["a"], r["b"]) for r in passages._across(members, alone, df, 50, 5, 0.75, block).collect()}
        assert {a for a, _ in met} | {b for _, b in met} >= {i for i, _ in got}
        assert all(a // 10 == b // 10 and covered(text[a], text[b])[0] for a, b in met if a >= 1000)
