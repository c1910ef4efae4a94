"""Texts matched a slice at a time against brute force, and how much work a slice and a key's places take."""

import random

import numpy as np
import pyarrow as pa

from gradeline.llm import passages

from test_passages import WIDTH, covered, hashed, reported


def test_texts_of_a_slice_match_their_own_partners_only():
    """Neighbours in a slice share a partner, hold one passage, end and start within it, or are too short."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, line = words(70), words(9)
    partners = [words(20) + passage, passage + words(20), words(30), words(40) + line * 9 + words(40), words(80)]
    texts = [(0, passage[:45]), (0, passage[30:] + words(9)), (0, passage), (1, words(9) + passage[:60]), (1, passage), (2, passage), (3, words(3) + line * 8), (3, passage), (4, words(90)),
             (4, partners[4]), (4, [])]
    a, b = [hashed(t) for _, t in texts], [hashed(t) for t in partners]
    at = lambda held: np.append(0, np.cumsum([len(h) for h in held]))
    runs = passages.matching_runs(np.concatenate(a).astype(np.uint64), at(a), np.concatenate(b), at(b), np.array([p for p, _ in texts]), WIDTH, passages.SIMILARITY)
    for k, (p, t) in enumerate(texts):
        own = [r for r in zip(*runs.tolist()) if r[0] == k]
        got = {i for _, s, e, _, _ in own for i in range(s, e)}, {i for _, _, _, s, e in own for i in range(s, e)}
        want = covered(t, partners[p])
        assert got == reported(t, partners[p]) and bool(got[0]) == bool(want[0]) and got[0] <= want[0] and got[1] <= want[1]
    assert {2, 4, 6, 9} <= set(runs[0]) and not {0, 5, 7, 8, 10} & set(runs[0])


def test_a_partner_is_hashed_once_for_its_rows():
    rows = pa.RecordBatch.from_pydict({"text_a": ["a b"] * 900, "text_b": ["x " * 20_000] * 450 + ["y " * 20_000] * 450})
    parts = list(passages._by_partner(rows, "text_b"))
    assert sum(r.num_rows for r, _, _ in parts) == 900 and sum(len(t) for _, _, t in parts) <= 3
    for part, partner, texts in parts:
        assert [texts[int(p)].as_py() for p in partner] == part.column("text_b").to_pylist()


def test_places_around_a_hot_phrase_meet_where_they_share_more():
    """400 places share a phrase; three of them share enough, and only these are paired."""
    rng = np.random.RandomState(6)
    phrase, near = rng.randint(0, 1 << 32, 20, np.uint64), rng.randint(0, 1 << 32, 60, np.uint64)
    held = [np.concatenate((rng.randint(0, 1 << 32, 60, np.uint64), phrase)) for _ in range(400)]
    for k in (7, 70, 333):
        held[k][:60] = near
    row, n = np.repeat(np.arange(400), 80), np.full(400, 40)
    group = np.zeros(400, np.int64)
    pairs = passages._meeting(np.concatenate(held).astype(np.uint32), row, group, np.arange(400), n)
    assert {tuple(sorted((p // 400, p % 400))) for p in pairs.tolist()} == {(7, 70), (7, 333), (70, 333)}
    joined = np.where(np.isin(np.arange(400), (7, 70)), 1000, np.arange(400))  # rows of one component do not meet
    order = np.argsort(joined, kind="stable")
    pairs = passages._meeting(np.concatenate([held[k] for k in order]).astype(np.uint32), row, group, joined[order], n)
    assert len(pairs) == 2
