"""Partners and keys that very many rows have in common: what a task holds at a time, and how often rows travel."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from gradeline.llm import passages
from gradeline.llm.records import settled

from test_passages import WIDTH, covered, hashed


def batch(rows):
    names = ["id", "b", "share", "whole", "skip", "text"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.string()))], names)


def test_a_partners_text_stands_once_for_all_rows_of_its_group():
    rows = [(7, 7, 0, True, 0, "seven " * 50_000), *((100 + k, 7, 0, False, k, f"row {k}") for k in range(3000)),
            (7, 7, 1, True, 0, "seven"), (99, 7, 1, False, 0, "row"), (8, 8, 0, True, 0, "eight"), (8, 8, 0, True, 0, "eight again"), (8, 8, 0, True, 0, None), (1, 8, 0, False, 0, "x"), (2, 8, 0, False, 0, "y")]
    out = list(passages._with_partners(iter([batch(rows[:1200]), batch(rows[1200:1201]), batch(rows[1201:-1]), batch(rows[-1:])])))
    got = [(r["a"], r["b"], r["skip"], r["text_a"], r["text_b"]) for part in out for r in part.to_pylist()]
    text = {0: ["seven " * 50_000], 1: ["seven"]}
    want = [(i, b, skip, own, t) for i, b, share, whole, skip, own in rows if not whole for t in (text[share] if b == 7 else ["eight", "eight again", None])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(part.nbytes for part in out) < 2_000_000  # the text of 300 KB is not repeated
    for part in out:
        for slice_, partner, texts in passages._by_partner(part, "text_b"):
            assert [texts[int(p)].as_py() for p in partner] == [r["text_b"] for r in slice_.to_pylist()]


def test_rows_of_a_partner_with_several_groups_are_matched(spark, monkeypatch):
    monkeypatch.setattr(passages, "CROWD", 8)
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(70)
    rows = [(0, words(20) + passage + words(20)), *((k, words(k % 7) + passage[k % 3 :]) for k in range(1, 41)), (50, words(90))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(0, " ".join(words(90)))], "sample_id bigint, content string")
    pairs = spark.createDataFrame([(k, 0) for k in [*range(1, 41), 50]], "a bigint, b bigint")
    found = passages.shared_stretches(pairs, df, 50, 5, passages.SIMILARITY)
    assert sorted(r["a"] for r in found.collect()) == list(range(1, 41))


def test_memory_of_texts_with_many_repeats_is_bounded():
    """Lines that stand often in both texts have very many diagonals; these are laid some at a time."""
    rng = random.Random(9)
    lines = [[f"w{k}_{i}" for i in range(7)] for k in range(20)]
    texts = [[w for _ in range(600) for w in rng.choice(lines)] + [f"s{k}" for k in range(60)] for _ in range(2)]
    a, b = (hashed(t) for t in texts)
    tracemalloc.start()
    found = passages.matching_stretches(a, b, WIDTH, passages.SIMILARITY)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 80e6


def test_windows_with_a_match_meet_at_a_rare_shingle_whatever_is_frequent():
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for _ in range(150):
        shared = words(rng.randint(46, 70)) if rng.random() < 0.7 else words(8) * 8
        texts = []
        for _ in range(2):
            own = list(shared)
            for at in rng.sample(range(len(own)), rng.randint(0, 3)):
                own[at : at + rng.randint(0, 1)] = words(1)
            texts.append((words(rng.randint(0, 20)) + own + words(20))[:95])
        held = [h.astype(np.uint32) for h in map(hashed, texts)]
        at = np.append(0, np.cumsum([len(h) for h in held]))
        for often in (0, 0.3, 0.9):
            marked = set(rng.sample(sorted(set(np.concatenate(held).tolist())), int(often * len(held[0]) / 2)))
            row, value = passages._rarest(np.concatenate(held), at, np.isin(np.concatenate(held), list(marked)), WIDTH, passages.SIMILARITY)
            if covered(*texts)[0]:
                assert set(value[row == 0].tolist()) & set(value[row == 1].tolist())
            assert all(set(value[row == k].tolist()) <= set(held[k].tolist()) for k in (0, 1))


def test_places_of_a_hot_key_travel_in_proportion_to_their_number(spark):
    """400 records hold one line in text of their own; those that share a passage around it still meet."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, sent = words(20), {}
    passage = words(20) + line + words(20)
    for n in (200, 400):
        rows = [(k, words(40) + line + words(40)) for k in range(n)] + [(1000 + k, words(30) + passage[:k] + words(1) + passage[k + 1 :] + words(30)) for k in (1, 58)]
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "sample_id bigint, content string")
        members = settled(passages.key_members(passages.paragraph_keys(df)), "members")
        alone = spark.createDataFrame([], "id bigint, start bigint, end bigint, component struct<id: bigint, start: bigint>")
        found = passages._across(members, alone, df, 50, 5, 0.75, 16)
        assert {(r["a"], r["b"]) for r in found.collect()} == {(1058, 1001)}
        sent[n] = dealt(found)
    assert sent[400] < 3 * sent[200]


def dealt(found):
    """Rows that reach the meeting: what is below its exchange."""
    plan = found.sparkSession._jvm.org.apache.spark.sql.classic.Dataset
    node = found._jdf.queryExecution().analyzed()
    while "RepartitionByExpression" not in node.nodeName():
        node = node.children().apply(0)
    return plan.ofRows(found.sparkSession._jsparkSession, node).count()
