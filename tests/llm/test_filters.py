"""Interaction of filters: evidence texts and parameter-bank entries against brute force."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from gradeline.llm import filter_audit, queries


def failures(rows):
    """rows: (sample_id, content); the failed letters of each."""
    least = {}
    for i, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text in rows:
        text = text or ""
        w = brute.WORD.findall(text)
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w))
        bad += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        out.append(bad + "E" * (i is not None and least[text] < i))
    return out


def audit(rows, letters):
    """rows: (domain, failed letters, labels); every order played through, record by record."""
    out, taken = {}, defaultdict(int)
    labels = sorted({k for _, _, own in rows for k in own})
    for order in itertools.permutations(letters):
        alive = list(rows)
        gone = []
        for step, x in enumerate(order, 1):
            removed = [r for r in alive if x in r[1]]
            alive = [r for r in alive if x not in r[1]]
            for domain in {r[0] for r in rows}:
                own = lambda rs: [r for r in rs if r[0] == domain]
                out[domain, "".join(order), step] = [
                    len(own(alive)), len(own(removed)), sum(x in r[1] for r in own(gone)), sum(r[1] == x for r in own(rows)),
                    *[sum(r[2][k] for r in own(removed)) for k in labels]]
                taken[domain, x] += len(own(removed))
            gone += removed
    return {(d, o, s): (*v, taken[d, o[s - 1]]) for (d, o, s), v in out.items()}


def found(df, labels):
    return {(r["domain"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in labels], "shapley")) for r in df.collect()}


def test_carry_save_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 10, 1000, 12345):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert filter_audit.positional_popcounts(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]
    assert filter_audit.positional_popcounts(np.full(5000, 0xFFFFFFFF, np.uint32)).tolist() == [5000] * 32


def test_evidence_texts(spark, odd_texts):
    """Nulls, empty and very long texts, repeated rows, null ids and domains, labels that are null or repeat."""
    rng = random.Random(4)
    rows = [*odd_texts, *[(100 + i, t) for i, t in odd_texts], (3, "one"), (None, "one"), (None, "tie tie"), (5, "tie tie"), (5, "tie tie"),
            *[(500 + i, "hot # text") for i in range(400)]]
    rng.shuffle(rows)
    domain = {i: rng.choice(["real", "sim", None, ""]) for i, _ in rows}
    records = spark.createDataFrame(
        [(i, t, domain[i], 1, True, "x") for i, t in rows], "sample_id bigint, content string, domain string, failures int, good boolean, _hash string").repartition(5)
    labels = spark.createDataFrame(
        [(1, True, None), (1, False, True), (3, None, None), (5, True, False), (None, True, True), *[(500 + i, i % 2 == 0, i % 5 == 0) for i in range(100)]],
        "sample_id bigint, good boolean, toxic boolean")
    good, toxic = {1, 5} | {500 + i for i in range(0, 100, 2)}, {1} | {500 + i for i in range(0, 100, 5)}
    failed = filter_audit.text_failures(records)
    bad = failures(rows)
    got = sorted(((r["sample_id"], r["failures"]) for r in failed.collect()), key=str)
    bits = lambda s: sum(1 << "ABCDE".index(x) for x in s)
    assert got == sorted(((i, bits(b)) for (i, _), b in zip(rows, bad)), key=str)
    assert filter_audit.text_failures(records, ["good"]).columns == ["sample_id", "domain", "good", "failures"]
    want = audit([(domain[i] or "", b, {"good": i in good, "toxic": i in toxic}) for (i, _), b in zip(rows, bad)], "ABCDE")
    survivors = filter_audit.subset_survivors(filter_audit.labelled(failed, labels, ["good", "toxic"]), 5, ["good", "toxic"])
    assert found(filter_audit.interactions(survivors, "ABCDE", ["good", "toxic"]), ["good", "toxic"]) == want


def test_bank_entries(spark):
    """Bounds of a parameter bank per site, three filters and no labels; an empty bank."""
    rng = random.Random(9)
    rows = [(i, rng.choice(["s1", "s2"]), rng.choice([1.0, 20.0, None]), rng.choice([0.0, 900.0]), rng.choice([1.0, 700.0])) for i in range(300)]
    bank = spark.createDataFrame(rows, "entry_id bigint, site string, C double, loc double, scale double")
    bounds = {"C": F.col("C") > 10, "L": F.abs("loc") > 500, "S": F.col("scale") > 500}
    want = audit([(site, "C" * ((c or 0) > 10) + "L" * (abs(loc) > 500) + "S" * (scale > 500), {}) for _, site, c, loc, scale in rows], "CLS")
    assert found(filter_audit.audit_records(bank, bounds, F.col("site")), []) == want
    assert filter_audit.audit_records(bank.limit(0), bounds, F.col("site")).count() == 0
    with pytest.raises(ValueError):
        filter_audit.subset_survivors(bank, 6)


def test_query(spark, small_dir, documents):
    text = dict(documents)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    label = {r["doc_id"]: r for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    rows = list(text.items())
    has = lambda i, k: i in label and label[i][k] == 1
    want = audit([(langs[i] or "", b, {"good": has(i, "quality"), "toxic": has(i, "toxic")}) for (i, _), b in zip(rows, failures(rows))], "ABCDE")
    got = queries.QUERIES["op11_filter_audit"](spark, small_dir)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert found(got.withColumnRenamed("part", "domain"), ["good", "toxic"]) == want
