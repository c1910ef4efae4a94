"""Prefix counts against the tokenizers library, prefix by prefix."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import queries, token_counts

PIECES = ["the", "th", "ing", " ", "  ", "\n", "\n\n", "\t", "'re", "'r", "'s", "'ve", "don't", "'", "!!", "é", "東京", "\U0001F600", "\x1c", "\x85", "　",
          "\xa0", "12", "a", "Z", "<|endoftext|>", "<|end", "|>", "\r\n", "é", "_", "...", "===", " the", "'S", "\x0b", "Ⅷ", "​"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(queries.tokenizer_path())
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(queries.tokenizer_path())


def want(library, text):
    return [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]


def test_every_prefix(library, counter):
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert counter.prefixes(text).tolist() == want(library, text), text
    for part in ("a", "=", "1", " ", "\n", "é", "-= ", "AKIA"):
        text = part * 40 + "x"
        assert counter.prefixes(text).tolist() == want(library, text), text


def test_longest_prefix_of_every_budget(library, counter):
    for text in ("the thing in there", "strawberries  and\n\ncream <|endoftext|> again", ""):
        counts = [0, *want(library, text)]
        got = token_counts.longest_prefixes(counter.prefixes(text)).tolist()
        assert got == [max(i for i, c in enumerate(counts) if c <= b) for b in range(max(counts) + 1)]
    assert token_counts.longest_prefixes(np.asarray([1, 2, 1, 2], np.int32)).tolist() == [0, 3, 4]


def test_a_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 5)
    own = token_counts.PrefixCounter(queries.tokenizer_path())
    text = "the quick brown fox jumps over the lazy dog, the quick brown foxes do not"
    assert own.prefixes(text).tolist() == want(library, text) == own.prefixes(text).tolist()


def test_odd_records(spark, library, odd_records, odd_texts, no_records):
    path = queries.tokenizer_path()
    table = token_counts.prefix_counts(odd_records, path)
    asked = table.select(
        "*", *[token_counts.tokens_within(F.lit(n)).alias(f"t{n}") for n in (-1, 0, 1, 7, 10**9)],
        *[token_counts.chars_within(F.lit(n)).alias(f"c{n}") for n in (-1, 0, 3, 10**9)])
    found = {r["sample_id"]: r for r in asked.collect()}
    for i, text in odd_texts:
        text, r = text or "", found[i]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], len(r["prefix_tokens"]), len(r["budget_chars"]) > n) == (len(text.encode()), n, len(text), True), i
        assert r["t-1"] == r["t0"] == r["c-1"] == r["c0"] == 0 and r[f"t{10**9}"] == n and r[f"c{10**9}"] == len(text), i
        head = want(library, text[:60])
        assert r["prefix_tokens"][:60] == head and r["t7"] == (head[min(7, len(head)) - 1] if head else 0), i
    cut = {r["sample_id"]: r["cut"] for r in table.join(odd_records.select("sample_id", "content"), "sample_id").select(
        "sample_id", token_counts.truncated(F.col("content"), F.lit(3)).alias("cut")).collect()}
    for i, text in odd_texts:
        if len(text or "") < 100:
            counts = [0, *want(library, text or "")]
            assert cut[i] == (text or "")[: max(k for k, c in enumerate(counts) if c <= 3)]
    assert token_counts.prefix_counts(no_records, path).count() == 0


def test_query(spark, library, small_dir, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_token_counts"](spark, small_dir).collect()}
    for i, text in documents:
        text = text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(text.encode()), n, n > 1024)
        assert got[i]["limit_chars"] == len(text) or len(library.encode(text[: got[i]["limit_chars"]], add_special_tokens=False).ids) <= 1024
