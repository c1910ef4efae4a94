"""Token counts of evidence texts at every prefix, by dynamic programming."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters

#: Words whose prefix counts a task remembers, twice over: a full memory becomes the older one, and its words come back when used.
MEMORY = 400_000
#: A longer word is counted each time anew.
LONGEST_REMEMBERED = 64
#: Code points of one Arrow batch of results, unless one text alone has more.
BATCH_CHARS = 1 << 20

# Fixed value: contractions that the pre-tokeniser takes as one word; cut after two characters they are two words.
CONTRACTIONS = ("'re", "'ve", "'ll")


class PrefixCounter:
    """Counts the tokens of every prefix of a text under one byte-level BPE vocabulary.

    In a word, the encoding of each prefix is the encoding of a shorter one and one token more. The token is
    the one that may follow the shorter prefix's last token: two neighbours are possible exactly where
    merging their joined bytes gives the two again. So `last[i]`, the last token of the first i bytes, follows
    from the entries before it, and `count[i] = count[i - len(last[i])] + 1`. Tokens that start at a place are
    walked from the shortest to where no token goes on; each end has one possible last token.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        value = {letter: byte for byte, letter in enumerate(byte_letters())}
        raw = lambda s: bytes(value[c] for c in s)
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(a), raw(b)] = rank
        # a token that merging does not give back from its own bytes never ends an encoding
        tokens = {t for t in map(raw, model["model"]["vocab"]) if self._merged([t[i : i + 1] for i in range(len(t))]) == [t]}
        # what begins a token: False, or for a token itself what is known of tokens that follow it
        self.starts: dict[bytes, bool | dict[bytes, bool]] = {t[:n]: False for t in tokens for n in range(1, len(t))}
        self.starts.update((t, {}) for t in tokens)
        self.pairs = 0
        self.special = [t["content"] for t in model["added_tokens"]]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        """Merge the lowest rank first; only for the few bytes of one or two tokens."""
        while len(parts) > 1:
            ranks = [self.ranks.get(pair, 1 << 60) for pair in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, a: bytes, b: bytes) -> bool:
        both = a + b
        known = self._merged([both[i : i + 1] for i in range(len(both))]) == [a, b]
        if self.pairs >= MEMORY:
            for follow in self.starts.values():
                if follow:
                    follow.clear()
            self.pairs = 0
        self.pairs += 1
        self.starts[a][b] = known
        return known

    def _word(self, word: str) -> bytes:
        """Counts at the end of every character of one word, as packed 32-bit integers."""
        packed = self.older.get(word)
        if packed is None:
            data = word.encode()
            n = len(data)
            count, size, last = [0] * (n + 1), [0] * (n + 1), [None] * (n + 1)
            starts = self.starts.get
            for start in range(n):
                before, more = last[start], count[start] + 1
                last[start] = None
                for end in range(start + 1, n + 1):
                    token = data[start:end]
                    follow = starts(token)
                    if follow is None:
                        break
                    if follow is not False and not count[end]:
                        if start:
                            known = before.get(token)
                            if not (self._follows(data[start - size[start] : start], token) if known is None else known):
                                continue
                        last[end], count[end], size[end] = follow, more, end - start
            ends = [i for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80] if n > len(word) else range(1, n + 1)
            out = [count[i] for i in ends]
            if word in CONTRACTIONS:
                out[1] = 2
            packed = array("i", out).tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.memory) >= MEMORY:
                self.older, self.memory = self.memory, {}
            self.memory[word] = packed
        return packed

    def _segment(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text in which special tokens are ordinary characters."""
        words = self.words.findall(text)
        if not words:
            return np.zeros(0, np.int32)
        known = list(map(self.memory.get, words))
        if None in known:
            for i, packed in enumerate(known):
                if packed is None:
                    known[i] = self.memory.get(words[i]) or self._word(words[i])
        inner = np.frombuffer(b"".join(known), np.int32)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ends = np.cumsum(sizes)
        totals = inner[ends - 1]
        before = np.cumsum(totals) - totals
        out = inner + np.repeat(before, sizes).astype(np.int32)
        # white space gives its last character to what follows; a prefix that stops there has it still
        for i in [i for i, w in enumerate(words[:-1]) if w.isspace()]:
            if words[i + 1][0].isspace():
                run = words[i] + words[i + 1][0]
                packed = self.memory.get(run) or self._word(run)
                out[ends[i]] = before[i] + np.frombuffer(packed[-4:], np.int32)[0]
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of the first 1, 2, ... code points of the text, each as if the text ended there."""
        if self.split is None or not any(s in text for s in self.special):
            return self._segment(text)
        parts = self.split.split(text)  # text, special token, text, ...
        out, base = [], 0
        for i in range(0, len(parts), 2):
            special = parts[i + 1] if i + 1 < len(parts) else ""
            own = self._segment(parts[i] + special[:-1])  # a special token that is cut off is ordinary text
            out.append(own + base)
            if special:
                whole = len(parts[i])
                base += (int(self._segment(parts[i])[-1]) if whole else 0) + 1
                out.append(np.asarray([base], np.int32))
        return np.concatenate(out).astype(np.int32)


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    """The worker process keeps one, with its memory, from task to task."""
    return PrefixCounter(path)


def longest_prefixes(counts: np.ndarray) -> np.ndarray:
    """For each budget 0, 1, ..., up to the largest count: code points of the longest prefix within it.

    Counts do not only rise ("th" may be two tokens where "the" is one), so the last prefix within the budget counts.
    """
    at = np.zeros(int(counts.max(initial=0)) + 1, np.int32)
    at[counts] = np.arange(1, len(counts) + 1)  # positions ascend, the last one stays
    return np.maximum.accumulate(at)


def prefix_counts(records: DataFrame, tokenizer: str) -> DataFrame:
    """The table of prefix counts of every whole text, from which later questions are answered.

    Reads `sample_id` and `content` of evidence records; `tokenizer` is the path of a byte-level BPE file on
    every worker. Returns one row per input row: `sample_id`, `n_bytes` (UTF-8), `n_tokens`, `prefix_tokens`
    (array of int; element n is the number of tokens of the first n code points, as if the text ended there) and
    `budget_chars` (array of int; element b + 1 is the length of the longest prefix of at most b tokens). Write
    the table once; `tokens_within`, `chars_within` and `truncated` then answer without encoding again.

    Rows are independent, so a lost task is done over alike; a task holds one batch of results and a
    bounded memory of words. Null counts as empty: no tokens, empty `prefix_tokens`, one zero in `budget_chars`.
    A very long text, or a text of one endless word, takes time and memory in proportion to its length. Repeated
    rows and ids have a row each; there are no ties. Further columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    kind = records.select("sample_id").dtypes[0][1]
    ints = pa.list_(pa.int32())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = counter(tokenizer).prefixes

        def packed(ids: pa.Array, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            def lists(k: int) -> pa.Array:
                offsets = np.concatenate(([0], np.cumsum([len(r[k]) for r in rows]))).astype(np.int32)
                return pa.ListArray.from_arrays(offsets, np.concatenate([r[k] for r in rows]).astype(np.int32)).cast(ints)

            totals = [int(r[1][-1]) if len(r[1]) else 0 for r in rows]
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([r[0] for r in rows], pa.int64()), pa.array(totals, pa.int64()), lists(1), lists(2)],
                ["sample_id", "n_bytes", "n_tokens", "prefix_tokens", "budget_chars"])

        for batch in batches:
            ids, texts = batch.column("sample_id"), batch.column("content")
            rows, size, first = [], 0, 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                counts = prefixes(text)
                rows.append((len(text.encode()), counts, longest_prefixes(counts)))
                size += len(text)
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    yield packed(ids.slice(first, i + 1 - first), rows)
                    rows, size, first = [], 0, i + 1

    return records.select("sample_id", "content").mapInArrow(
        work, f"sample_id {kind}, n_bytes bigint, n_tokens bigint, prefix_tokens array<int>, budget_chars array<int>")


def tokens_within(chars: Column, prefix_tokens: str = "prefix_tokens") -> Column:
    """Tokens of the first `chars` code points; more than the text has means the whole text, less than none means none."""
    at = F.least(chars, F.size(prefix_tokens)).cast("int")
    return F.when(at <= 0, F.lit(0)).otherwise(F.try_element_at(prefix_tokens, F.greatest(at, F.lit(1)))).cast("bigint")


def chars_within(budget: Column, budget_chars: str = "budget_chars") -> Column:
    """Code points of the longest prefix of at most `budget` tokens; a negative budget allows none."""
    at = F.least(budget + 1, F.size(budget_chars)).cast("int")
    return F.when(at <= 0, F.lit(0)).otherwise(F.try_element_at(budget_chars, F.greatest(at, F.lit(1)))).cast("bigint")


def truncated(content: Column, budget: Column, budget_chars: str = "budget_chars") -> Column:
    """The longest prefix of the text that encodes to at most `budget` tokens."""
    return F.substring(F.coalesce(content, F.lit("")), F.lit(1), chars_within(budget, budget_chars).cast("int"))
