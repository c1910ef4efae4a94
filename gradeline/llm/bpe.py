"""Byte-level byte-pair encoding and decoding of evidence texts with a given vocabulary file."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

# Fixed value: the pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers, twice over: a full memory becomes the older one, and its words come back when used.
MEMORY = 300_000
IDS, TEXT = itemgetter(0), itemgetter(1)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Vocabulary, merge ranks and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab = model["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = [vocab[x] for x in letters]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        value = {x: b for b, x in enumerate(letters)}
        self.strings = {i: bytes(value[c] for c in s) for s, i in vocab.items()}
        self.special = {}
        for token in model["added_tokens"]:
            self.special[token["content"]] = token["id"]
            self.strings[token["id"]] = token["content"].encode()
        self.words = regex.compile(PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.memory: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token.

        Symbols form a doubly linked list; a heap holds (rank, position, right symbol) of mergeable
        neighbours. The lowest rank, then the leftmost, merges first. An entry whose symbols have changed
        since it was pushed is stale and skipped.
        """
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get(ids[i] << 32 | ids[i + 1])
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get(new << 32 | ids[k])
                if found:
                    heapq.heappush(heap, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get(ids[h] << 32 | new)
                if found:
                    heapq.heappush(heap, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def _remember(self, word: str) -> tuple[tuple[int, ...], str]:
        """Ids of a word and their decimal text, from the older memory or merged anew."""
        out = self.older.get(word)
        if out is None:
            ids = self.merge(word.encode())
            out = tuple(ids), ",".join(map(str, ids))
        if len(word) <= 64:
            if len(self.memory) >= MEMORY:
                self.older, self.memory = self.memory, {}
            self.memory[word] = out
        return out

    def encoded(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """Ids of each word of the whole text, with their decimal text; a special token's string in it is that token."""
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        out: list[tuple[tuple[int, ...], str]] = []
        for part in parts:
            if part in self.special:
                out.append(((self.special[part],), str(self.special[part])))
                continue
            words = self.words.findall(part)
            known = list(map(self.memory.get, words))
            if None in known:
                for i, found in enumerate(known):
                    if found is None:
                        known[i] = self.memory.get(words[i]) or self._remember(words[i])
            out += known
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(IDS, self.encoded(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


class Lengths:
    """Token counts of texts, where nothing is asked of the ids: words not met lately are counted by the tokenizer library."""

    def __init__(self, path: str):
        self.codec, self.model = Codec(path), Tokenizer.from_file(path).model
        self.letters = dict(enumerate(byte_letters()))
        self.memory: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _remember(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = len(self.model.tokenize(word.encode().decode("latin-1").translate(self.letters)))
        if len(word) <= 64:
            if len(self.memory) >= MEMORY:
                self.older, self.memory = self.memory, {}
            self.memory[word] = n
        return n

    def count(self, text: str) -> int:
        codec = self.codec
        parts = codec.split.split(text) if codec.split and any(s in text for s in codec.special) else [text]
        total = 0
        for part in parts:
            if part in codec.special:
                total += 1
                continue
            words = codec.words.findall(part)
            known = list(map(self.memory.get, words))
            if None in known:
                known = [self.memory.get(w) or self._remember(w) if n is None else n for w, n in zip(words, known)]
            total += sum(known)
        return total


@lru_cache(maxsize=1)
def lengths_of(path: str) -> Lengths:
    """The worker process keeps one, with its memory, from task to task."""
    return Lengths(path)


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """The worker process keeps one, with its memory, from task to task."""
    return Codec(path)


def encode_texts(records: DataFrame, tokenizer: str) -> DataFrame:
    """Token ids of every whole text, and the text decoded from them.

    Reads `sample_id`, `content`; `tokenizer` is the path of a byte-level BPE file on every worker.
    Returns one row per input row: `sample_id`, `ids` (array of int), `decoded`. Rows are independent:
    a lost task is done over alike, and memory holds one text and a bounded memory of words.

    Null counts as empty and has no ids. Repeated rows and ids have a row each; equal ranks merge from
    the left. Further columns are ignored. An empty table gives an empty result.
    """
    def run(codec: Codec, text: str) -> tuple[list[int], str]:
        ids = codec.encode(text)
        return ids, codec.decode(ids)

    return _map(records, tokenizer, run, [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())])


def encode_ids(records: DataFrame, tokenizer: str) -> DataFrame:
    """As `encode_texts`, the ids alone: `sample_id`, `ids`."""
    return _map(records, tokenizer, lambda codec, text: (codec.encode(text),), [("ids", "array<int>", pa.list_(pa.int32()))])


def count_tokens(records: DataFrame, tokenizer: str) -> DataFrame:
    """As `encode_texts`, the number of tokens alone: `sample_id`, `n_tokens`."""
    return _map(records, tokenizer, lambda lengths, text: (lengths.count(text),), [("n_tokens", "bigint", pa.int64())], lengths_of)


def encode_digests(records: DataFrame, tokenizer: str) -> DataFrame:
    """As `encode_texts`, with the results as digests made where they arise: `n_tokens`, `ids_sha256`, `decoded_sha256`."""
    def run(codec: Codec, text: str) -> tuple[int, str, str]:
        found = codec.encoded(text)
        ids = list(chain.from_iterable(map(IDS, found)))
        return len(ids), hashlib.sha256(",".join(map(TEXT, found)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()

    return _map(records, tokenizer, run, [
        ("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())])


def _map(records: DataFrame, tokenizer: str, run, fields, reader=codec_of) -> DataFrame:
    kind = records.select("sample_id").dtypes[0][1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = reader(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [run(codec, text.as_py() or "") for text in part.column("content")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("sample_id"), *[pa.array([r[i] for r in rows], f[2]) for i, f in enumerate(fields)]],
                    ["sample_id", *[f[0] for f in fields]])

    return records.select("sample_id", "content").mapInArrow(work, f"sample_id {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in fields))
