"""Word and shingle hashes of Arrow string columns, computed a slice at a time with NumPy.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lowered. A word's hash is a
polynomial over its bytes, taken for all words of a block from one running sum; the sum is undone
with the inverse powers of the odd base. Shingles combine the hashes of consecutive words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C55
_ODD = np.random.RandomState(7).randint(1, 1 << 62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising step of a 64-bit hash: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(BLOCK + 1, base, np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def slices(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice stay near `SLICE_BYTES`; a longer text stands alone."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for name in columns:
            size += pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(size), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its texts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each text's first word (one more at the end)."""
    inside = ~_IS_SPACE[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    finishes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverses = _tables()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        block = _LOWER[data[low : ends[j - 1]]]
        if len(block) > BLOCK:
            out[i] = int.from_bytes(hashlib.blake2b(block.tobytes(), digest_size=8).digest(), "big")
        else:
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * powers[: len(block)], out=total[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = mix((total[e] - total[s]) * inverses[s] + (e - s).astype(np.uint64) * _ODD[8])
        i = j
    return out


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position; the last `size - 1` positions have none."""
    count = max(0, len(words) - size + 1)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out += words[k : k + count] * _ODD[k]
    return mix(out)


def text_shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text, with repeats, and their bounds.

    A text with fewer words than `size` has its whole sequence as one shingle; one without words has none.
    """
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    position = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    full = np.repeat(n >= size, counts)
    out = np.empty(bounds[-1], np.uint64)
    out[full] = rolling(words, size)[position[full]]
    for t in np.flatnonzero((n > 0) & (n < size)):
        own = words[first[t] : first[t + 1]]
        out[bounds[t]] = mix((own * _ODD[16 : 16 + len(own)]).sum(dtype=np.uint64, keepdims=True) + _ODD[24 + len(own)])[0]
    return out, bounds


def distinct_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    values, bounds = text_shingles(column, size)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of `n` fixed hash permutations."""
    rng = np.random.RandomState(20260)
    draw = lambda: rng.randint(0, 1 << 32, n).astype(np.uint64) << np.uint64(32) | rng.randint(0, 1 << 32, n).astype(np.uint64)
    return draw() | np.uint64(1), draw()


def band_shape(threshold: float, recall: float, values: int) -> tuple[int, int]:
    """(bands, rows per band) over at most `values` signature values.

    The most selective rows count whose bands still find a pair at the threshold with probability `recall`.
    """
    for rows in range(values, 0, -1):
        bands = values // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("no banding of so few values reaches that recall")
