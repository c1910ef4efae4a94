"""Passages that evidence texts share: MinHash banding of paragraph-long stretches, verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .records import settled
from .shingles import SLICE_BYTES, band_shape, mix, permutations, rolling, slices, text_bytes, word_bounds, word_hashes

SHINGLE = 5
SIMILARITY = 0.75
#: Words of a paragraph: a stretch of so many words may start at any word, wherever lines break.
PARAGRAPH = 50
#: Hash values a stretch may spend on bands, and the least probability that they find a pair at the threshold.
VALUES, RECALL = 3, 0.98
#: Code points that travel on either side of the stretches in common, to find whether a pair matches there.
MARGIN = 400
#: Places of shingles that are laid on diagonals at a time.
STEP = 1 << 16
#: Places of a key on one side of a block when they are compared with each other.
BLOCK = 2048
#: Rows of one partner that meet its text in one group, about.
CROWD = 1024
#: One of so many places of a large key tells which of its shingles are frequent, and so many are told at most.
DRAWN, OFTEN = 16, 1024
#: Blocks of places of a key from which on its places meet at rarer shingles instead, as blocks that meet all blocks grow with the square.
LARGE = 4


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if width > span else v


def _at(values: np.ndarray, places: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The values at some places, -1 where a place is not inside its text."""
    return np.where(inside, values[np.clip(places, 0, len(values) - 1)], -1)


def _text_rolls(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes at every word of a slice, words' byte bounds, first word of each text, code point at each byte."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_bounds(data, offsets)
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    base = point[offsets[:-1]]
    return rolling(word_hashes(data, starts, ends), shingle), point[starts], point[ends], first, base


def paragraph_keys(records: DataFrame, paragraph: int = PARAGRAPH, shingle: int = SHINGLE,
                   threshold: float = SIMILARITY, values: int = VALUES, recall: float = RECALL) -> DataFrame:
    """(sample_id, key, before, after, low, high): the band keys of all stretches of a record, once for each place.

    `low` and `high` bound the code points of neighbouring stretches with that key, at most as many as a
    stretch has shingles. Neighbouring stretches mostly have the same least shingle, so a text has few keys. `before` and `after` are 16 bits of the least
    hash in half a stretch on either side of the shingle that gave the key, null where the text ends
    sooner. Two copies of a stretch agree on one of them, as one half lies inside the stretch.
    """
    bands, rows = band_shape(threshold, recall, values)
    width = paragraph - shingle + 1
    half = max(1, (width - 1) // 2)
    kind = records.select("sample_id").dtypes[0][1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, plus = permutations(bands * rows + 1)
        for batch in slices(batches, "content"):
            rolls, begin, finish, first, base = _text_rolls(batch.column("content"), shingle)
            if len(rolls) < width:
                continue
            n = np.maximum(np.diff(first) - paragraph + 1, 0)
            at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            text = np.repeat(np.arange(len(n)), n)
            if not len(at):
                continue
            around = (mix(_sliding_min(rolls * mult[-1] + plus[-1], half)) & np.uint64(0x7FFF)).astype(np.int16)
            for b in range(bands):
                key = np.full(len(at), b + 1, np.uint64)
                for k in range(b * rows, (b + 1) * rows):
                    hashed = rolls * mult[k] + plus[k]
                    least = _sliding_min(hashed, width)
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[at])
                fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
                since = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                opens = np.flatnonzero((np.arange(len(at)) - since) % width == 0)
                closes = np.concatenate((opens[1:], [len(at)])) - 1
                own, start = text[opens], at[opens]
                low, high = begin[start] - base[own], finish[at[closes] + paragraph - 1] - base[own]
                place = start + np.argmax(hashed[start[:, None] + np.arange(width)] == least[start][:, None], axis=1)
                sides = [_at(around, place - half, place - half >= first[own]), _at(around, place + 1, place + half + shingle <= first[own + 1])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("sample_id").take(pa.array(own)), pa.array(key[opens].view(np.int64)),
                    *[pa.array(c, mask=c < 0) for c in sides], pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                    ["sample_id", "key", "before", "after", "low", "high"])

    return records.select("sample_id", "content").where("sample_id is not null").mapInArrow(work, f"sample_id {kind}, key bigint, before smallint, after smallint, low int, high int")


def key_members(keys: DataFrame) -> DataFrame:
    """The places of all keys that several records have, with the key's smallest id `b` and its number of places `n`.

    Most keys have one place, so nothing is gained from a sum before the exchange: all places are exchanged once.
    """
    key = Window.partitionBy("key")
    told = keys.withColumns({"b": F.min("sample_id").over(key), "n": F.count("*").over(key), "_last": F.max("sample_id").over(key)})
    return told.where("b < _last").drop("_last")


def candidate_pairs(members: DataFrame) -> DataFrame:
    """(a, b, low, high): the records of a key and its smallest id, and where several records have a key,
    also those that have the context on one side in common and the smallest of these.

    The smallest id of a key may hold its shingle in a sentence of its own. The records of one passage
    share a context with the key and meet there. `members` are those of `key_members`.
    """
    met = members.where("sample_id <> b").select("sample_id", "b", "low", "high")
    for side in ("before", "after"):
        rows = members.where(F.col("n") > 2).where(F.col(side).isNotNull()).select("sample_id", "b", "key", side, "low", "high")
        closer = rows.groupBy("key", side).agg(F.min("sample_id").alias("c"), F.count("*").alias("m")).where("m > 1").drop("m")
        met = met.unionAll(rows.join(closer.hint("shuffle_hash"), ["key", side]).where("sample_id <> c and c <> b").select("sample_id", "c", "low", "high"))
    return met.groupBy(F.col("sample_id").alias("a"), "b").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after the other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())


def _slots(v: np.ndarray, bits: int) -> np.ndarray:
    """Hash slots of values in a table of so many bits."""
    return ((v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _twice(v: np.ndarray) -> np.ndarray:
    """Places of all values that stand more than once, and of a few others."""
    bits = len(v).bit_length() + 2
    slot, last, hot = _slots(v, bits), np.empty(1 << bits, np.int32), np.zeros(1 << bits, bool)
    at = np.arange(len(v), dtype=np.int32)
    last[slot] = at
    hot[slot[last[slot] != at]] = True
    return np.flatnonzero(hot[slot])


def _sharing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all values of `a` that stand in `b` and of all of `b` that stand in `a`, and of a few others."""
    bits = max(len(a), len(b)).bit_length() + 3
    x, y = _slots(a, bits), _slots(b, bits)
    in_a, in_b = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
    in_a[x] = in_b[y] = True
    return np.flatnonzero(in_b[x]), np.flatnonzero(in_a[y])


def _covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of `size` places stretches of some starts cover."""
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(starts + width, minlength=size + 1)
    return np.cumsum(steps)[:size] > 0


def _neighbours(v: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of each value's last place before and next place after, -1 and `far` where there is none."""
    some = _twice(v)
    order = some[np.argsort(v[some], kind="stable")]
    before, after = np.full(len(v), -1), np.full(len(v), far)
    same = v[order[1:]] == v[order[:-1]]
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    return before, after


def _repeats(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of every `width` neighbours, and the first of the consecutive stretches with the same set."""
    n = len(v) - width + 1
    before, after = _neighbours(v, len(v) + width)
    i = np.flatnonzero((before >= 0) & (np.arange(len(v)) - before < width))
    steps = np.bincount(np.maximum(i - width + 1, 0), minlength=len(v) + 1) - np.bincount(before[i] + 1, minlength=len(v) + 1)
    s = np.arange(n - 1)
    alike = np.concatenate(([False], (after[s] <= s + width) & (before[s + width] >= s)))
    return width - np.cumsum(steps)[:n], np.maximum.accumulate(np.where(alike, 0, np.arange(n)))


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distinct values that each row of `x` has in common with the same row of `y`."""
    both = np.sort(np.concatenate((2 * x, 2 * y + 1), axis=1), axis=1)
    return ((both[:, :-1] & 1 == 0) & (both[:, 1:] == both[:, :-1] + 1)).sum(axis=1)


def matching_stretches(a: np.ndarray, b: np.ndarray, width: int, threshold: float) -> list[tuple[int, int, int, int]]:
    """Runs (start, end, start there, end there) of shingles of `a` whose stretches have a match in `b`."""
    ends = lambda v: np.array([0, len(v)])
    return list(zip(*(c.tolist() for c in matching_runs(a, ends(a), b, ends(b), np.zeros(1, np.int64), width, threshold)[1:])))


def matching_runs(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, partner: np.ndarray, width: int, threshold: float,
                  turned: bool = False) -> np.ndarray:
    """Runs (text, start, end, start there, end there) of shingles of many texts whose stretches have a match in the partner.

    The shingles of the texts stand one after the other in `a`, bounded by `a_at`, those of the partners in
    `b`; `partner` names the one of each text. A stretch is laid on the partner on every diagonal on which
    one of its shingles has a place there, and every place where the sets of shingles of both stretches have a
    Jaccard similarity of `threshold` is a match. Consecutive stretches with one set are compared once;
    for a text with some, the stretches of the partner are laid on the text as well. Matching stretches of a
    diagonal that overlap join.
    """
    none = np.zeros((5, 0), np.int64)
    if len(a) < width or len(b) < width:
        return none
    text, length_b = np.repeat(np.arange(len(a_at) - 1), np.diff(a_at)), np.diff(b_at)
    # shingles meet those of the partner only
    a = a.astype(np.uint64) ^ mix(partner.astype(np.uint64))[text]
    b = b.astype(np.uint64) ^ np.repeat(mix(np.arange(len(length_b), dtype=np.uint64)), length_b)
    some_a, some_b = _sharing(a, b)
    if not len(some_a):
        return none
    known, some_code = np.unique(b[some_b], return_inverse=True)
    near = np.minimum(np.searchsorted(known, a[some_a]), len(known) - 1)
    own, code = np.full(len(a), -1), np.full(len(b), -2)
    own[some_a], code[some_b] = np.where(known[near] == a[some_a], near, -1), some_code
    hit = own >= 0
    # equal shingles of two texts with one partner are no repeats
    size_a, first_a = _repeats(a ^ mix(np.arange(1, len(a_at), dtype=np.uint64) << np.uint64(32))[text], width)
    share = threshold / (1 + threshold)
    total = np.concatenate(([0], np.cumsum(hit)))
    met = total[width:] - total[:-width]  # shingles with a place in the partner, repeats included
    at = np.arange(len(met))
    inside = (at + width <= a_at[1:][text[at]]) & (length_b[partner[text[at]]] >= width)
    good = np.flatnonzero((met >= np.ceil(threshold * size_a - 1e-9)) & (first_a == at) & inside)
    if not len(good):
        return none
    size_b, first_b = _repeats(b, width)
    last_a, last_b = (np.append(np.flatnonzero(np.diff(f)), len(f) - 1) for f in (first_a, first_b))
    taken = np.zeros(len(known), bool)
    taken[own[hit]] = True
    mark = np.zeros(len(b) + 1, np.int64)
    mark[some_b + 1] = taken[some_code]
    total = np.cumsum(mark)
    good_b = np.flatnonzero(total[width:] - total[:-width] >= np.ceil(threshold * size_b - 1e-9))
    near_a, near_b = (_covered(g, width, len(v)) for g, v in ((good, a), (good_b, b)))
    kept = near_b[some_b]  # a place outside of these has no match over it
    places = some_b[kept][np.argsort(some_code[kept], kind="stable")]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(some_code[kept], minlength=len(known)))))
    low_b, high_b = b_at[partner][text], (b_at[partner + 1] - width)[text]
    good_before = np.searchsorted(good, np.arange(len(a) + 1))
    asked = np.flatnonzero(hit & near_a)
    asked = asked[bounds[own[asked] + 1] > bounds[own[asked]]]
    if not len(asked):
        return none
    count = bounds[own[asked] + 1] - bounds[own[asked]]
    done = np.cumsum(count)
    out, low, bits = [], 0, (len(a) + len(b) + 2 * width).bit_length()
    rest = (1 << bits) - 1
    while low < len(asked):
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + STEP, "right")))
        i, n = asked[low:high], count[low:high]
        place = places[_ranges(bounds[own[i]], n)]
        i = np.repeat(i, n)
        vote = np.sort((place - i + len(a) << bits) + i)
        diagonal, i = vote >> bits, vote & rest
        since = np.where(np.concatenate(([False], diagonal[1:] == diagonal[:-1])), np.concatenate(([0], i[:-1])) + 1, 0)
        lo = good_before[np.maximum(i - width + 1, since)]
        n = np.maximum(good_before[i + 1] - lo, 0)
        for few in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // (8 * STEP))) + 1):
            s, d, led = good[_ranges(lo[few], n[few])], np.repeat(diagonal[few], n[few]), np.repeat(few, n[few])  # a pair comes up at its first place
            laid = s + d - len(a)
            t = np.clip(laid, low_b[s], high_b[s])
            votes = np.searchsorted(vote, (d << bits) + s + width) - led
            least = np.ceil(share * (size_a[s] + size_b[t]) - 1e-9)
            sure = (votes >= least) & (size_a[s] == width) & (laid == t)
            open_ = ~sure & (met[s] >= least)
            if open_.any():
                s_t = np.unique((s[open_] << bits) + first_b[t[open_]])
                for part in np.array_split(s_t, len(s_t) // 8192 + 1):
                    x, y = part >> bits, part & rest
                    yes = _common(own[x[:, None] + np.arange(width)], code[y[:, None] + np.arange(width)]) >= np.ceil(share * (size_a[x] + size_b[y]) - 1e-9)
                    out.append(np.stack((x[yes], y[yes])))
            out.append(np.stack((s[sure], first_b[t[sure]])))
        low = high
    s, t = np.concatenate(out, axis=1)
    s_t = np.unique((t - s + len(a) << bits) + s)
    s, d = s_t & rest, (s_t >> bits) - len(a)
    t = s + d
    found = none
    if len(s):
        s_end, t_end = last_a[np.searchsorted(last_a, s)], last_b[np.searchsorted(last_b, t)]
        opens = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 0) | (s[1:] - s_end[:-1] > width) | (text[s[1:]] != text[s[:-1]]))))
        of, (w, y), (x, z) = text[s[opens]], (np.minimum.reduceat(c, opens) for c in (s, t)), (np.maximum.reduceat(c, opens) + width for c in (s_end, t_end))
        found = np.stack((of, w - a_at[of], x - a_at[of], y - b_at[partner[of]], z - b_at[partner[of]]))
    again = np.zeros(0, np.int64) if turned else np.intersect1d(text[good], text[np.flatnonzero((first_a != at) & inside)])
    size = a_at[again + 1] - a_at[again] + length_b[partner[again]]
    for few in np.split(again, np.flatnonzero(np.diff(np.cumsum(size) // STEP)) + 1) if len(again) else []:
        n, m = a_at[few + 1] - a_at[few], length_b[partner[few]]
        back = matching_runs(b[_ranges(b_at[partner[few]], m)], np.append(0, np.cumsum(m)), a[_ranges(a_at[few], n)], np.append(0, np.cumsum(n)),
                             np.arange(len(few)), width, threshold, True)
        found = np.concatenate((found, np.stack((few[back[0]], *back[[3, 4, 1, 2]]))), axis=1)
    return found


def _text_shingles(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, bounds of the texts among them, code points where each shingle starts and ends."""
    rolls, begin, finish, first, base = _text_rolls(column, shingle)
    n = np.maximum(np.diff(first) - shingle + 1, 0)
    at, skip = _ranges(first[:-1], n), np.repeat(base, n)
    return rolls[at], np.append(0, np.cumsum(n)), begin[at] - skip, finish[at + shingle - 1] - skip


def _by_partner(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Slices of a batch, with the partner of each row and the partners' texts; neighbours with one text in the column share it.

    The column may be a dictionary, in which a text stands once.
    """
    own, text = batch.column("text_a"), batch.column(column)
    fresh = np.ones(batch.num_rows, bool)
    if pa.types.is_dictionary(text.type):
        code, text = text.indices.to_numpy(), text.dictionary
        fresh[1:] = code[1:] != code[:-1]
    else:
        code = np.arange(batch.num_rows)
        fresh[1:] = ~pc.equal(text[1:], text[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
    size = lambda c: pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cell = np.cumsum(size(own) + np.where(fresh, size(text)[code], 0)) // SLICE_BYTES
    edges = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [batch.num_rows]))
    for low, high in zip(edges[:-1], edges[1:]):
        new = fresh[low:high].copy()
        new[:1] = True
        yield batch.slice(low, high - low), np.cumsum(new) - 1, text.take(pa.array(code[low + np.flatnonzero(new)]))


def _with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, skip, text_a, text_b) of the rows of sorted groups (b, share), whose partner's text comes first, with `whole`.

    `text_b` is a dictionary, and a text that is open stays for the rows to come: no text is repeated, however many rows
    meet it. A partner's id with several texts has each of them meet each row.
    """
    last, held = None, None
    for batch in slices(batches, "text"):
        b, share, whole = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "share", "whole"))
        group = np.cumsum(np.concatenate(([False], (b[1:] != b[:-1]) | (share[1:] != share[:-1]))))
        texts, of = batch.column("text").filter(pa.array(whole)), group[whole]
        if last == (b[0], share[0]):
            texts, of = pa.concat_arrays([held, texts]), np.concatenate((np.zeros(len(held), np.int64), of))
        rows = np.flatnonzero(~whole)
        first = np.searchsorted(of, group[rows])
        n = np.searchsorted(of, group[rows], "right") - first
        rows, partner = np.repeat(rows, n), _ranges(first, n)
        if len(rows) > len(n):
            order = np.argsort(partner, kind="stable")
            rows, partner = rows[order], partner[order]
        if len(rows):
            asked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*(asked.column(c) for c in ("id", "b", "skip", "text")), pa.DictionaryArray.from_arrays(pa.array(partner), texts)],
                                             ["a", "b", "skip", "text_a", "text_b"])
        last, held = (b[-1], share[-1]), texts.filter(pa.array(of == group[-1]))
        held = pc.unique(held) if len(held) > 1 else held


def shared_stretches(pairs: DataFrame, records: DataFrame, paragraph: int, shingle: int, threshold: float) -> DataFrame:
    """(a, a_start, a_end, b, b_start, b_end) in code points, for pairs (a, b) of records.

    Where pairs have `low` and `high`, only that part of `a` and a margin travel to `b`, which decides
    whether their common keys stand in a match; otherwise whole texts meet. Texts meet what is asked of
    them once. Rows of one `b` come in groups of about `CROWD` rows, in which its text stands once, ahead of
    them; it is hashed once for those of a slice. `pairs` should be cheap to read.
    """
    texts = records.select(F.col("sample_id").alias("_id"), F.col("content").alias("_text")).where("_id is not null")
    part = "low" in pairs.columns
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("shares"))
    skip = F.greatest(F.lit(0), F.col("low") - MARGIN) if part else F.lit(0)
    size = F.col("high") + MARGIN - skip if part else F.lit(None).cast("int")
    share = F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1)).cast("bigint")).cast("int")
    asked = pairs.join(shares.where("shares > 1"), "b", "left").select(F.col("a").alias("id"), "b", share.alias("share"), F.lit(False).alias("whole"), skip.alias("skip"), size.alias("size"))
    asked = asked.unionAll(shares.select("b", "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)), F.lit(True), F.lit(0), F.lit(None).cast("int")))
    sent = F.when(F.col("size").isNull(), F.col("_text")).otherwise(F.substring("_text", F.col("skip") + 1, F.col("size")))
    both = texts.join(asked, F.col("_id") == F.col("id")).select("id", "b", "share", "whole", "skip", sent.alias("text"))
    both = both.repartition("b", "share").sortWithinPartitions("b", "share", F.desc("whole"))
    width = paragraph - shingle + 1
    kind = pairs.select("a").dtypes[0][1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _with_partners(batches):
            for rows, partner, texts_b in _by_partner(batch, "text_b"):
                (x, x_at, *x_point), (y, y_at, *y_point) = _text_shingles(rows.column("text_a"), shingle), _text_shingles(texts_b, shingle)
                i, s, e, s2, e2 = matching_runs(x, x_at, y, y_at, partner, width, threshold)
                if len(i):
                    skipped, take = rows.column("skip").to_numpy()[i], pa.array(i)
                    s, e, s2, e2 = x_at[i] + s, x_at[i] + e - 1, y_at[partner[i]] + s2, y_at[partner[i]] + e2 - 1
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("a").take(take), pa.array(skipped + x_point[0][s]), pa.array(skipped + x_point[1][e]),
                         rows.column("b").take(take), pa.array(y_point[0][s2]), pa.array(y_point[1][e2])],
                        ["a", "a_start", "a_end", "b", "b_start", "b_end"])

    return both.mapInArrow(work, f"a {kind}, a_start bigint, a_end bigint, b {kind}, b_start bigint, b_end bigint")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int = 1 << 12) -> Iterator[pa.Table]:
    """Tables of at least so many rows, the last one but for it, that cut no group of rows with equal leading columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table.column(i).to_numpy() for i in range(keys)]
        last = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _reaches(x: np.ndarray, y: np.ndarray, hashes: np.ndarray, at: np.ndarray, gap: np.ndarray, size: np.ndarray, least: np.ndarray,
             width: int, threshold: float) -> np.ndarray:
    """Whether a stretch of each window of `x` has so many distinct shingles in the window of `y` that it may match there.

    `x` and `y` are rows, whose windows lie in `hashes` and are bounded by `at`; `gap` leads to the place before with the same
    shingle in a window, if it is nearer than `width`, `size` and `least` count the distinct shingles of stretches.
    """
    of = np.arange(len(x), dtype=np.uint64) << np.uint64(32)
    n, m = at[x + 1] - at[x], at[y + 1] - at[y]
    place = _ranges(at[x], n)
    own, other = hashes[place] | np.repeat(of, n), np.sort(hashes[_ranges(at[y], m)] | np.repeat(of, m))
    shared = other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own
    total, i = np.concatenate(([0], np.cumsum(shared))), np.flatnonzero(shared & (gap[place] > 0))
    twice = np.bincount(np.maximum(i - width + 1, 0), minlength=len(own) + 1) - np.bincount(i - gap[place[i]] + 1, minlength=len(own) + 1)
    met = total[width:] - total[:-width] - np.cumsum(twice)[: len(own) - width + 1]  # stretches over two places count one of them
    row, sizes = np.repeat(np.arange(len(x)), n)[: len(met)], size[place[: len(met)]]
    share = threshold / (1 + threshold)
    near = (np.arange(len(met)) + width <= np.cumsum(n)[row]) & (met >= share * (sizes + least[y][row]) - 1e-9) & (met >= threshold * sizes - 1e-9)
    return np.bincount(row[near], minlength=len(x)) > 0


def _window_shingles(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all windows, one after the other, and their bounds."""
    column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    return np.frombuffer(column.buffers()[2], np.uint32)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _meeting(hashes: np.ndarray, row: np.ndarray, group: np.ndarray, segment: np.ndarray, lacking: np.ndarray) -> np.ndarray:
    """Pairs x * rows + y of rows of a group, from different segments, that have a shingle in common beside their most frequent ones.

    Two rows share more shingles than either has outside of its `lacking` rarest ones, plus one, so they meet at one of
    these. Rows come by group and segment; those of one segment do not meet each other.
    """
    n = len(group)
    code = (group[row].astype(np.uint64) << np.uint64(32)) | hashes
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    once = np.concatenate(([True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])))
    code, row = code[once], row[once]
    opens = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    often = np.repeat(np.diff(np.append(opens, len(code))), np.diff(np.append(opens, len(code))))
    by_row = np.argsort(row * (n + 1) + often, kind="stable")
    sizes = np.bincount(row, minlength=n)
    rank = np.empty(len(row), np.int64)
    rank[by_row] = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rare = (rank <= (sizes - lacking)[row]) & (often > 1)
    code, row = code[rare], row[rare]
    if not len(code):
        return np.zeros(0, np.int64)
    fresh = np.concatenate(([True], code[1:] != code[:-1]))
    own = segment[row]
    opens = np.maximum.accumulate(np.where(fresh, np.arange(len(code)), 0))
    starts = np.maximum.accumulate(np.where(fresh | np.concatenate(([True], own[1:] != own[:-1])), np.arange(len(code)), 0))
    count = starts - opens
    asked = np.flatnonzero(count)
    found = [np.zeros(0, np.int64)]
    for few in np.split(asked, np.flatnonzero(np.diff(np.cumsum(count[asked]) // (STEP * 16))) + 1):
        found.append(np.unique(row[_ranges(opens[few], count[few])] * n + np.repeat(row[few], count[few])))
    return np.unique(np.concatenate(found))


def _joining(table: pa.Table, width: int, threshold: float) -> set[tuple[int, int]]:
    """Pairs of ids whose windows match and that join components of a group, so that all that match in the group are joined.

    Windows contain the stretches of a key at a place, so they share at least what two matching stretches do.
    So many shingles can not all be among the most frequent ones of the group, so rows meet at the others.
    Rows of a component with one window (`face`) are one row, with the smallest and the largest of their ids. Every such pair of two components is compared until one joins them: one pair at first, then twice as many in each round.
    """
    share = threshold / (1 + threshold)
    cols = [table.column(c).to_numpy() for c in ("key", "i", "j")]
    group = np.cumsum(np.concatenate(([False], np.any([c[1:] != c[:-1] for c in cols], axis=0))))
    told = [table.column("face").to_numpy(), table.column("component").to_numpy(), table.column("side").to_numpy(), group]
    order = np.lexsort((table.column("id").to_numpy(), *told))
    once = np.flatnonzero(np.concatenate(([True], np.any([c[order[1:]] != c[order[:-1]] for c in told], axis=0))))
    ids = table.column("id").to_numpy()[order]
    ids, last = ids[once], ids[np.append(once[1:], len(order)) - 1]
    table, group, n = table.take(pa.array(order[once])), group[order[once]], len(once)
    side, part, least = (table.column(c).to_numpy() for c in ("side", "component", "least"))
    segment = np.cumsum(np.concatenate(([False], (group[1:] != group[:-1]) | (side[1:] != side[:-1]) | ((side[1:] == 2) & (part[1:] != part[:-1])))))
    hashes, at = _window_shingles(table.column("window"))
    sizes = np.diff(at)
    row = np.repeat(np.arange(n), sizes)
    windows = np.full((n, sizes.max()), -1, np.int64)
    windows[np.arange(sizes.max()) < sizes[:, None]] = hashes
    need = lambda x, y: np.ceil(share * (x + y) - 1e-9)
    opens = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    pairs = _meeting(hashes, row, group, segment, need(least, np.minimum.reduceat(least, opens)[group]))
    x, y = pairs // n, pairs % n
    open_ = (part[x] != part[y]) & ((ids[x] != ids[y]) | (last[x] != last[y]) | (ids[x] != last[x]))
    x, y = x[open_], y[open_]
    enough = [np.zeros(0, bool)]
    for k in range(0, len(x), 8192):
        u, v = x[k : k + 8192], y[k : k + 8192]
        enough.append(_common(windows[u], np.where(windows[v] < 0, -2, windows[v])) >= need(least[u], least[v]))
    x, y = (c[np.concatenate(enough)] for c in (x, y))
    own = hashes | (row.astype(np.uint64) << np.uint64(32))
    gap = np.arange(len(own)) - _neighbours(own, 0)[0]
    gap[(gap >= width) | (gap > np.arange(len(own)))] = 0
    size = np.append(_repeats(own, width)[0], np.zeros(width - 1, np.int64))
    component = np.unique(np.stack((group, part)), axis=1, return_inverse=True)[1].ravel()
    links, tries = set(), 1
    while len(x):
        open_ = component[x] != component[y]
        x, y = x[open_], y[open_]
        pair = np.minimum(component[x], component[y]) * n + np.maximum(component[x], component[y])
        order = np.argsort(pair, kind="stable")
        x, y, pair = x[order], y[order], pair[order]
        now = np.arange(len(x)) - np.searchsorted(pair, pair) < tries
        for q in range(0, np.count_nonzero(now), 2048):
            a, b = x[now][q : q + 2048], y[now][q : q + 2048]
            for _ in range(2):  # from either side
                if len(a):
                    near = _reaches(a, b, hashes, at, gap, size, least, width, threshold)
                    b, a = a[near], b[near]
            for u, v in zip(a.tolist(), b.tolist()):
                if component[u] != component[v] and matching_stretches(hashes[at[u] : at[u + 1]], hashes[at[v] : at[v + 1]], width, threshold):
                    component[component == component[v]] = component[u]
                    p, q = (ids[u], ids[v]) if ids[u] != ids[v] else (last[u], ids[v]) if last[u] != ids[v] else (ids[u], last[v])
                    links.add((int(max(p, q)), int(min(p, q))))
        x, y, tries = x[~now], y[~now], 2 * tries
    return links


def _rarest(hashes: np.ndarray, at: np.ndarray, often: np.ndarray, width: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and shingles: for each window the shingles that are among the first of one of its stretches.

    Rare ones come before those that `often` marks, by hash. A match holds `threshold` of the distinct shingles of
    either stretch, so at most the others of each come before their first common one, and two windows with a match
    have one of these shingles in common, whatever is marked.
    """
    first = width - int(np.ceil(threshold * width - 1e-9)) + 1
    rank = hashes.astype(np.uint64) | (often.astype(np.uint64) << np.uint64(32))
    n = np.maximum(np.diff(at) - width + 1, 0)
    rows, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for few in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // 8192)) + 1):
        stretch = np.sort(rank[_ranges(at[:-1][few], n[few])[:, None] + np.arange(width)], axis=1)
        early = np.ones(stretch.shape, bool)
        early[:, 1:] = np.cumsum(stretch[:, 1:] != stretch[:, :-1], axis=1) < first
        base = int(few[0]) if len(few) else 0
        found = np.unique((np.repeat(np.repeat(few - base, n[few]), width).reshape(early.shape)[early].astype(np.uint64) << np.uint64(33)) | stretch[early])
        rows.append((found >> np.uint64(33)).astype(np.int64) + base)
        values.append(found.astype(np.uint32))
    return np.concatenate(rows), np.concatenate(values)


def _open_keys(rows: DataFrame) -> DataFrame:
    """(key, n, main, asking) of the keys whose rows are of several components: rows, the largest component, rows outside of it."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    return parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top")).where("parts > 1").select(
        "key", "n", F.col("top.component").alias("main"), (F.col("n") - F.col("top.n")).alias("asking"))


def _rarer_groups(windows: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """The windows of keys with more than `LARGE` blocks of them, in groups at a key and a shingle, instead of all of a key.

    Two windows with a match have one of their rarest shingles in common (`_rarest`), so they meet at it. A draw tells
    which shingles are frequent at a key, which steers only their order. Ids of windows travel first, and windows only to
    groups of several components.
    """
    large = windows.where(F.col("n") > LARGE * block)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes, at = _window_shingles(pa.chunked_array([batch.column("window")]))
                found = np.unique((np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(at)) << np.uint64(32)) | hashes)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array((found >> np.uint64(32)).astype(np.int64))), pa.array(found.astype(np.uint32).view(np.int32))], ["key", "shingle"])

    drawn = large.where(F.pmod(F.xxhash64(F.lit(3), "place"), F.lit(DRAWN)) == 0).select("key", "window").mapInArrow(shingles, "key bigint, shingle int")
    counted = drawn.groupBy("key", "shingle").agg(F.count("*").alias("m")).where(F.col("m") * DRAWN * 2 > block)
    often = counted.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("m", "shingle")), False), 1, OFTEN).getField("shingle").alias("often"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hashes, at = _window_shingles(pa.chunked_array([batch.column("window")]))
                told, keys = batch.column("often"), batch.column("key").to_numpy().view(np.uint64)
                code = lambda v, row: mix(keys[row] ^ mix(v.astype(np.uint64) + np.uint64(1)))
                frequent = code(told.flatten().to_numpy().view(np.uint32), np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(told), 0).to_numpy()))
                row = np.repeat(np.arange(batch.num_rows), np.diff(at))
                row, value = _rarest(hashes, at, np.isin(code(hashes, row), np.unique(frequent)), width, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(code(value, row).view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in ("place", "component"))], ["key", "place", "component"])

    told = large.join(often, "key", "left").select("key", "place", "component", "window", "often").repartition("place")  # evenly, whatever the keys
    met = settled(told.mapInArrow(rare, "key bigint, place bigint, component bigint"), "rarest")
    open_ = met.join(_open_keys(met), "key").select("key", "place", "n", "main", "asking")
    return large.drop("key", "n", "main", "asking").join(open_, "place")


def _across(members: DataFrame, passages: DataFrame, records: DataFrame, paragraph: int, shingle: int, threshold: float,
            block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of records that match at a key whose places are in more than one component so far.

    `passages` are (id, start, end, component). A place belongs to the passage over its middle, or stands
    alone. Smallest ids have met all records of their keys and stay out. The shingle hashes of all stretches
    of a place, at most two stretches wide, are its window. Up to a block of places of a key meet in one
    group; of more, the places outside the largest component are dealt into blocks, and each meets each
    block of all places. Those of more than `LARGE` blocks meet in groups at their rarer shingles before
    (`_rarer_groups`). Within a group every pair in different components is compared, and what leaves
    are pairs that join components of the group, so a key whose places are in one component sends nothing.
    """
    width = paragraph - shingle + 1
    middle = F.floor((F.col("low") + F.col("high")) / 2)
    named = passages.select(F.col("id").alias("_id"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.xxhash64("component").alias("_component"))
    rows = members.where("n > 2 and sample_id <> b").join(named, (F.col("sample_id") == F.col("_id")) & (middle >= F.col("_start")) & (middle < F.col("_end")), "left").select(
        "key", F.col("sample_id").alias("id"), "low", "high", F.coalesce("_component", F.xxhash64(F.lit("alone"), "sample_id", "low")).alias("component"))
    rows = settled(rows, "placed")
    texts = records.select(F.col("sample_id").alias("_id"), F.col("content").alias("_text")).where("_id is not null")
    placed = texts.join(rows.join(_open_keys(rows), "key"), F.col("_id") == F.col("id")).select(
        F.xxhash64("key", "id", "low").alias("place"), "key", "id", "component", "n", "main", "asking", F.substring("_text", F.col("low") + 1, F.col("high") - F.col("low")).alias("part"))
    kept = ["place", "key", "id", "component", "n", "main", "asking"]

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "part"):
            rolls, bounds, _, _ = _text_shingles(batch.column("part"), shingle)
            full = np.flatnonzero(np.diff(bounds) >= width)  # the other rows are those of another text with the id
            if not len(full):
                continue
            n = np.diff(bounds)[full]
            own, at = (rolls[_ranges(bounds[full], n)] >> np.uint64(32)).astype(np.uint32), np.append(0, np.cumsum(n))
            size = _repeats(own | np.repeat(np.arange(len(full), dtype=np.uint64) << np.uint64(32), n), width)[0]
            least = np.minimum.reduceat(np.append(size, width), np.stack((at[:-1], at[1:] - width + 1), axis=1).ravel())[::2]
            window = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(own)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(full)) for c in kept), window, pa.array(least.astype(np.int32))], [*kept, "window", "least"])

    kinds = dict(placed.dtypes)
    windows = settled(placed.mapInArrow(open_windows, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", window binary, least int"), "windows")
    windows = windows.where(F.col("n") <= LARGE * block).unionByName(_rarer_groups(windows, width, threshold, block)).drop("place")
    cells = lambda c: F.ceil(F.col(c) / block).cast("int")
    cell = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "id", "window"), cells(c).cast("bigint")).cast("int")
    held = ["id", "component", "window", "least", F.xxhash64("window").alias("face")]
    zero, many = F.lit(0), F.col("n") > block
    dealt = (windows.where(~many).select("key", zero.alias("i"), zero.alias("j"), F.lit(2).alias("side"), *held)
             .unionAll(windows.where(many).where("component <> main").select("key", cell(1, "asking").alias("i"), F.explode(F.sequence(zero, cells("n") - 1)).alias("j"), zero.alias("side"), *held))
             .unionAll(windows.where(many).select("key", F.explode(F.sequence(zero, cells("asking") - 1)).alias("i"), cell(2, "n").alias("j"), F.lit(1).alias("side"), *held)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 3):
            links = _joining(table, width, threshold)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sorted(links))], ["a", "b"])

    keys = ["key", "i", "j"]
    partitions = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = kinds["id"]
    return dealt.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(meet, f"a {kind}, b {kind}").distinct()


def _clusters(links: DataFrame) -> DataFrame:
    """(id, start, end, component) of the passages that links (a, a_start, a_end, b, b_start, b_end) show."""
    ends = links.select(F.col("a").alias("id"), F.col("a_start").alias("start"), F.col("a_end").alias("end")).unionAll(
        links.select("b", "b_start", "b_end")).distinct()
    order = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ends.withColumn("_new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("id", "_no")
    places = settled(opened.select(
        "id", "start", "end", F.struct("id", F.min("start").over(whole).alias("start")).alias("passage"), F.max("end").over(whole).alias("passage_end")), "passages")
    named = lambda side: places.select(F.col("id").alias(side), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.col("passage").alias(f"{side}_passage"))
    edges = links.join(named("a"), ["a", "a_start", "a_end"]).join(named("b"), ["b", "b_start", "b_end"]).select(
        F.col("a_passage").alias("a"), F.col("b_passage").alias("b")).distinct()
    labels = connected_components(edges)
    passages = places.groupBy("passage").agg(F.max("passage_end").alias("end"))
    return passages.join(labels, passages["passage"] == labels["node"]).select(
        F.col("passage.id").alias("id"), F.col("passage.start").alias("start"), "end", "component")


def repeated_passages(records: DataFrame, paragraph: int = PARAGRAPH, shingle: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """Passages of at least `paragraph` words that several records share, clustered.

    Reads `sample_id` (an integer type), `content`; returns one row per passage that has a partner:
    `sample_id`, `start`, `end` (code points, end exclusive), `component_id` (smallest id in its cluster),
    `component_start`, `kept` (the cluster's first passage stays, the others are removals).

    A paragraph is any stretch of `paragraph` words, since repeated passages often stand inside a longer
    line. Its MinHash bands are shaped for high recall. The records of a key meet its smallest id and
    the smallest id with the same context before or after the key. Where a key's places are in several
    components after that, they meet each other; only places in passages of one cluster do not. The part of
    a record that its common keys bound is compared with the partner; where a stretch matches, whole texts
    are: every stretch against the stretches of the partner on all diagonals of its common shingles, by
    exact Jaccard of their sets of shingles.
    Matching stretches join to passages, overlapping passages of a record to one, and components of the
    links between passages are the clusters.

    Null, empty and shorter texts share nothing, and repeats inside one text do not count. Rows repeated
    with one id are one record; null ids are left out. Ties go to the smaller id, then the earlier
    place. Further columns are ignored. An empty table gives an empty result.
    """
    members = settled(key_members(paragraph_keys(records, paragraph, shingle, threshold)), "members")
    pairs = settled(candidate_pairs(members), "pairs")
    met = settled(shared_stretches(pairs, records, paragraph, shingle, threshold), "met")
    more = _across(members, settled(_clusters(met), "clusters"), records, paragraph, shingle, threshold)
    linked = settled(met.select("a", "b").unionAll(more).distinct(), "linked")
    found = _clusters(settled(shared_stretches(linked, records, paragraph, shingle, threshold), "stretches"))
    return found.select(
        F.col("id").alias("sample_id"), "start", "end",
        F.col("component.id").alias("component_id"), F.col("component.start").alias("component_start"),
        ((F.col("id") == F.col("component.id")) & (F.col("start") == F.col("component.start"))).alias("kept"))
