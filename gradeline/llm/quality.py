"""Quality rules as a short-circuit cascade, with only DataFrame functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import SPACE, WORD, settled
from .spans import bind

SYMBOLS = r"[#*$%&|<>]"
#: Rows that the sample behind the order holds on average; it steers only the order.
SAMPLE_ROWS = 1000
SAMPLE_PARTS = 8
SAMPLE_SEED = 5


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def word_chars(text: Column) -> Column:
    return (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return bind(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("bigint")


def _covered(windows: Column) -> Column:
    """Words under three-word windows that start at the given sorted positions."""
    return F.aggregate(
        F.transform(windows, lambda x, j: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(windows, j + 1) - x, F.lit(3).cast("bigint")))),
        F.lit(0).cast("bigint"), lambda a, b: a + b)


def n_repeat_words(text: Column) -> Column:
    """Words in three-word windows that the text holds at least twice.

    Each window is one long: as many bits of its hash as its position leaves free. Sorted, equal
    windows are neighbours. Neighbours with one hash but other words are found; such a text is
    done over with the words themselves.
    """
    def of_words(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n)).cast("int")
        packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: _pack(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits, i))
        words = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

        def of_sorted(s: Column) -> Column:
            key = lambda x: _right(x, bits)
            at = lambda x: (x - _left(_right(x, bits), bits)).cast("int")
            near = lambda x, j: F.coalesce(key(F.get(s, j)) == key(x), F.lit(False))
            twice = F.array_sort(F.transform(F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: at(x).cast("bigint")))
            clash = F.exists(
                F.filter(F.transform(s, lambda x, j: F.when(near(x, j + 1), F.struct(at(x).alias("a"), at(F.get(s, j + 1)).alias("b")))), lambda p: p.isNotNull()),
                lambda p: words(p["a"]) != words(p["b"]))
            return F.when(clash, exact()).otherwise(bind(twice, _covered))

        def exact() -> Column:
            pairs = F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(words(i).alias("w"), i.cast("bigint").alias("i"))))
            same = lambda p, x, j: F.coalesce(F.get(p, j)["w"] == x["w"], F.lit(False))
            return bind(pairs, lambda p: bind(
                F.array_sort(F.transform(F.filter(p, lambda x, j: same(p, x, j - 1) | same(p, x, j + 1)), lambda x: x["i"])), _covered))

        return F.when(n < 3, F.lit(0).cast("bigint")).otherwise(bind(F.sort_array(packed), of_sorted))

    return bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


def _left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _pack(h: Column, bits: Column, i: Column) -> Column:
    return _left(h, bits).bitwiseOR(i.cast("bigint"))


@dataclass(frozen=True)
class Rule:
    """`rejects` is evaluated on the text only when no rule before it has rejected it."""

    name: str
    rejects: Callable[[Column], Column]


# Thresholds of the rules.
RULES = (
    Rule("few_words", lambda t: n_words(t) < 50),
    Rule("repeated_words", lambda t: bind(n_words(t), lambda n: (n > 0) & (100 * n_repeat_words(t) > 50 * n))),
    Rule("symbols", lambda t: 10 * n_symbols(t) > n_words(t)),
    Rule("word_length", lambda t: bind(n_words(t), lambda n: (n > 0) & ~word_chars(t).between(3 * n, 10 * n))),
    Rule("repeated_lines", lambda t: 2 * n_dup_lines(t) > n_lines(t)),
    Rule("capitals", lambda t: F.regexp_count(t, F.lit(r"\p{Lu}")) > F.regexp_count(t, F.lit(r"\p{Ll}"))),
)
BASE_RULES = ("few_words", "repeated_words")


def order_sample(records: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `sample_rows` whole texts, drawn row by row from all of the table and written once.

    Rows are drawn where they lie, so only the sample itself travels, whatever the number of partitions.
    """
    share = min(1.0, sample_rows / max(records.count(), 1))
    text = F.coalesce(F.col("content"), F.lit(""))
    return settled(records.sample(share, SAMPLE_SEED).select(text.alias("content")).repartition(SAMPLE_PARTS), "order-sample")


def measured(sample: DataFrame, rule: Rule) -> tuple[float, float]:
    """Share of the sample that the rule rejects, and the seconds that it takes; a first run compiles it."""
    job = sample.agg(F.avg(F.coalesce(rule.rejects(F.col("content")), F.lit(False)).cast("double")).alias("share"))
    job.first()
    begin = time.perf_counter()
    share = job.first()["share"]
    return share or 0.0, time.perf_counter() - begin


def best_first(rules: Sequence[Rule], figures: Sequence[tuple[float, float]]) -> list[Rule]:
    """The rules by rejections per cost, from (share rejected, cost) of each; ties keep the given order."""
    gain = [share / max(cost, 1e-9) for share, cost in figures]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain[i])]


def cascade_order(records: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost, both measured on a sample of about `sample_rows` rows, best first.

    The order steers only how early a row stops; no verdict depends on it. An empty sample keeps the
    given order.
    """
    sample = order_sample(records, sample_rows)
    return best_first(rules, [measured(sample, r) for r in rules])


def verdict(text: Column, order: Sequence[Rule]) -> Column:
    """True when no rule rejects the text; evaluation stops at the first that does."""
    out = F.lit(True)
    for rule in reversed(order):
        out = F.when(F.coalesce(rule.rejects(text), F.lit(False)), F.lit(False)).otherwise(out)
    return out


def quality_filter(records: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The records that no rule rejects, with all their columns; null content is empty and rejected as too short."""
    text = F.coalesce(F.col("content"), F.lit(""))
    return records.where(verdict(text, cascade_order(records, rules, sample_rows)))


def quality_report(records: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Text statistics and verdict of every record.

    Reads `sample_id`, `content`; returns one row per input row: `sample_id`, `n_words`, `word_chars`,
    `n_symbols`, `n_dup_lines`, `n_repeat_words`, `base_failed`, `kept`. The report returns what the two
    base rules count, so they cost nothing more and lead the cascade; the others follow by rejections
    per cost, each evaluated only on texts that no rule before it has rejected.

    Null counts as empty: no words, base failed. Repeated rows and ids have a row each; no result
    depends on other rows, so ties do not arise. An empty table gives an empty result.
    """
    order = cascade_order(records, [r for r in rules if r.name not in BASE_RULES], sample_rows)
    text = F.col("_text")
    stats = records.select(F.col("sample_id").alias("_id"), F.coalesce("content", F.lit("")).alias("_text")).select(
        F.col("_id").alias("sample_id"), n_words(text).alias("n_words"), word_chars(text).alias("word_chars"),
        n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"),
        n_repeat_words(text).alias("n_repeat_words"), "_text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "sample_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.when(failed, False).otherwise(verdict(text, order)).alias("kept"))
