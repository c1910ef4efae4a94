"""Spans of regular-expression matches as arrays of structs, built from column functions alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,before:string,after:string>"
NONE = f"array<{SPAN}>"
_BLOCK = 512
CONTEXT = 24


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches in code points, end exclusive; `value` is the given group.

    The pieces between matches give the positions. Their running length is summed in blocks, so that
    no list is copied more than once per block, and a text may hold any number of matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

    def located(h: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        return F.when(F.size(h) == 0, F.array().cast(NONE)).otherwise(
            bind(pieces, lambda p: _positions(kind, p, h, h if values is None else values)))

    return bind(hits, located)


def _positions(kind: str, pieces: Column, hits: Column, values: Column) -> Column:
    n = F.size(hits)
    parts = F.arrays_zip(
        F.slice(pieces, 1, n).alias("piece"), hits.alias("hit"), values.alias("value"), F.slice(pieces, 2, n).alias("next"))

    def one(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["piece"])
        end = start + F.length(part["hit"])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), part["value"].alias("value"),
            F.right(part["piece"], F.lit(CONTEXT)).alias("before"), F.left(part["next"], F.lit(CONTEXT)).alias("after"))
        return F.struct(end.alias("at"), state["done"].alias("done"), F.concat(state["now"], F.array(span)).alias("now"))

    def block(p: Column):
        def step(state: Column, b: Column) -> Column:
            return F.aggregate(
                F.slice(p, b * _BLOCK + 1, F.lit(_BLOCK)),
                F.struct(state["at"].alias("at"), state["done"].alias("done"), F.array().cast(NONE).alias("now")),
                one,
                lambda s: F.struct(s["at"].alias("at"), F.concat(s["done"], F.array(s["now"])).alias("done")))
        return step

    return bind(parts, lambda p: F.aggregate(
        F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{NONE}>").alias("done")),
        block(p), lambda s: F.flatten(s["done"])))


def gated(text: Column, needle: str, spans: Column) -> Column:
    """Spans of texts that hold a fixed substring; a byte search is cheaper than the pattern."""
    return F.when(F.contains(text, F.lit(needle)), spans).otherwise(F.array().cast(NONE))


def ordered(spans: Column, kinds: Sequence[str], by_kind: bool) -> Column:
    """The spans as `kind:start:end`, comma-joined, by kind as listed and start, or by start and kind."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])

    def key(s: Column) -> Column:
        kind, start = rank[s["kind"]].cast("bigint"), s["start"]
        a, b = (kind, start) if by_kind else (start, kind)
        return F.struct(a.alias("a"), b.alias("b"), s["end"].alias("c"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("d"))

    return F.array_join(F.transform(F.array_sort(F.transform(spans, key)), lambda s: s["d"]), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def blanked(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span replaced by `mark`; overlapping spans become one."""
    ends = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark)))
            .otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        ends, begin, step,
        lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.lit(2147483647)))))
