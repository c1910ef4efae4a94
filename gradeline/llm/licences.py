"""Licence notices and expressions in evidence texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Phrases that every scan must report, and notice phrases that it adds, each with its
# label and how far the phrase alone speaks for the licence.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICE_PHRASES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "all rights reserved": ("reserved", 0.4),
    "this work is licensed under": ("notice", 0.3),
    "licensed under the": ("notice", 0.3),
}
TAG = "spdx license identifier"
#: Licence families by the start of an identifier.
FAMILIES = (("apache", "apache"), ("mit", "mit"), ("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("cc-by", "cc-by"), ("bsd", "bsd"), ("mpl", "mpl"))
BASE_STRENGTH = 0.6
_TAG = regex.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", regex.IGNORECASE)
_TOKEN = regex.compile(r"[()]|[A-Za-z0-9.+-]+(?::[A-Za-z0-9.+-]+)?")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def expression_postfix(text: str) -> list[str]:
    """The licence expression in postfix order (shunting-yard); reading stops where the expression does.

    WITH binds before AND, AND before OR; operators of one rank apply from the left. An unmatched or
    misplaced parenthesis or operator ends the expression; open parentheses close at its end.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for token in _TOKEN.findall(text):
        word = token.lower()
        if token == "(":
            if not operand:
                break
            stack.append(token)
        elif token == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif word in _PRECEDENCE:
            if operand:
                break
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            if not operand:
                break
            out.append(word)
            operand = False
    if operand and stack and stack[-1] != "(":
        stack.pop()
    out.extend(x for x in reversed(stack) if x != "(")
    return out


def choices(postfix: list[str]) -> frozenset[frozenset[str]]:
    """Sets of licence terms that each satisfy the expression: OR unites them, AND combines them, WITH joins a term to its exception.

    Their number can double with every AND, so the scan does not list them; see `decided`.
    """
    stack: list[frozenset[frozenset[str]]] = []
    for item in postfix:
        if item not in _PRECEDENCE:
            stack.append(frozenset([frozenset([item])]))
            continue
        if len(stack) < 2:
            break
        b, a = stack.pop(), stack.pop()
        if item == "or":
            found = a | b
        elif item == "and":
            found = frozenset(x | y for x in a for y in b)
        else:
            right = " ".join(sorted(frozenset().union(*b)))
            found = frozenset(frozenset(f"{t} with {right}" for t in x) for x in a)
        stack.append(found)
    return stack[0] if stack else frozenset()


@dataclass(frozen=True)
class Decision:
    """What an expression asks for: `needed` terms stand in every alternative, `chosen` in some only."""

    needed: frozenset[str]
    chosen: frozenset[str]


def decided(postfix: list[str]) -> Decision:
    """The terms that every alternative of the expression needs, and those that a choice can avoid.

    Equal to intersection and union of `choices` without listing them: AND unites what its sides need,
    OR keeps what both need, WITH joins each term to its exception.
    """
    stack: list[tuple[frozenset[str], frozenset[str]]] = []  # needed, all
    for item in postfix:
        if item not in _PRECEDENCE:
            stack.append((frozenset([item]), frozenset([item])))
            continue
        if len(stack) < 2:
            break
        (need_b, all_b), (need_a, all_a) = stack.pop(), stack.pop()
        if item == "or":
            stack.append((need_a & need_b, all_a | all_b))
        elif item == "and":
            stack.append((need_a | need_b, all_a | all_b))
        else:
            right = " ".join(sorted(all_b))
            stack.append((frozenset(f"{t} with {right}" for t in need_a), frozenset(f"{t} with {right}" for t in all_a)))
    needed, every = stack[0] if stack else (frozenset(), frozenset())
    return Decision(needed, every - needed)


def family(term: str) -> str:
    return next((label for start, label in FAMILIES if term.startswith(start)), term.split(" ")[0])


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, TAG}:
        machine.add_word(f" {phrase} ", phrase)
    machine.make_automaton()
    return machine


def scan_text(text: str, machine: ahocorasick.Automaton) -> dict:
    """Places, labels, expressions and score of one text."""
    words = text.encode().translate(_TABLE).split()
    # one character a byte, single blanks around words: a phrase between blanks is whole words
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, base, labels, score, tagged = [], set(), set(), 0.0, False
    for end, phrase in machine.iter(line):
        if phrase in BASE_PHRASES:
            places.append((end - len(phrase) - 1, phrase))
            base.add(BASE_PHRASES[phrase])
            score = 1 - (1 - score) * (1 - BASE_STRENGTH)
        elif phrase == TAG:
            tagged = True
        else:
            label, strength = NOTICE_PHRASES[phrase]
            labels.add(label)
            score = 1 - (1 - score) * (1 - strength)
    expressions, needed, chosen = [], set(), set()
    for found in _TAG.finditer(text) if tagged else ():
        postfix = expression_postfix(found[1])
        if postfix:
            expressions.append(" ".join(postfix))
            decision = decided(postfix)
            needed |= decision.needed
            chosen |= decision.chosen
            labels.update(family(t) for t in decision.needed | decision.chosen)
            score = 1.0
    starts, at, seen = [], 0, 0
    for place, _ in sorted(places):
        seen += line.count(" ", at, place + 1)
        at = place + 1
        starts.append(seen - 1)
    return {
        "n_words": len(words), "n_base": len(places), "first_word": starts[0] if starts else None,
        "last_word": starts[-1] if starts else None, "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels)), "expressions": expressions,
        "needed_terms": sorted(needed), "chosen_terms": sorted(chosen - needed), "score": round(score, 6)}


_SCHEMA = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("expressions", pa.list_(pa.string())),
    ("needed_terms", pa.list_(pa.string())), ("chosen_terms", pa.list_(pa.string())), ("score", pa.float64())])


def scan_licences(records: DataFrame) -> DataFrame:
    """Licence phrases, identifier tags and expressions of every whole text.

    Reads `sample_id`, `content`; returns one row per input row: `sample_id`, `n_words`, `n_base`,
    `first_word`, `last_word`, `base_labels`, `labels`, `expressions` (postfix), `needed_terms`,
    `chosen_terms` (licence terms, an exception joined by "with"), `score`.

    An Aho-Corasick automaton finds all phrases in one pass over the words (letters A-Z lowered, runs
    of letters, digits and characters beyond ASCII). Where the identifier tag occurs, the rest of its
    line is parsed by a shunting-yard and evaluated: terms that every alternative of one of the text's
    expressions needs, and terms that stand in some alternatives only. The families of both are labels.
    Alternatives are not listed, so an expression may have any number of them. The score combines the strengths of the notices as independent evidence; an identifier is 1.

    Null counts as empty: no words, no places, empty labels, score 0. Overlapping places all count.
    Rows are independent, so repeated rows and ids have a row each and ties do not arise. Further
    columns are ignored. An empty table gives an empty result.
    """
    kind = records.select("sample_id").dtypes[0][1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = pa.RecordBatch.from_pylist([scan_text(t.as_py() or "", machine) for t in part.column("content")], _SCHEMA)
                yield pa.RecordBatch.from_arrays([part.column("sample_id"), *found.columns], ["sample_id", *_SCHEMA.names])

    return records.select("sample_id", "content").mapInArrow(work, (
        f"sample_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, expressions array<string>, needed_terms array<string>, chosen_terms array<string>, score double"))
