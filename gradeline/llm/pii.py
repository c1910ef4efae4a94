"""Personal data in evidence texts: high-recall candidates, boosted trees, calibrated thresholds; only DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .records import settled

# The formats that a scan must report. The guards in front spare rescans of a long run
# and change no match; possessive repeats can not give back what follows their end anyway.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_PHONE = r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
LOOSE_EMAIL = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z]{2,24}"
LOOSE_IP = r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:[\[(]\.[\])]|[\[(]dot[\])])\x20?[0-9]{1,3}){3}(?![0-9])"
LOOSE_CARD = r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,3}[0-9]{4}){2,3}(?:[./_\x20-]{1,3}[0-9]{1,3})?(?![0-9])"
KINDS = ("email", "ip", "card", "phone")
KEYWORDS = r"(?i)(tel|phone|call|fax|mail|contact|card|visa|address|host)[^A-Za-z]*$"

# Bins of each feature; their product, once per fold, bounds the table that the fit reads.
FEATURES = {"kind": 4, "digits": 5, "breaks": 5, "left": 4, "right": 4, "keyword": 2, "spread": 3}
#: Parts of the texts; each is scored by trees fitted to the others.
FOLDS = 5
#: Share of the candidates above a kind's threshold that must be right.
PRECISION = 0.95


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    parts = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    return (F.size(parts) == 4) & F.forall(parts, lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.right(part, F.lit(3)).cast("int"), F.lit(0)) <= 255))


def _plausible(s: Column) -> Column:
    """The verdict on a candidate that no feature knows: check digit, octets, top-level domain, length of a number."""
    n = F.length(_digits(s["value"]))
    return (
        F.when(s["kind"] == "email", s["value"].rlike(r"(\.|[\])]\x20?)[A-Za-z]{2,24}$"))
        .when(s["kind"] == "ip", _octets(s["value"]))
        .when(s["kind"] == "card", n.between(13, 19) & _luhn(_digits(s["value"])))
        .otherwise(n.between(9, 15)))


def _valid(s: Column) -> Column:
    """What the base rules of the span's kind say about it."""
    n = F.length(_digits(s["value"]))
    return (
        F.when(s["kind"] == "email", True)
        .when(s["kind"] == "ip", _octets(s["value"]))
        .when(s["kind"] == "card", n.between(13, 19) & _luhn(_digits(s["value"])))
        .otherwise(n.between(9, 15)))


def _char(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Za-z]"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike(r"^[^\x20\x09-\x0D]"), 3).otherwise(0)


def _bin(c: Column, *edges: int) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + (c >= edge).cast("int")
    return out


def _described(s: Column) -> Column:
    """The candidate's place and its binned format and context features."""
    n = F.length(_digits(s["value"]))
    return F.struct(
        s["kind"].alias("name"), s["start"].alias("start"), s["end"].alias("end"),
        sum((F.when(s["kind"] == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0)).alias("kind"),
        _bin(n, 8, 11, 14, 18).alias("digits"),
        _bin(F.regexp_count(s["value"], F.lit(r"[\x20().-]")), 1, 2, 3, 4).alias("breaks"),
        _char(F.right(s["before"], F.lit(1))).alias("left"), _char(s["after"]).alias("right"),
        s["before"].rlike(KEYWORDS).cast("int").alias("keyword"),
        _bin(F.size(F.array_distinct(F.split(_digits(s["value"]), ""))), 4, 7).alias("spread"))


def _bounded_pool(text: Column) -> Column:
    """Candidates of the base formats, before their rules."""
    digit = lambda x: F.when(text.rlike("[0-9]"), x).otherwise(F.array().cast(spans.NONE))
    card = F.filter(spans.found(text, "card", CARD), lambda s: F.length(_digits(s["value"])) >= 12)
    return F.concat(
        spans.gated(text, "@", spans.found(text, "email", EMAIL)), digit(spans.found(text, "ip", IP)), digit(card),
        spans.gated(text, "+", spans.found(text, "phone", PHONE)))


def _loose_pool(text: Column) -> Column:
    mail = F.when(text.rlike(r"[\[(]at[\])]"), spans.found(text, "email", LOOSE_EMAIL)).otherwise(F.array().cast(spans.NONE))
    phone = F.when(text.rlike(r"[0-9][\x20.-][0-9]{3}"), spans.found(text, "phone", LOOSE_PHONE)).otherwise(F.array().cast(spans.NONE))
    address = F.when(text.rlike(r"[0-9]\x20?[\[(](\.|dot)[\])]"), spans.found(text, "ip", LOOSE_IP)).otherwise(F.array().cast(spans.NONE))
    card = F.when(text.rlike(r"[0-9]{4}[./_\x20-]{1,3}[0-9]{4}"), spans.found(text, "card", LOOSE_CARD)).otherwise(F.array().cast(spans.NONE))
    return F.concat(mail, address, card, phone)


@dataclass(frozen=True)
class Tree:
    """Depth two: a split (feature, greatest bin on the left) and one below each side, with four leaf values."""

    root: tuple[str, int]
    below: tuple[tuple[str, int], tuple[str, int]]
    leaves: tuple[float, float, float, float]


def fit_trees(table: list[dict], rounds: int = 12, rate: float = 0.5, penalty: float = 1.0) -> list[Tree]:
    """Boosted trees for the log-odds of `positive` out of `total`, from counts per combination of bins.

    Splits maximise the second-order gain; equal gains go to the first feature and the lowest bin. The
    table has one row per combination that occurs, at most the product of the bins.
    """
    names = list(FEATURES)
    if not table:
        return []
    x = np.array([[r[n] for n in names] for r in table])
    total = np.array([r["total"] for r in table], float)
    positive = np.array([r["positive"] for r in table], float)
    score, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = positive - total * p, total * p * (1 - p)

        def split(rows: np.ndarray) -> tuple[str, int]:
            best, place = -1.0, (names[0], FEATURES[names[0]])
            for f, name in enumerate(names):
                for cut in range(FEATURES[name] - 1):
                    left = rows & (x[:, f] <= cut)
                    right = rows & ~left
                    gain = sum(grad[s].sum() ** 2 / (hess[s].sum() + penalty) for s in (left, right))
                    if gain > best + 1e-12:
                        best, place = gain, (name, cut)
            return place

        def side(rows: np.ndarray, at: tuple[str, int]) -> tuple[np.ndarray, np.ndarray]:
            left = rows & (x[:, names.index(at[0])] <= at[1])
            return left, rows & ~left

        root = split(np.ones(len(x), bool))
        halves = side(np.ones(len(x), bool), root)
        below = tuple(split(h) for h in halves)
        quarters = [q for h, b in zip(halves, below) for q in side(h, b)]
        leaves = tuple(float(rate * grad[q].sum() / (hess[q].sum() + penalty)) for q in quarters)
        for q, value in zip(quarters, leaves):
            score[q] += value
        trees.append(Tree(root, below, leaves))
    return trees


def tree_scores(trees: list[Tree], get) -> Column | float:
    """Sum of the trees over features given by `get(name)`: columns, or plain numbers in tests."""
    total = F.lit(0.0)
    for t in trees:
        ask = lambda at: get(at[0]) <= at[1]
        total = total + F.when(ask(t.root), F.when(ask(t.below[0]), t.leaves[0]).otherwise(t.leaves[1])).otherwise(
            F.when(ask(t.below[1]), t.leaves[2]).otherwise(t.leaves[3]))
    return total


def _limit(rows: list[dict], precision: float) -> float:
    """The lowest score from which on the rows are right often enough; infinite where none is, 0 without rows.

    Where even the lowest row is in, nothing speaks against lower scores down to even odds.
    """
    if not rows:
        return 0.0
    rows = sorted(rows, key=lambda r: -r["score"])
    best, good, seen, k = float("inf"), 0, 0, 0
    while k < len(rows):
        at = rows[k]["score"]
        while k < len(rows) and rows[k]["score"] == at:
            good, seen, k = good + rows[k]["positive"], seen + rows[k]["total"], k + 1
        if good >= precision * seen:
            best = at
    return min(best, 0.0) if best == rows[-1]["score"] else best


def thresholds(scored: list[dict], precision: float = PRECISION) -> dict[str, float]:
    """Per kind, the lowest score from which on its candidates are right often enough, infinite where none is.

    A kind without candidates takes the threshold of all kinds together; without any candidate nothing
    speaks against a score of 0.
    """
    of_kind = {k: [r for r in scored if r["kind"] == i] for i, k in enumerate(KINDS)}
    return {k: _limit(rows or scored, precision) for k, rows in of_kind.items()}


def calibrated(table: list[dict], precision: float = PRECISION) -> tuple[list[Tree], dict[str, float]]:
    """Trees fitted to all counts, and thresholds from scores of trees that did not see the counted fold.

    Every candidate takes part in both, so no kind goes uncalibrated because a held-out part misses it.
    """
    scored = []
    for fold in range(FOLDS):
        here = [r for r in table if r["fold"] == fold]
        if here:
            trees = fit_trees([r for r in table if r["fold"] != fold])
            scored += [r | {"score": _score(trees, r)} for r in here]
    return fit_trees(table), thresholds(scored, precision)


def find_personal_data(records: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Spans of personal data: all that the base formats demand, and further candidates that the trees accept.

    Reads `sample_id`, `content`; returns one row per input row: `sample_id`, `base` and `added` (array
    of kind, start, end; code points, end exclusive).

    Generators propose overlapping candidates: the base formats before their rules, and loose formats of
    all four kinds (written-out mail addresses, defanged addresses, cards with other breaks, national
    numbers). Candidates of the base formats are labelled by what no feature holds: check digit, octets,
    top-level domain, exact length. Trees are boosted on binned format and context features from counts
    of all candidates per fold and combination of bins, a table bounded by `FOLDS` and the product of the
    bins (`FEATURES`), so the fit reads the whole corpus and moves little. A text's fold is a hash of the
    text, so copies stand in one. Each kind's threshold is set for the wanted precision on all its
    candidates, each scored by trees of the other folds; see `thresholds` for kinds without candidates.
    A loose candidate that reaches it, passes the label's check and overlaps no base span is added; added
    spans of different kinds may overlap each other.

    Null counts as empty, without spans. Rows are independent but for the fit, so repeated rows and ids
    have a row each. Equal scores count together. Further columns are ignored. An empty table gives an
    empty result.
    """
    text = F.col("_text")
    rows = settled(
        records.select(F.col("sample_id").alias("_id"), F.coalesce("content", F.lit("")).alias("_text"))
        .select("_id", F.pmod(F.xxhash64("_text"), F.lit(FOLDS)).cast("int").alias("fold"), _bounded_pool(text).alias("pool"), _loose_pool(text).alias("loose")).select(
            "_id", "fold",
            F.transform("pool", lambda s: F.struct(_valid(s).alias("valid"), _plausible(s).alias("label"), _described(s).alias("c"))).alias("pool"),
            F.transform(F.filter("loose", _plausible), _described).alias("loose")), "candidates")
    each = rows.select("fold", F.explode("pool").alias("p")).select("fold", "p.label", *[f"p.c.{n}" for n in FEATURES])
    counts = each.groupBy("fold", *FEATURES).agg(F.count("*").alias("total"), F.sum(F.col("label").cast("bigint")).alias("positive"))
    trees, limits = calibrated([r.asDict() for r in counts.orderBy("fold", *FEATURES).collect()], precision)

    base = F.transform(F.filter("pool", lambda p: p["valid"]), lambda p: F.struct(
        p["c"]["name"].alias("kind"), p["c"]["start"].alias("start"), p["c"]["end"].alias("end")))

    def accepted(c: Column) -> Column:
        reached = tree_scores(trees, lambda n: c[n])
        above = F.lit(False)
        for kind, limit in limits.items():
            if limit < float("inf"):
                above = above | ((c["name"] == kind) & (reached >= limit - 1e-9))
        clear = ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return above & clear

    return rows.select("_id", base.alias("base"), "loose").select(
        F.col("_id").alias("sample_id"), "base",
        F.transform(F.filter("loose", accepted), lambda c: F.struct(c["name"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("added"))


def _score(trees: list[Tree], row: dict) -> float:
    total = 0.0
    for t in trees:
        half = 0 if row[t.root[0]] <= t.root[1] else 1
        name, cut = t.below[half]
        total += t.leaves[2 * half + (0 if row[name] <= cut else 1)]
    return total
