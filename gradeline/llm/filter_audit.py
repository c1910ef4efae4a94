"""How the filters of a cleaning step interact: what each removes, what others would have removed anyway."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import settled

#: A survival word has a bit for each subset of the filters.
MOST_FILTERS = 5
#: A group of equal texts with more than this share of all records is hot. There are fewer such groups than this.
HOT_GROUPS = 1000
#: The filters of evidence texts, in bit order.
TEXT_FILTERS = "ABCDE"


def text_failures(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Which of five text filters every evidence record fails, as the bits of `failures`.

    Reads `sample_id`, `content`, `domain` and the columns of `keep`; returns `sample_id`, `domain`, `keep` and
    `failures` (bit 0 is A). Words are maximal runs without ASCII white space. A: under 200 words. B: the
    distinct words are under half of the words. C: over 3 % of the code points are A-Z. D: holds one of #$%&*|.
    E: equal to the text of a smaller sample_id anywhere in the table.

    Texts stay where they are: one pass makes a narrow row with the text's SHA-256. Equal texts meet by it; a
    group above a thousandth of all records is hot, there are fewer than a thousand such groups, and those
    are broadcast, so no key gathers more than a thousandth of the rows.

    A null text is empty (A alone fails, and E behind a smaller empty one). A null domain stays null. A null
    sample_id is smaller than none and none is smaller than it: it never fails E. Repeated rows of one
    sample_id do not fail E by each other. A very long text is one row. Further columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    text = F.coalesce("content", F.lit(""))
    read = records.select(
        F.col("sample_id").alias("sample_id"), F.col("domain").alias("domain"), *keep, text.alias("_text"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"))
    tests = [
        F.size("_words") < 200,
        100 * F.size(F.array_distinct("_words")) < 50 * F.size("_words"),
        100 * F.regexp_count("_text", F.lit("[A-Z]")).cast("bigint") > 3 * F.length("_text").cast("bigint"),
        F.col("_text").rlike(r"[#$%&*|]"),
    ]
    narrow = settled(read.select("sample_id", "domain", *keep, failure_bits(tests).alias("_four"), F.unhex(F.sha2("_text", 256)).alias("_hash")), "failures")
    groups = settled(
        narrow.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("sample_id").alias("_first")).where("_n > 1"), "equal-texts")
    hot = F.col("_n") * HOT_GROUPS > narrow.count()
    named = lambda df, name: df.select(F.col("_hash").alias(f"{name}_hash"), F.col("_first").alias(name))
    split = narrow.join(F.broadcast(named(groups.where(hot), "_hot")), F.col("_hash") == F.col("_hot_hash"), "left")
    done = split.where(F.col("_hot_hash").isNotNull()).withColumn("_first", F.col("_hot"))
    rest = split.where(F.col("_hot_hash").isNull()).join(named(groups.where(~hot), "_cold"), F.col("_hash") == F.col("_cold_hash"), "left").withColumn("_first", F.col("_cold"))
    copy = F.coalesce(F.col("_first") < F.col("sample_id"), F.lit(False))
    failures = (F.col("_four") + F.when(copy, F.lit(1 << 4)).otherwise(F.lit(0))).alias("failures")
    columns = ["sample_id", "domain", *keep]
    return done.select(*columns, failures).unionAll(rest.select(*columns, failures))


def failure_bits(failed: Sequence[Column]) -> Column:
    """The failed conditions as bits, the first lowest; a condition that is null has not failed."""
    bits = F.lit(0)
    for i, condition in enumerate(failed):
        bits = bits + F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def survival_word(failures: Column, n_filters: int) -> Column:
    """The truth table of one record: bit S is set where the record survives the filters of subset S."""
    table = [sum(1 << s for s in range(1 << n_filters) if not s & f) for f in range(1 << n_filters)]
    return F.element_at(F.lit(table).cast("array<bigint>"), failures + 1)


def positional_popcounts(words: np.ndarray, bits: int = 32) -> np.ndarray:
    """How many of the words have each bit set.

    Carry-save adders take three words of one weight to a sum of that weight and a carry of the next, all bit
    positions at once, until each weight has a single word left; bit by bit, these spell the counts.
    """
    counts = np.zeros(bits, np.int64)
    lane, weight = np.asarray(words, np.uint32), 0
    while len(lane):
        carries = []
        while len(lane) > 1:
            if len(lane) % 3:
                lane = np.concatenate((lane, np.zeros(-len(lane) % 3, np.uint32)))
            a, b, c = lane.reshape(3, -1)
            half = a ^ b
            carries.append(a & b | half & c)
            lane = half ^ c
        counts += ((lane[0] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.int64) << weight
        lane = np.concatenate(carries) if carries else lane[:0]
        weight += 1
    return counts


def subset_survivors(failed: DataFrame, n_filters: int, labels: Sequence[str] = ()) -> DataFrame:
    """How many records of each domain survive each subset of the filters, in all and under each label.

    Reads `domain` (null counts as the empty string), `failures` (bit i: fails filter i; null: fails none) and the boolean columns
    `labels` (null: no). Returns one row per domain: `domain`, `survivors` and, for each label, `<label>_survivors`; all are
    arrays of bigint, element S + 1 for the subset whose filters are the bits of S.

    Every record becomes a word of survived subsets; each Arrow batch adds its words up per domain and
    combination of labels by carry-save counters, and Spark sums the batches' counts. A hot domain is
    counted in all tasks, and a task holds one batch. There is no order, so ties do not matter; repeated rows
    count each. Further columns are ignored. An empty table gives an empty result.
    """
    if not 1 <= n_filters <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters fit a survival word, not {n_filters}")
    subsets, n_codes = 1 << n_filters, 1 << len(labels)
    rows = failed.select(
        F.coalesce(F.col("domain").cast("string"), F.lit("")).alias("domain"), failure_bits([F.col(x) for x in labels]).alias("code"),
        survival_word(F.coalesce("failures", F.lit(0)), n_filters).alias("word"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("domain").dictionary_encode()
            key = names.indices.to_numpy().astype(np.int64) * n_codes + batch.column("code").to_numpy()
            order = np.argsort(key, kind="stable")
            words, key = batch.column("word").to_numpy()[order].astype(np.uint32), key[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            counts = [positional_popcounts(part, subsets) for part in np.split(words, starts[1:])]
            found = key[starts]
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(found // n_codes)), pa.array(found % n_codes, pa.int32()),
                 pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))], ["domain", "code", "counts"])

    counted = rows.mapInArrow(count, "domain string, code int, counts array<bigint>")
    long = counted.select("domain", "code", F.posexplode("counts").alias("subset", "n"))
    having = lambda i: F.col("code").bitwiseAND(F.lit(1 << i)) != 0
    sums = long.groupBy("domain", "subset").agg(
        F.sum("n").alias("survivors"),
        *[F.coalesce(F.sum(F.when(having(i), F.col("n"))), F.lit(0)).alias(f"{x}_survivors") for i, x in enumerate(labels)])
    names = ["survivors", *[f"{x}_survivors" for x in labels]]
    lists = sums.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("subset", *names))).alias("_all"))  # one entry a subset
    return lists.select("domain", *[F.col("_all")[n].alias(n) for n in names])


def interactions(survivors: DataFrame, filters: str, labels: Sequence[str] = ()) -> DataFrame:
    """Every order of the filters, step by step, from the subset survivors alone.

    `survivors` is what `subset_survivors` returns, `filters` names each filter by one letter in bit order.
    Returns per `domain`, `filter_order` and `step` (from 1): `kept` after the step, `removed` by it, `redundant` (fail its
    filter but are gone already), `unique_fails` (fail its filter alone), `<label>_lost` for each label, and `shapley`, the filter's
    removals summed over all orders. No record is read again; a domain has one row for each order and step.
    """
    n = len(filters)
    every = (1 << n) - 1
    order, step, before, bit = [], [], [], []
    for chosen in itertools.permutations(range(n)):
        gone = 0
        for k, i in enumerate(chosen):
            order.append("".join(filters[j] for j in chosen))
            step.append(k + 1)
            before.append(gone)
            bit.append(1 << i)
            gone |= 1 << i
    plan = F.arrays_zip(F.lit(order).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(bit).alias("bit"))
    after = F.col("before").bitwiseOR(F.col("bit"))
    at = lambda name, subset: F.element_at(name, subset + 1)
    removed = at("survivors", F.col("before")) - at("survivors", after)

    def shapley(i: int) -> Column:
        total = F.lit(0).cast("bigint")
        for s in (s for s in range(1 << n) if not s >> i & 1):
            size = s.bit_count()
            orders = math.factorial(size) * math.factorial(n - 1 - size)
            total = total + F.lit(orders) * (at("survivors", F.lit(s)) - at("survivors", F.lit(s | 1 << i)))
        return total

    sums = survivors.withColumn("_shapley", F.array(*[shapley(i) for i in range(n)]))
    rows = sums.select("*", F.explode(plan).alias("_p")).select("*", "_p.*")
    return rows.select(
        "domain", "filter_order", F.col("step").cast("int").alias("step"), at("survivors", after).alias("kept"), removed.alias("removed"),
        (at("survivors", F.lit(0)) - at("survivors", F.col("bit")) - removed).alias("redundant"),
        (at("survivors", F.lit(every) - F.col("bit")) - at("survivors", F.lit(every))).alias("unique_fails"),
        *[(at(f"{x}_survivors", F.col("before")) - at(f"{x}_survivors", after)).alias(f"{x}_lost") for x in labels],
        F.element_at("_shapley", F.log2(F.col("bit")).cast("int") + 1).alias("shapley"))


def labelled(failed: DataFrame, labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the boolean columns `names` of `labels` by `sample_id`; without a label all are false.

    Of several label rows of one sample_id, one that says so is enough. A null sample_id has no label.
    """
    one = labels.where(F.col("sample_id").isNotNull()).groupBy(F.col("sample_id").alias("_label_id")).agg(
        *[F.coalesce(F.bool_or(n), F.lit(False)).alias(f"_label_{n}") for n in names])
    joined = failed.join(one, F.col("sample_id") == F.col("_label_id"), "left")
    return joined.select(*failed.columns, *[F.coalesce(F.col(f"_label_{n}"), F.lit(False)).alias(n) for n in names])


def audit_records(records: DataFrame, filters: Mapping[str, Column], domain: Column, labels: Mapping[str, Column] | None = None) -> DataFrame:
    """`interactions` of any filters over any of the project's records, such as the bounds of a parameter bank.

    `filters` maps one letter to the condition under which a record fails, null counting as passed; `labels` maps a name to
    a condition. Up to five filters; the records are read once.
    """
    labels = labels or {}
    failed = records.select(
        domain.alias("domain"), failure_bits(list(filters.values())).alias("failures"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in labels.items()])
    return interactions(subset_survivors(failed, len(filters), list(labels)), "".join(filters), list(labels))
