"""Secrets in evidence texts, told apart by how many owners share them; only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .records import settled

# Formats that a scan must report, and well-known vendor formats that it adds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
VENDOR = r"(?:gh[pousr]_|glpat-|sk_live_)[A-Za-z0-9_-]{16,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "vendor")

#: Words that stand in for a value; a value that holds one is no credential.
STAND_IN = r"(?i)example|sample|dummy|placeholder|change_?me|replace|redacted|your[_-]|my[_-]|xxxx|\*\*\*|todo|test[_-]|fake|foobar|123456|abcdef|qwerty|password|secret"
#: One piece over and over.
REPEATED = r"^(.{1,32})\1+.{0,31}$"
#: Bits a character: least entropy of a value, and of a long value in letters or digits alone.
MIN_BITS, LONG_BITS, LONG = 2.2, 3.3, 20

#: A value seen under at least so many owners is a copied example.
MIN_OWNERS = 3


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds. A maximal run of 24 or more characters is what a run filtered by length leaves."""
    assigned = F.filter(spans.found(text, "assign", ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    return F.concat(assigned, spans.gated(text, "AKIA", spans.found(text, "access", ACCESS)), spans.found(text, "hex", HEX))


def added_spans(text: Column) -> Column:
    vendor = F.when(text.rlike("gh[pousr]_|glpat-|sk_live_"), spans.found(text, "vendor", VENDOR)).otherwise(F.array().cast(spans.NONE))
    return F.concat(
        spans.gated(text, "eyJ", spans.found(text, "jwt", JWT)),
        spans.gated(text, "-----BEGIN", spans.found(text, "pem", PEM)), vendor)


def entropy_bits(value: Column) -> Column:
    """Shannon entropy of a value's characters, in bits; an empty value has none."""
    n = F.length(value).cast("double")
    each = lambda c: n - F.length(F.replace(value, c, F.lit("")))
    total = F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda a, c: a + each(c) * F.log2(each(c)))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))


def looks_live(kind: Column, value: Column) -> Column:
    """Whether a value could be a working credential, by its format and its entropy.

    Stand-in words, one piece repeated, and values of low entropy are examples. Formats of a vendor, of an
    access key or of a key file are live otherwise; hex runs too. An assigned value needs letters and
    digits, or a length and an entropy that no word has.
    """
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    varied = lambda v: spans.bind(entropy_bits(v), lambda h: (h >= MIN_BITS) & ((kind != "assign") | mixed | ((F.length(v) >= LONG) & (h >= LONG_BITS))))
    return (kind == "pem") | (~value.rlike(STAND_IN) & ~value.rlike(REPEATED) & varied(value))


def _hashed(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.md5(s["value"]).alias("hash"),
        looks_live(s["kind"], s["value"]).alias("live")))


def scan_secrets(records: DataFrame, repository: str = "filepath", owner: str = "domain", min_owners: int = MIN_OWNERS) -> DataFrame:
    """Every secret-looking span, and whether its value is one owner's or a widely copied example.

    Reads `sample_id`, `content` and the two columns that name a record's repository and owner (as a
    rule the file's folder or path, and its domain). Returns one row per input row: `sample_id`,
    `base` and `added` (array of kind, start, end, hash, live; code points, end exclusive), `owner_specific`
    and `widely_copied` (the same structs with `repositories` and `owners`; each span is in one of them),
    and `live_credentials`, those of `owner_specific` whose format and entropy look live (`looks_live`).

    Values leave the text only as hashes. Their frequency over the corpus is counted in three partial
    aggregates (hash, owner and repository; hash and owner; hash), so a value that a third of all
    records hold is one row per task. Repositories with the same name under two owners are two. A span
    whose value fewer than `min_owners` owners share is owner specific; an unknown (null) owner or
    repository counts as one of its own name.

    Null and empty texts have no spans. Repeated rows and ids keep a row each. Ties do not arise.
    An empty table gives an empty result.
    """
    text = F.coalesce(F.col("content"), F.lit(""))
    cut = records.select(
        F.col("sample_id").alias("_id"), text.alias("_text"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repository"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"))
    rows = settled(cut.select(
        F.monotonically_increasing_id().alias("_row"), "_id", "_repository", "_owner",
        _hashed(base_spans(F.col("_text"))).alias("base"), _hashed(added_spans(F.col("_text"))).alias("added")), "secrets")
    each = rows.select("_row", "_repository", "_owner", F.explode(F.concat("base", "added")).alias("s")).select("*", F.col("s.hash").alias("hash"))
    frequency = (
        each.groupBy("hash", "_owner", "_repository").agg(F.count("*").alias("n"))
        .groupBy("hash", "_owner").agg(F.count("*").alias("r"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories")))
    judged = each.join(frequency, "hash").groupBy("_row").agg(F.collect_list(F.struct(
        F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), "hash", F.col("s.live").alias("live"), "repositories", "owners")).alias("_all"))
    shape = "array<struct<kind:string,start:bigint,end:bigint,hash:string,live:boolean,repositories:bigint,owners:bigint>>"
    every = F.coalesce(F.array_sort("_all"), F.array().cast(shape))
    return rows.join(judged, "_row", "left").select("*", every.alias("_every")).select(
        F.col("_id").alias("sample_id"), "base", "added",
        F.filter("_every", lambda s: s["owners"] < min_owners).alias("owner_specific"),
        F.filter("_every", lambda s: s["owners"] >= min_owners).alias("widely_copied"),
        F.filter("_every", lambda s: (s["owners"] < min_owners) & s["live"]).alias("live_credentials"))
