"""From the documents table to packed training batches, in five stages.

Each stage reads what its predecessor wrote and returns a DataFrame; all but the last return the
columns of documents. A row is known by its id and the MD5 of its text, so rows that share an id, or
have none, are judged each by its own text. The copy stages take rows repeated with one id and text as
one; the first in the order of their columns stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm import exact_dedup, near_dedup, packing, quality, secrets, spans
from gradeline.llm.queries import evidence, tokenizer_path
from gradeline.llm.records import settled
from gradeline.session import scratch_path

MARK = "[secret]"
#: Components and packing have no counterpart in plain SQL; the stages are tested against brute force.
ORACLE_SQL = None


def _carried(docs: DataFrame) -> DataFrame:
    """Each row whole in `_doc`, so that no column's name can clash, with its key."""
    key = F.struct(
        F.col("doc_id").isNull().alias("unknown"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("bigint").alias("id"),
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("hash"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), key.alias("_key"))


def _once(docs: DataFrame) -> DataFrame:
    """The carried rows, those repeated with one id and text once; usually a narrow count finds none."""
    rows = _carried(docs)
    repeated = settled(rows.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"), "repeated")
    if repeated.isEmpty():
        return rows
    single = rows.join(repeated, "_key", "left_semi").groupBy("_key").agg(F.min("_doc").alias("_doc"))
    return rows.join(repeated, "_key", "left_anti").unionByName(single)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(F.col("sample_id").alias("_key")), "_key", "left_anti").select("_doc.*")


def _content() -> Column:
    return F.col("_doc.text").alias("content")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have too few words and go. Each row is judged by its own text alone, whatever
    its length, so repeated rows share their fate and ties do not arise. An empty table stays empty.
    """
    return quality.quality_filter(_carried(docs).select("_doc", _content())).select("_doc.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space.

    The longest stays, of equally long ones the smallest id, null ids last. Rows that share an id are
    judged each by its text. Null and empty texts are one group. Whole texts are compared, of any
    length. An empty table stays empty.
    """
    rows = _once(docs)
    judged = exact_dedup.exact_copies(rows.select(F.col("_key").alias("sample_id"), _content()))
    return _without(rows, judged.where("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id.

    Rows whose id is null or shared get numbers of their own above all ids, so each is compared and
    judged by its text. Texts without words are no copies of each other and stay. Whole texts are
    compared, of any length. An empty table stays empty. Ids within 2^62 of the greatest 64-bit integer
    leave no room for the numbers and stop the job, should an id be null or shared.
    """
    rows = _once(docs)
    keys = rows.select("_key")
    shared = keys.where("not _key.unknown").groupBy("_key.id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("id").alias("_shared"))
    unclear = keys.join(shared, F.col("_key.id") == F.col("_shared"), "left_semi").where("not _key.unknown").unionAll(keys.where("_key.unknown"))
    unclear = settled(unclear.select("_key", F.monotonically_increasing_id().alias("_number")), "numbered")
    number = F.col("_key.id")
    if not unclear.isEmpty():
        top = keys.agg(F.max("_key.id")).first()[0]
        rows = rows.join(unclear, "_key", "left")
        number = F.coalesce(F.col("_number") + F.lit(top + 1).cast("bigint"), number)
    rows = rows.select("_doc", number.alias("_key"))
    judged = near_dedup.near_copies(rows.select(F.col("_key").alias("sample_id"), _content()))
    return _without(rows, judged.where("not kept"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live-looking secrets of one owner are blanked out, examples stay: widely copied
    values, and those whose format or entropy no credential has.

    Null and empty texts hold none. Repeated rows are blanked alike; ties do not arise. Whole texts are
    scanned, of any length. `n_chars` follows a changed text. An empty table stays empty.
    """
    rows = _carried(docs)
    found = secrets.scan_secrets(rows.select(
        F.col("_key").alias("sample_id"), _content(), F.col("_doc.source").alias("domain"),
        F.concat_ws("/", "_doc.source", "_doc.lang").alias("filepath")))
    found = found.where(F.size("live_credentials") > 0).select(F.col("sample_id").alias("_key"), F.col("live_credentials").alias("_spans")).dropDuplicates(["_key"])
    changed = F.col("_spans").isNotNull()
    text = F.when(changed, spans.blanked(F.col("_doc.text"), F.col("_spans"), MARK)).otherwise(F.col("_doc.text"))
    done = rows.join(found, "_key", "left").select("_doc", text.alias("_text"), changed.alias("_changed"))
    chars = F.when(F.col("_changed"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    return done.select(*[
        F.col("_text").alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"_doc.`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, in tokens of the byte-level BPE, with their length bucket and batch.

    A text above the longest piece goes on in further pieces; one without tokens (null, empty) has a row
    without bucket and batch. Rows that share an id are packed each. Ties of the hash go by id and piece.
    An empty table gives an empty result.
    """
    return packing.pack_texts(evidence(docs), tokenizer_path()).withColumnRenamed("sample_id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; every stage's result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
