"""Packing of evidence texts into padded batches with optimal length buckets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import count_tokens, encode_ids
from .records import WORD, settled

#: Longest sequence; a longer text goes on in a further piece. It bounds the histogram.
MAX_TOKENS = 4096
#: Tokens of a batch, padding included.
BUDGET = 65536
BUCKETS = 16
#: Pieces that one cell of a bucket numbers among themselves, on average.
CELL_ROWS = 8192


def bucket_bounds(lengths: Sequence[int], counts: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """At most `buckets` upper bounds that minimise the total padding, by dynamic programming.

    `lengths` ascend. Padding of a bucket is its bound times its pieces less their tokens. Equal costs
    take the lowest cut, and no more bounds than help.
    """
    m = len(lengths)
    if not m:
        return []
    size = np.asarray(lengths, np.int64)
    pieces = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    tokens = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64) * size)))
    best = size[np.arange(m)] * pieces[1:] - tokens[1:]  # one bucket up to each length
    cuts = []
    for _ in range(1, min(buckets, m)):
        nxt, cut = best.copy(), np.full(m, -1)
        for j in range(1, m):
            cost = best[:j] + size[j] * (pieces[j + 1] - pieces[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < nxt[j]:
                nxt[j], cut[j] = cost[i], i
        cuts.append(cut)
        best = nxt
    out, j = [int(size[-1])], m - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            j = int(cut[j])
            out.append(int(size[j]))
    return out[::-1]


def word_tokens(content: Column) -> Column:
    return F.regexp_count(F.coalesce(content, F.lit("")), F.lit(WORD)).cast("bigint")


def pack(records: DataFrame, n_tokens: Column | None = None, max_tokens: int = MAX_TOKENS, budget: int = BUDGET, buckets: int = BUCKETS,
         ids: str | None = None) -> DataFrame:
    """Pieces of every text with their length bucket and batch.

    Reads `sample_id` and, for the default token count (words), `content`; `n_tokens` may be any column
    expression over the records, and `ids` the column that holds their tokens. Returns a row per piece: `sample_id`, `piece` (from 0), `start_token`,
    `n_tokens`, `bucket_tokens` (padded length), `batch` (from 0 within the bucket);
    with `ids` also `tokens`, the piece's own.

    The histogram of piece lengths over all records, at most `max_tokens` rows, goes to the driver, where
    dynamic programming picks the bounds. Inside a bucket, batches take `budget / bucket_tokens` pieces
    in the order of a hash. Pieces are numbered inside cells of some thousand, and the cells' counts are
    summed on their own table: no bucket is sorted in one task.

    A text longer than `max_tokens` goes on in further pieces; none is cut off. A text without tokens
    (null, empty) has one row with 0 tokens and no bucket or batch. Repeated rows and ids are packed each.
    Ties of the hash go by id and piece. Further columns are ignored. An empty table gives an empty result.
    """
    if n_tokens is not None:
        count = n_tokens.cast("bigint")
    else:
        count = word_tokens(F.col("content")) if ids is None else F.size(F.coalesce(F.col(ids), F.array().cast(records.schema[ids].dataType)))
    held = [F.col(ids).alias("_ids")] if ids else []
    whole = records.select(F.col("sample_id").alias("_id"), *held, F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).cast("bigint").alias("_n"))
    pieces = whole.select("_id", "_n", *(["_ids"] if ids else []), F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("_n") / max_tokens) - 1).cast("bigint"))).alias("piece")).select(
        "_id", "piece", (F.col("piece") * max_tokens).alias("start_token"),
        F.least(F.lit(max_tokens).cast("bigint"), F.col("_n") - F.col("piece") * max_tokens).alias("n_tokens"),
        *([F.slice("_ids", (F.col("piece") * max_tokens + 1).cast("int"), F.lit(max_tokens)).alias("tokens")] if ids else []))
    histogram = [(r["n_tokens"], r["n"]) for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()]
    histogram.sort()
    bounds = bucket_bounds([x for x, _ in histogram], [c for _, c in histogram], buckets)
    cells = -(-sum(c for _, c in histogram) // CELL_ROWS) or 1
    bucket = F.lit(None).cast("bigint")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound).cast("bigint")).otherwise(bucket)
    h = F.xxhash64("_id", "piece")
    placed = pieces.select("*", F.when(F.col("n_tokens") > 0, bucket).alias("bucket_tokens"), h.alias("_h"), F.pmod(h, F.lit(cells)).alias("_cell"))
    sums = placed.groupBy("bucket_tokens", "_cell").agg(F.count("*").alias("_count"))
    before = sums.select(
        F.col("bucket_tokens").alias("_b"), F.col("_cell").alias("_c"),
        F.coalesce(F.sum("_count").over(Window.partitionBy("bucket_tokens").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("bucket_tokens", "_cell").orderBy("_h", "_id", "piece")) - 1)
    joined = numbered.join(before, F.col("bucket_tokens").eqNullSafe(F.col("_b")) & (F.col("_cell") == F.col("_c")))
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    return joined.select(
        F.col("_id").alias("sample_id"), "piece", "start_token", "n_tokens", "bucket_tokens",
        F.when(F.col("bucket_tokens").isNotNull(), F.floor((F.col("_before") + F.col("_rank")) / per_batch)).cast("bigint").alias("batch"),
        *(["tokens"] if ids else []))


def pack_texts(records: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, budget: int = BUDGET, buckets: int = BUCKETS,
               tokens: bool = False) -> DataFrame:
    """As `pack`, in tokens of the byte-level BPE file `tokenizer`; with `tokens`, every piece brings its token ids.

    Texts are encoded once and the counts (or ids) written; what the passes of `pack` read is that table.
    Null and empty texts, repeated rows, ties, further columns and empty tables are as stated there.
    """
    if tokens:
        return pack(settled(encode_ids(records, tokenizer), "ids"), None, max_tokens, budget, buckets, "ids")
    return pack(settled(count_tokens(records, tokenizer), "counts"), F.col("n_tokens"), max_tokens, budget, buckets)
