"""Packing: optimal length buckets and token-budget batches.

Texts longer than the context are cut into pieces of the context's length, so that lengths, and with them the global
histogram, have a fixed bound. Dynamic programming over the whole histogram chooses the bucket boundaries with the least
padding; inside each bucket, batches hold as many sequences as the token budget allows at the bucket's length.

Edge cases: null and empty texts hold only the end token and make one piece of length 1; null ids form ordinary rows;
repeated rows each get places of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.llm.common import materialize

CONTEXT = 2048
BUCKETS = 16
BUDGET = 65_536
BLOCKS = 4096


def token_count(text: str = "text") -> Column:
    """Words between ASCII white space, plus one end token."""
    # a word starts where a byte that is no white space follows white space: counted on a copy in which white space is one character
    flat = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return (F.size(F.array_remove(F.split(flat, " "), "")) + 1).cast("long")


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds (lengths, ascending) of at most `buckets` buckets that minimise the padding over a histogram.

    Exact: best[k][j] = min over i < j of best[k-1][i] + the padding of lengths i+1 to j at length j.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(n)] for n in lengths], np.float64)
    rows = np.concatenate([[0.0], np.cumsum(counts)])
    tokens = np.concatenate([[0.0], np.cumsum(counts * lengths)])
    m, k = len(lengths), min(buckets, len(lengths))
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = np.zeros((k, m + 1), np.int64)
    for step in range(k):
        new = np.full(m + 1, np.inf)
        for j in range(step + 1, m + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1] - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            new[j], back[step, j] = cost[i], i
        best = new
    out, j = [], m
    for step in range(k - 1, -1, -1):
        out.append(int(lengths[j - 1]))
        j = int(back[step, j])
    return out[::-1]


def _block_of(key: str, blocks: int) -> Column:
    """A number below `blocks` (2^28 at most) for each piece, from a digest that SQL engines have in common."""
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("piece").cast("string"), F.col("n_tokens").cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % blocks).cast("int")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", length: Column | None = None, context: int = CONTEXT, buckets: int = BUCKETS, budget: int = BUDGET, blocks: int = BLOCKS) -> DataFrame:
    """One row per piece: key, piece, first_token, n_tokens, bucket, bucket_len, padding, batch, slot.

    `batch` counts from 0 in its bucket, gapless; batch b holds the bucket's pieces b*c to b*c+c-1 in the order of a hash
    block and the key, c = budget // bucket_len (1 at least). `blocks` bounds the rows that any one task sorts to 1/blocks of a bucket.
    """
    lengths = df.select(F.col(key), (token_count(text) if length is None else length).alias("_n"))
    pieces = lengths.select(key, "_n", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / context).cast("int"))).alias("piece"))
    pieces = pieces.select(key, "piece", (F.col("piece").cast("long") * context).alias("first_token"), F.least(F.lit(context), F.col("_n") - F.col("piece").cast("long") * context).cast("int").alias("n_tokens"))
    pieces = materialize(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("n_tokens").count().collect()}  # `context` rows at most
    bounds = optimal_boundaries(histogram, buckets) or [1]
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(i)) for i, b in enumerate(bounds)])
    placed = pieces.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1))
    placed = placed.withColumn("_block", _block_of(key, blocks))
    sizes = placed.groupBy("bucket", "_block").agg(F.count("*").alias("_c"))  # buckets * blocks rows at most
    before = Window.partitionBy("bucket").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("bucket", "_block").orderBy(key, "piece", "n_tokens")
    ranked = placed.withColumn("_r", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["bucket", "_block"])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    at = F.col("_before") + F.col("_r")
    return ranked.select(
        key, "piece", "first_token", "n_tokens", "bucket", "bucket_len", (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        F.floor(at / capacity).cast("long").alias("batch"), F.pmod(at, capacity).cast("int").alias("slot"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into length buckets and token-budget batches."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = rf"""
WITH RECURSIVE lens AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n FROM documents
), cut AS (SELECT doc_id, n, unnest(range((n - 1) // {CONTEXT} + 1)) AS piece FROM lens
), pieces AS (SELECT doc_id, piece, piece * {CONTEXT} AS first_token, least({CONTEXT}, n - piece * {CONTEXT}) AS n_tokens FROM cut
), h AS (SELECT n_tokens AS l, count(*) AS c, row_number() OVER (ORDER BY n_tokens) AS j FROM pieces GROUP BY n_tokens
), sums AS (SELECT j, l, (sum(c) OVER (ORDER BY j))::BIGINT AS r, (sum(c * l) OVER (ORDER BY j))::BIGINT AS t FROM h UNION ALL SELECT 0, 0, 0, 0
), best AS (
  SELECT 0 AS k, 0::BIGINT AS j, 0::BIGINT AS padding, []::BIGINT[] AS bounds
  UNION ALL
  SELECT k + 1, b.j, min(padding + (b.r - a.r) * b.l - (b.t - a.t)), arg_min(list_append(bounds, b.l), (padding + (b.r - a.r) * b.l - (b.t - a.t)) * 4096 + a.j)
  FROM best JOIN sums a ON a.j = best.j JOIN sums b ON b.j > a.j WHERE k < least({BUCKETS}, (SELECT count(*) FROM h)) GROUP BY k, b.j
), chosen AS (SELECT bounds FROM best WHERE k = least({BUCKETS}, (SELECT count(*) FROM h)) AND j = (SELECT count(*) FROM h)
), placed AS (
  SELECT doc_id, piece, first_token, n_tokens, len(list_filter(bounds, lambda b: b < n_tokens)) AS bucket, bounds[len(list_filter(bounds, lambda b: b < n_tokens)) + 1] AS bucket_len,
    ('0x' || substr(md5(concat_ws('|', doc_id, piece, n_tokens)), 1, 7))::BIGINT % {BLOCKS} AS block FROM pieces, chosen
), ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY block, doc_id NULLS FIRST, piece, n_tokens) - 1 AS place, greatest(1, {BUDGET} // bucket_len) AS capacity FROM placed)
SELECT doc_id, piece::INTEGER AS piece, first_token::BIGINT AS first_token, n_tokens::INTEGER AS n_tokens, bucket::INTEGER AS bucket, bucket_len::INTEGER AS bucket_len, (bucket_len - n_tokens)::INTEGER AS padding,
  (place // capacity)::BIGINT AS batch, (place % capacity)::INTEGER AS slot FROM ranked
"""
