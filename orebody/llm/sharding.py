"""Sharding by global byte-size prefix sums.

Rows are range-partitioned and sorted on the id; each partition keeps running totals of its own rows, the
partitions' totals (one row each) give every partition its offset, and equal targets over the grand total cut the
line into contiguous shards. One shuffle, of ids and sizes only; the texts aren't moved.

Edge cases: a null text counts as no bytes; null ids stand first; rows with equal ids are ordered by their texts'
checksum and size, so repeated rows all get places of their own; an empty table gives no rows; columns other than id and text
are ignored; a row larger than a target makes its shard as large as that row, and neighbours may stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orebody.llm.common import materialize

OVERHEAD = 16
SHARDS = 40


def row_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text plus a fixed overhead a row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def with_running_totals(df: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """Add `start` (sum of `size` over all rows before, in `order`) and `position` (rows before), over the whole table.

    `df` should be narrow: its rows are shuffled once and written to the shared folder.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = StructType(list(ranged.schema.fields)).add("_start", "long").add("_position", "long")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = rows = 0
        for batch in batches:
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            positions = np.arange(rows, rows + len(sizes), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - sizes), pa.array(positions)], names)
            total, rows = int(ends[-1]) if len(ends) else total, rows + len(sizes)

    local = materialize(ranged.mapInArrow(run, schema), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition, at most `parts`
    offsets = local.groupBy("_part").agg(F.sum(size).alias("_b"), F.count("*").alias("_n"))
    offsets = offsets.select("_part", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, (F.col("_start") + F.col("_b0")).alias("start"), (F.col("_position") + F.col("_n0")).alias("position"))


def shard_by_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Columns: key, size, text_crc32, shard (0 to shards-1), slot (gapless from 0 in each shard, in key order).

    A row belongs to the shard in whose share of all bytes its middle lies.
    """
    rows = df.select(key, row_size(text).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = with_running_totals(rows, [key, "text_crc32", "size"], "size", "shards")
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    exact = f"cast((cast(start as decimal(38,0)) * 2 + size) * {shards} div {max(1, 2 * total)} as int)"  # beyond 64 bits at petabytes
    cut = placed.withColumn("shard", F.expr(exact))
    firsts = cut.groupBy("shard").agg(F.min("position").alias("_first"))  # at most `shards` rows
    out = cut.join(F.broadcast(firsts), "shard")
    return out.select(key, "size", "text_crc32", "shard", (F.col("position") - F.col("_first")).alias("slot"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_by_bytes(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP6_SQL = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda k: k::BIGINT),
      lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(i))
), docs AS (
  SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, strlen(text) + {OVERHEAD} AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT),
      lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM docs, crc_table
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM sized
), cut AS (
  SELECT *, (((start * 2 + size) * {SHARDS}) // (2 * total))::INTEGER AS shard FROM placed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
