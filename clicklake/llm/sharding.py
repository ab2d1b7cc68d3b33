"""Sharding: contiguous shards of near-equal bytes, cut from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, with_row_key


def shard_by_bytes(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents, in ascending id, to `shards` contiguous runs of near-equal bytes.

    A row's size is its text's UTF-8 bytes plus 1. The rows are range-partitioned by id; each partition's total is
    one small row, the running sum over these totals gives every partition its global start, and a window inside a
    partition gives every row its own. The row goes to the shard in whose equal share of the total its middle byte
    lies, so a shard misses its target by less than the largest row. Only id, size, checksum and row key are moved.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard, in id order), start_byte.
    Null text: size 1 and the checksum of no bytes. Null ids come first. Equal ids (repeated rows) are ordered by
    checksum, size and place in the input, each with a slot of its own. A row larger than a share can leave shards
    empty. An empty table gives no rows. Other columns of `docs` are not read.
    """
    scratch = Scratch(spark, "sharding")
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = with_row_key(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "row_key")
    order = ["doc_id", "text_crc32", "size", "row_key"]
    ranged = scratch.cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    # One row a partition: their number is that of shuffle partitions, not of documents.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"), F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumns({"byte1": F.coalesce(F.sum("size").over(inside), F.lit(0)), "row1": F.coalesce(F.count("*").over(inside), F.lit(0))})
        .join(F.broadcast(totals), "part")
        .withColumns({"start_byte": F.col("byte0") + F.col("byte1"), "row": F.col("row0") + F.col("row1")})
        # Twice the middle byte, so that all is exact in decimals of 38 digits.
        .withColumn("shard", F.expr(f"least(cast(floor((cast(2 * start_byte + size as decimal(30,0)) * {int(shards)}) / cast(2 * total as decimal(30,0))) as int), {int(shards) - 1})"))
    )
    placed = scratch.cut(placed.select("doc_id", "size", "text_crc32", "shard", "row", "start_byte"), "placed")
    scratch.drop(ranged)
    first = placed.groupBy("shard").agg(F.min("row").alias("row0"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("row0")).alias("slot"), "start_byte")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no crc32: a table of 256 entries from its definition, and a fold over the bytes.
SQL = """
WITH RECURSIVE bits AS (
  SELECT i AS b, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
hex_pairs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS pairs
  FROM documents
), sized AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(pairs, lambda p: ('0x' || p)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM hex_pairs, crc_table
), running AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_byte, sum(size) OVER () AS total
  FROM sized
), dealt AS (
  SELECT *, least((((2 * start_byte + size)::HUGEINT * 16) // (2 * total)::HUGEINT)::INTEGER, 15) AS shard FROM running
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""
