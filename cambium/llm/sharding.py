"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def shard_by_bytes(docs: DataFrame, shards: int = 24, row_overhead: int = 8, rows_per_part: int = 1_000_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Global order: MD5 of the text, then doc_id, so equal texts are neighbours and a hot group
    is cut by doc_id. The rows (without texts) are range partitioned, each partition's total is
    added up, a prefix sum over the totals (one row per partition) gives each partition's
    start, and a window inside each partition gives each row's. Shard i takes the rows that
    begin in the i-th of `shards` equal stretches of bytes; sizes differ by one row's size at
    most. slot counts from 0 within a shard.

    Null text: no bytes, so size is row_overhead. Null doc_ids come first among equal texts; rows with the same
    text and doc_id are interchangeable. A very long text is a row like any other, and may be larger than a
    shard's share. Other columns are ignored. Empty input: no rows. Law: `bytes`; grown_shard is null.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + row_overhead).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"),
    )
    rows = stored(rows)
    parts = max(12, -(-rows.count() // rows_per_part))
    placed = stored(rows.repartitionByRange(parts, "h", "doc_id").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy("h", "doc_id")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(every).alias("whole"),
    )
    numbered = (
        placed.withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("nr", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), "part")  # one row per range partition
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"cast(((bytes_before + run) * {shards}) div whole as int)").alias("shard"),
            (F.col("rows_before") + F.col("nr")).alias("nr"),
        )
    )
    numbered = stored(numbered)
    firsts = numbered.groupBy("shard").agg(F.min("nr").alias("first_nr"))
    return numbered.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nr") - F.col("first_nr")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


ORACLE_SQL = """
WITH crc AS (  -- the table of the reversed polynomial
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS size FROM documents
), c AS (
  SELECT doc_id, size, md5(text) AS h,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS text_crc32
  FROM d, crc
), run AS (
  SELECT *, sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS whole FROM c
), placed AS (SELECT *, ((before * 24) // whole)::INT AS shard FROM run)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM placed
"""
