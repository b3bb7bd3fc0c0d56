"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bits of one bitmap of bitmap_construct_agg.
BITMAP_BITS = 32768
#: Parts in whose order keys are stored; the most rounds there can be.
PARTS = 4096
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without the characters U+0020 and U+0009 to U+000D; null: empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _slots(hashed: Column, bits: int) -> Column:
    """Two Bloom slots of a hash."""
    return F.array(*(F.pmod(F.xxhash64(hashed, F.lit(seed)), F.lit(bits)) for seed in (17, 71)))


def bloom_filter(repeated: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of the Bloom filter of the hashes in `repeated`."""
    slots = repeated.select(F.explode(_slots(F.col("h"), bits)).alias("slot"))
    return slots.groupBy(F.floor(F.col("slot") / BITMAP_BITS).cast("int").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(slot % {BITMAP_BITS})").alias("bitmap"))


def _bit(bitmap: Column, slot: Column) -> Column:
    """Whether the slot's bit is set; a bucket without bitmap has none."""
    byte = F.conv(F.hex(F.substring(bitmap, (slot % BITMAP_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (slot % 8).cast("int")) == 1, F.lit(False))


def with_maybe(keys: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """keys with `maybe`: whether the Bloom filter `bitmaps` of so many bits has their hash h. The filter is broadcast, no key moves."""
    out = keys.withColumn("slots", _slots(F.col("h"), bits))
    for k in (0, 1):
        slot = F.col("slots")[k]
        out = out.withColumn(f"bucket{k}", F.floor(slot / BITMAP_BITS).cast("int"))
        side = F.broadcast(bitmaps).select(F.col("bucket").alias(f"bucket{k}"), F.col("bitmap").alias(f"bitmap{k}"))
        out = out.join(side, f"bucket{k}", "left").withColumn(f"hit{k}", _bit(F.col(f"bitmap{k}"), slot)).drop(f"bitmap{k}")
    return out.select(*keys.columns, (F.col("hit0") & F.col("hit1")).alias("maybe"))


def _tested(keys: DataFrame, repeated: DataFrame, bits: int) -> DataFrame:
    """keys with `maybe`: whether the Bloom filter of `repeated` has the hash."""
    return with_maybe(keys, bloom_filter(repeated, bits), bits).select("doc_id", "text_sha256", "n_points", "maybe")


def exact_dedup(docs: DataFrame, bits_per_row: int = 16, most_bits: int = 1 << 30) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    First pass: the 64-bit hashes of the texts are counted with map-side combining (eight bytes for each
    distinct hash of a task, so a hot text sends one row per task; no text, id or key moves), and a Bloom
    filter is made of those that occur again. Second pass: only rows that the filter has can have an equal, so
    only those shuffle by their key; the others pass straight through with a group of one.

    The filter has bits_per_row bits for each repeated hash, however many there are. At most about most_bits
    of them (128 MB, the bound of the broadcast) are sent at a time: the hashes are dealt to so many
    rounds, each of which reads its own rows of the keys, which are stored in that order, and nothing else
    changes. Hot groups are pre-aggregated before the shuffle, and the join back is split by Spark's skew join.

    Null texts are empty texts and equal to other empty ones. Of equal texts the row with the
    most code points in the original text stays, then the smallest doc_id; null doc_ids come
    last. Rows that share a doc_id count separately, and of repeated rows with the winner's
    doc_id each is marked kept. Very long texts are hashed where they are, whole. Other columns are
    ignored, whatever their names. Empty input: no rows.
    """
    keys = docs.select(
        "doc_id",
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
    )
    keys = keys.withColumn("h", F.xxhash64("text_sha256")).withColumn("part", F.pmod(F.xxhash64("h", F.lit(5)), F.lit(PARTS)))
    keys = stored(keys.sortWithinPartitions("part"))
    repeated = stored(keys.groupBy("h", "part").agg(F.count("*").alias("n")).filter("n > 1").select("h", "part"))
    wanted = repeated.count() * bits_per_row
    rounds = min(PARTS, max(1, -(-wanted // most_bits)))
    bits = max(BITMAP_BITS, -(-wanted // rounds))
    cuts = [PARTS * i // rounds for i in range(rounds + 1)]
    own = lambda df, i: df.filter(F.col("part").between(cuts[i], cuts[i + 1] - 1))
    tested = stored(*(_tested(own(keys, i), own(repeated, i), bits) for i in range(rounds)))
    single = tested.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = tested.filter("maybe").select("doc_id", "text_sha256", "n_points")
    # stored, so that the join below is between two plain shuffles, which Spark can split by skew
    first = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    best = stored(maybe.groupBy("text_sha256").agg(first["doc_id"].alias("keep_id"), F.count("*").alias("group_size")))
    repeated_rows = maybe.join(best, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return single.unionByName(repeated_rows)


ORACLE_SQL = r"""
WITH k AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n_points
  FROM documents
), b AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM k
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM b
"""
