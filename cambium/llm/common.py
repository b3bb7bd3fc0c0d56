"""Helpers that the corpus operators share: tables, checkpoints, byte buffers and hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only a local session, whose executors are threads of this process, gets one of its own where none is
    set; on a cluster that is an error, since a machine's own folder would lose rows.
    """
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="cambium-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


#: Spark's setting for whether a query's shuffle files go with its end, not with the driver's garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Cut the lineage: write df, and others of its columns after it, as Parquet in the shared folder and read all back.

    What was shuffled for it is deleted once it is written: no later query reads it, and texts would lie there until the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete the session's stored tables, once no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "stored-*")) or []:
        fs.delete(found.getPath(), True)


def free_name(name: str, taken: list[str]) -> str:
    """The name, or a longer one that isn't taken (Spark doesn't tell upper from lower case)."""
    known = {c.lower() for c in taken}
    while name in known:
        name = f"_{name}"
    return name


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as decimal text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def least_hashed(df: DataFrame, key: str, group: str | None, quota: int) -> DataFrame:
    """(group, key) of the `quota` keys of each group whose hashes are the least; ties by the key itself.

    The 64-bit hashes are compared with quota / rows of the group, with room for 64 more, so that only about
    twice the quota is shuffled and sorted for each group, however many rows there are, and never none. A
    group's distinct keys are counted by a sketch; that many rows may share a key doesn't matter. Null keys
    and groups are left out. Without a group, all keys are one.
    """
    names = [group, key] if group else [key]
    known = df.select(*names).dropna().withColumn("h", F.xxhash64(key, F.lit(29)))
    distinct = F.approx_count_distinct(key, 0.02).alias("n")
    if group:
        known, n = known.join(F.broadcast(known.groupBy(group).agg(distinct)), group), F.col("n")  # a row a group
    else:
        n = F.lit(known.agg(distinct).first()[0] or 1)
    near = known.filter(F.col("h") / F.lit(float(1 << 63)) <= 2.0 * (2 * quota + 64) / n - 1).select(*names, "h").distinct()
    if not group:
        return near.orderBy("h", key).limit(quota).select(key)
    place = F.row_number().over(Window.partitionBy(group).orderBy("h", key))
    return near.withColumn("place", place).filter(F.col("place") <= quota).select(*names)


def tagged(df: DataFrame, text: str = "text") -> DataFrame:
    """df with h, the hash of its text, and at, a number of its row; to be stored before one_row_each."""
    return df.withColumn("h", F.xxhash64(text)).withColumn("at", F.monotonically_increasing_id())


def one_row_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of a stored table for each of its few keys: that of the least h, and of equal ones any.

    Only numbers are grouped, so that no text is sorted; the keys, which the caller bounds, are broadcast.
    """
    least = df.groupBy(*keys).agg(F.min("h").alias("h"))
    first = df.select(*keys, "h", "at").join(F.broadcast(least), [*keys, "h"]).groupBy(*keys).agg(F.min("at").alias("at"))
    return df.join(F.broadcast(first.select("at")), "at", "left_semi")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; one pass over the text column."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def spread(total_bytes: int, bytes_per_part: int, least: int = 12) -> int:
    """Number of partitions, in proportion to the data."""
    return max(least, -(-total_bytes // bytes_per_part))


#: Spark's setting for the bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """From now on the session's Arrow batches hold about `limit` bytes, if they could hold more (64 MB, as Spark has it).

    A batch is there several times: as it is filled (twice while its buffers grow), on its way, and in the Python worker, which still has the
    one before. Results don't hang on it.
    """
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES)) > limit:
        spark.conf.set(BATCH_BYTES, f"{limit}b")


_LIBC = ctypes.CDLL(None)


def release_memory() -> None:
    """Give freed memory back at the end of a task; workers live on and the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into runs of rows whose texts have about `limit` bytes.

    Yields the rows, the concatenated UTF-8 bytes (null: empty) and the offsets (rows + 1).
    A single text longer than the limit makes a run of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        if values.null_count:
            values = values.fill_null("")
        wide = np.dtype(np.int64 if pa.types.is_large_string(values.type) else np.int32)
        offsets = np.frombuffer(values.buffers()[1], wide, n + 1, values.offset * wide.itemsize).astype(np.int64)
        data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            hi = min(hi, n)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi
    release_memory()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` bytes by doubling; shorter than width: empty."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, size = None, 0, (data.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15), 1
    rest = width
    while True:
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * U64(0xC2B2AE3D27D4EB4F) + part
            done += size
        rest >>= 1
        if not rest:
            return mix64(out)
        power = power[:-size] * U64(0x165667B19E3779F9 + 2 * size) + power[size:]
        power ^= power >> U64(33)
        size *= 2


#: Fixed: white space of the word and copy contracts, U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `inside`, cut at document bounds, and each run's document."""
    n = len(inside)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    first = np.zeros(n, bool)
    inner = offsets[1:-1]
    first[inner[inner < n]] = True
    first[0] = True
    starts = np.flatnonzero(inside & (first | np.concatenate(([True], ~inside[:-1]))))
    last = np.concatenate((first[1:], [True]))
    ends = np.flatnonzero(inside & (last | np.concatenate((~inside[1:], [True])))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_POWERS = np.zeros(0, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate(([U64(1)], np.full(max(n, 1 << 16) * 5 // 4, 0x9E3779B97F4A7C15, U64))))
    return _POWERS[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word: a weighted sum of mixed bytes, aligned at the word's start."""
    if not len(starts):
        return np.zeros(0, U64)
    table_ = mix64(np.arange(1, 257, dtype=U64))
    length = ends - starts
    order_sum = np.zeros(len(starts), U64)
    longest = int(length.max())
    powers = _powers(longest + 1)
    live = np.arange(len(starts))
    for k in range(min(longest, 24)):  # short words by column, what is left of long ones by run below
        live = live[length[live] > k]
        order_sum[live] += table_[data[starts[live] + k]] * powers[k]
    long = live[length[live] > 24]
    if len(long):
        tail = length[long] - 24
        runs = np.concatenate(([0], np.cumsum(tail)))[:-1]
        within = np.arange(tail.sum()) - np.repeat(runs, tail)
        flat = np.repeat(starts[long] + 24, tail) + within
        order_sum[long] += np.add.reduceat(table_[data[flat]] * powers[24 + within], runs)
    return mix64(order_sum ^ length.astype(U64) * U64(0xD1B54A32D192ED03))
