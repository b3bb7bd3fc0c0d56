"""How often the hashes of a text occur over the whole corpus, sent back to where the text is.

Documents are dealt to slices once. Each slice sends its distinct hashes, as sorted and packed
slots, to the buckets of the slot space; a bucket adds up and replies to each slice. Nothing is
gathered on the driver or broadcast, and all parts grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, release_memory, spread

#: Occurrences from which a slot has level 1, 2 and 3.
LEVEL_FROM = (2, 16, 128)
SLICE_BYTES = 8 << 20
SLOTS_EACH = 16


def sliced(docs: DataFrame, total_bytes: int) -> DataFrame:
    """doc_id, text, tie and slice: the documents with the slice they are dealt to."""
    slices = spread(total_bytes, SLICE_BYTES, 24)
    tie = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select("doc_id", "text", tie.alias("tie"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)).cast("int").alias("slice"))


def in_order(table: pa.Table) -> pa.Table:
    """A slice's rows in an order that doesn't depend on how they were fetched; null doc_ids last.

    Rows that still tie are the same in all that counts.
    """
    return table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("tie", "ascending")])).combine_chunks()


def _pack(values: np.ndarray) -> bytes:
    """Ascending 32-bit values by their steps, a byte plane after the other."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, 4 * n, "zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel(), dtype=np.int64)


def with_levels(docs: DataFrame, draw: Callable[[pa.Table], np.ndarray], finish: Callable[[pa.Table, np.ndarray], Iterator[tuple]], schema: pa.Schema, kinds: str, expected: int, level_from: tuple[int, ...] = LEVEL_FROM) -> DataFrame:
    """finish(table, levels) for each slice of docs, where levels has one for each drawn hash.

    draw gives the 64-bit hashes of a slice (its rows in order); finish gives the rows of
    `schema` (`kinds` for Spark). Level 0: the hash occurs once; 1 and so on: at least level_from
    times. Different hashes may share a slot, of which there are SLOTS_EACH for each expected
    one, so levels may be too high, never too low.
    """
    bits = max(12, (SLOTS_EACH * max(expected, 1) - 1).bit_length())
    low = min(bits, max(20, min(26, bits - 9)))  # slots of a bucket: up to 256 MB of counts in its task
    to_bucket = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("n", pa.int32()), ("at", pa.binary()), ("count", pa.binary())])
    to_slice = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("level", pa.binary())])

    def slots(table: pa.Table) -> np.ndarray:
        return draw(table) >> U64(64 - bits)

    def send(table: pa.Table) -> pa.Table:
        own = np.sort(slots(in_order(table)))
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))[: len(own)]
        counts = np.minimum(np.diff(np.append(first, len(own))), 255).astype(np.uint8)
        own = own[first]
        bucket = (own >> U64(low)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[: len(own)].tolist()
        within = (own & U64((1 << low) - 1)).astype(np.uint32)
        here, rows = table.column("slice")[0].as_py(), []
        for lo, hi in zip(cuts, [*cuts[1:], len(own)], strict=False):
            rows.append((int(bucket[lo]), here, hi - lo, _pack(within[lo:hi]), pa.compress(counts[lo:hi].tobytes(), "zstd", asbytes=True)))
        release_memory()
        return _table(rows, to_bucket)

    def add(table: pa.Table) -> pa.Table:
        total, rows = np.zeros(1 << low, np.uint32), table.to_pylist()
        for r in rows:
            total[_unpack(r["at"], r["n"])] += np.frombuffer(pa.decompress(r["count"], r["n"], "zstd"), np.uint8)
        level = sum((total >= x).astype(np.uint8) for x in level_from)
        out = [(r["slice"], r["bucket"], r["n"], pa.compress(level[_unpack(r["at"], r["n"])].tobytes(), "zstd", asbytes=True)) for r in rows]
        release_memory()
        return _table(out, to_slice)

    def receive(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = in_order(table)
        own, place = np.unique(slots(table), return_inverse=True)
        parts = [pa.decompress(r["level"], r["n"], "zstd", asbytes=True) for r in sorted(replies.to_pylist(), key=lambda r: r["bucket"])]
        level = np.frombuffer(b"".join(parts), np.uint8)
        out = _table(list(finish(table, level[place] if len(own) else level)), schema)
        release_memory()
        return out

    sent = docs.groupBy("slice").applyInArrow(send, "bucket int, slice int, n int, at binary, count binary")
    replies = sent.groupBy("bucket").applyInArrow(add, "slice int, bucket int, n int, level binary")
    return docs.groupBy("slice").cogroup(replies.groupBy("slice")).applyInArrow(receive, kinds)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
