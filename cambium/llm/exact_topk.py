"""Exact search for the largest inner products by a vector-approximation file: bounds from quantised cells, then exact vectors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release_memory, shared_dir, stored

#: Rows of a block of bounds; with the queries of a chunk it bounds a task's memory.
BLOCK_ROWS = 512
#: Pairs whose exact scores are taken at a time.
BLOCK_PAIRS = 16384
#: Vectors that the marks between cells are fitted on.
SAMPLE = 4096
#: The largest score that is given; what is beyond is this.
MOST = (1 << 63) - 1


# -- vectors ------------------------------------------------------------------------------------


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, v of every usable row: floor(scale * x) of its components, whole doubles in bytes."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.compute.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            lists = rows.column(1)
            if not rows.num_rows:
                continue
            ends = np.asarray(lists.value_lengths().to_numpy(), np.int64).cumsum()
            starts = np.concatenate(([0], ends[:-1]))
            flat = lists.flatten()
            known = np.asarray(flat.is_valid())
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * np.where(known, np.asarray(flat.fill_null(0)).astype(np.float64), np.nan)) + 0.0  # no -0
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            keep = bad[ends] == bad[starts]
            lengths = (ends - starts)[keep]
            values = np.ascontiguousarray(x[np.repeat(keep, ends - starts)])
            offsets = np.concatenate(([0], lengths.cumsum() * 8)).astype(np.int64)
            body = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(keep)).cast(pa.int64()), pa.array(lengths, pa.int32()), body], ["vec_id", "dim", "v"])

    return vectors.select("vec_id", "embedding").mapInArrow(floors, "vec_id long, dim int, v binary")


def _matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)
    release_memory()


def scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of v and q, pair by pair, as whole numbers: exact, but at most MOST either way."""
    if not len(v):
        return np.zeros(0, np.int64)
    if v.shape[1] * float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2.0**53:
        return np.einsum("ij,ij->i", v, q).astype(np.int64)
    exact = (sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(v, q, strict=True))
    return np.array([max(-MOST, min(MOST, s)) for s in exact], np.int64)


# -- cells --------------------------------------------------------------------------------------


class Cells:
    """Cells of every dimension, about equally filled: least and greatest values of each, and the marks between them."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, greatest: np.ndarray, bits: int):
        count = 1 << bits
        self.marks, self.low, self.high = [], np.zeros((len(least), count)), np.zeros((len(least), count))
        for j in range(len(least)):
            marks = np.unique(np.quantile(sample[:, j], np.arange(1, count) / count, method="lower"))
            marks = marks[marks > least[j]]
            self.marks.append(marks)
            self.low[j, : len(marks) + 1] = np.concatenate(([least[j]], marks))
            below = np.where(np.abs(marks) < 2.0**53, marks - 1, marks)  # whole numbers end one below the next mark
            self.high[j, : len(marks) + 1] = np.concatenate((below, [greatest[j]]))

    def codes(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(m, v[:, j], "right") for j, m in enumerate(self.marks)], 1).astype(np.uint8) if v.shape[1] else np.zeros(v.shape, np.uint8)

    def upper(self, codes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """(queries, rows): no vector in the cells of a row has a larger inner product with the query."""
        at = np.arange(codes.shape[1])
        bound = np.maximum(q, 0) @ self.high[at, codes].T + np.minimum(q, 0) @ self.low[at, codes].T
        most = max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)) * np.abs(q).max(initial=0) * q.shape[1]
        if most >= 2.0**53:  # doubles round from here on
            bound += most * q.shape[1] * 2.0**-50
        return np.clip(bound, -float(MOST), float(MOST))


def fitted(classes: DataFrame, dim: int, bits: int) -> Cells:
    """Marks from the SAMPLE classes of the least hashes; least and greatest values from all of them."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, greatest = np.full(dim, np.inf), np.full(dim, -np.inf)
        for block in _blocks(batches):
            v = _matrix(block.column(0), dim)
            least, greatest = np.minimum(least, v.min(0)), np.maximum(greatest, v.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(least), pa.array(greatest)], ["j", "least", "greatest"])

    bounds = classes.select("v").mapInArrow(extremes, "j int, least double, greatest double").groupBy("j").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    ends = sorted(tuple(r) for r in bounds.collect())  # a row a dimension
    sample = classes.orderBy(F.xxhash64("cid", F.lit(3)), "cid").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    return Cells(_matrix(sample, dim), np.array([e[1] for e in ends]), np.array([e[2] for e in ends]), bits)


# -- search -------------------------------------------------------------------------------------


def _lists(keys: np.ndarray, counts: np.ndarray, fields: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each key with a list of `counts` structs."""
    entries = pa.StructArray.from_arrays([pa.array(a) for a in fields.values()], list(fields))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], counts.cumsum())), pa.int32()), entries)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["qcid", "best"])


class Best:
    """For each query the `size` first entries by (-score, low)."""

    def __init__(self, queries: int, size: int):
        self.queries, self.size, self.q = queries, size, np.zeros(0, np.int64)
        self.score, self.low, self.cid = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = np.full(queries, -MOST - 1, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, low: np.ndarray, cid: np.ndarray) -> None:
        """New entries; only the queries that have some are sorted again."""
        asked = np.zeros(self.queries, bool)
        asked[q] = True
        again = asked[self.q]
        held = (self.q, self.score, self.low, self.cid)
        rest = [x[~again] for x in held]
        q, score, low, cid = (np.concatenate((x[again], y)) for x, y in zip(held, (q, score, low, cid), strict=True))
        order = np.lexsort((cid, low, -score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order], "left")
        keep, full = order[place < self.size], order[place == self.size - 1]
        self.q, self.score, self.low, self.cid = (np.concatenate((x, y[keep])) for x, y in zip(rest, (q, score, low, cid), strict=True))
        self.kth[q[full]] = score[full]

    def lists(self, keys: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(self.q, kind="stable")
        return _lists(keys, np.bincount(self.q, minlength=self.queries), {"less": -self.score[order], "low": self.low[order], "cid": self.cid[order]})


def nearest_bounds(file: DataFrame, cells: Cells, queries, size: int) -> DataFrame:
    """qcid, best: for each query of the chunk the `size` rows of the file with the greatest bounds; reads codes, no vectors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, _ = queries.value
        bound, cid = np.full((len(keys), size), -np.inf), np.zeros((len(keys), size), np.int64)
        for block in _blocks(batches):
            upper = cells.upper(_matrix(block.column(1), q.shape[1], np.uint8), q)
            hit = np.flatnonzero(upper.max(1) > bound.min(1))
            both = np.concatenate((bound[hit], upper[hit]), 1)
            ids = np.concatenate((cid[hit], np.broadcast_to(block.column(0).to_numpy(), (len(hit), block.num_rows))), 1)
            first = np.argpartition(-both, size - 1, 1)[:, :size] if len(hit) else np.zeros((0, size), np.int64)
            bound[hit], cid[hit] = np.take_along_axis(both, first, 1), np.take_along_axis(ids, first, 1)
        filled = bound > -np.inf
        yield _lists(keys, filled.sum(1), {"bound": bound[filled], "cid": cid[filled]})

    found = file.select("cid", "code").mapInArrow(scan, "qcid long, best array<struct<bound double, cid long>>")
    return found.groupBy("qcid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, size).alias("best"))


def sure_scores(file: DataFrame, first: DataFrame, queries, size: int) -> dict[int, int]:
    """The size-th largest exact score of each query among its first candidates, where it has so many.

    A chunk's first candidates are as many rows as queries times their number, so they are broadcast.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, _ = queries.value
        for block in _blocks(batches):
            at = np.searchsorted(keys, block.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(scores(_matrix(block.column(1), q.shape[1]), q[at]))], ["qcid", "score"])

    pairs = file.select("cid", "v").join(F.broadcast(first.select("qcid", F.explode("best.cid").alias("cid"))), "cid").select("qcid", "v")
    exact = pairs.mapInArrow(read, "qcid long, score long").groupBy("qcid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    return {r[0]: r[1] for r in exact.filter(F.size("s") >= size).select("qcid", F.element_at("s", size)).collect()}


def certain(file: DataFrame, cells: Cells, queries, size: int) -> DataFrame:
    """qcid, best: the first `size` rows of the file for each query, by exact score and then the least id.

    Candidates are the rows whose bound reaches the score that the query is sure of. They are read in the order of their
    bounds; what falls below a score that has been reached since isn't read any more. No pair leaves its task.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, sure = queries.value
        best = Best(len(keys), size)
        for block in _blocks(batches):
            cid, low = block.column(0).to_numpy(), block.column(1).to_numpy()
            upper = cells.upper(_matrix(block.column(2), q.shape[1], np.uint8), q)
            v = _matrix(block.column(3), q.shape[1])
            at, row = np.nonzero(upper >= np.maximum(sure, best.kth)[:, None].astype(np.float64))
            order = np.argsort(-upper[at, row], kind="stable")
            at, row = at[order], row[order]
            while len(at):
                best.add(at[:BLOCK_PAIRS], scores(v[row[:BLOCK_PAIRS]], q[at[:BLOCK_PAIRS]]), low[row[:BLOCK_PAIRS]], cid[row[:BLOCK_PAIRS]])
                at, row = at[BLOCK_PAIRS:], row[BLOCK_PAIRS:]
                still = upper[at, row] >= best.kth[at].astype(np.float64)
                at, row = at[still], row[still]
        yield best.lists(keys)

    found = file.select("cid", "low", "code", "v").mapInArrow(scan, "qcid long, best array<struct<less long, low long, cid long>>")
    return found.groupBy("qcid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, size).alias("best"))


def search(classes: DataFrame, asked: DataFrame, dim: int, k: int, bits: int, chunk: int, rows_per_part: int, path: str) -> None:
    """Append (qcid, best) of every class in `asked` to the table at path, a chunk of query classes at a time."""
    spark = classes.sparkSession
    cells = fitted(classes, dim, bits)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            codes = cells.codes(_matrix(block.column(2), dim))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), block.column(2)], ["cid", "low", "code", "v"])

    parts = max(12, -(-classes.count() // rows_per_part))
    file = stored(classes.select("cid", "low", "v").repartition(parts).mapInArrow(encode, "cid long, low long, code binary, v binary"))
    chunks = max(1, -(-asked.count() * 5 // (4 * chunk)))  # a hash fills a chunk unevenly
    for i in range(chunks):
        part = asked.filter(F.pmod(F.xxhash64("cid", F.lit(5)), F.lit(chunks)) == i).select("cid", "v").orderBy("cid").toArrow()
        if not part.num_rows:
            continue
        keys, q = part.column(0).to_numpy(), _matrix(part.column(1).combine_chunks(), dim)
        queries = spark.sparkContext.broadcast((keys, q, None))
        known = sure_scores(file, nearest_bounds(file, cells, queries, 2 * k), queries, k)
        surer = spark.sparkContext.broadcast((keys, q, np.array([known.get(x, -MOST - 1) for x in keys.tolist()], np.int64)))
        certain(file, cells, surer, k).write.mode("append").parquet(path)
        queries.destroy()
        surer.destroy()


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, bits: int = 6, chunk: int = 8192, rows_per_part: int = 100_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every row whose vec_id is divisible by `every`.

    Components are floor(scale * x), x as double; all other rows are candidates, ties go to the smaller vec_id. Equal vectors are
    one class with its k + 1 least ids, more of which no query can return, and are sought once. The approximation file has a
    byte for each component of a class: the number of its cell, of 2**bits about equally filled ones. It is scanned for
    bounds; the 2k vectors of the greatest bounds are read, which makes a query sure of a least score, and then all whose bound
    reaches it, in the order of their bounds. Marks are fitted on a sample, yet every class is in the file and the result is exact.

    Query classes are sent in chunks of about `chunk`, at most 8 bytes for each component, so what is broadcast and a
    task's lists don't grow with the table; each chunk reads the file where it lies. The results of a task are at most 2k entries a query.

    Rows that are null, hold null or a component that isn't finite (times `scale`, too), or lack a vec_id take no part. Only vectors of one
    length are compared; empty ones score 0. Repeated rows count once; rows that share a vec_id are rows of their own, of which a query leaves out
    its own. Scores beyond a long are the nearest of +-(2^63 - 1). Other columns are ignored. Empty input: no rows.
    """
    spark = vectors.sparkSession
    rows = stored(integers(vectors, scale).withColumn("h", F.unhex(F.md5("v"))))
    ids = rows.select("h", "vec_id").distinct()
    place = F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))
    least = ids.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("h").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    whole = rows.groupBy("h").agg(F.first("v").alias("v"), F.first("dim").alias("dim"))
    classes = stored(whole.join(least, "h").select(F.monotonically_increasing_id().alias("cid"), "h", "dim", "v", "ids", F.col("ids")[0].alias("low")))
    asking = stored(ids.filter(F.col("vec_id") % every == 0).join(classes.select("h", F.col("cid").alias("qcid")), "h").select(F.col("vec_id").alias("query_id"), "qcid"))
    asked = stored(classes.join(asking.select(F.col("qcid").alias("cid")).distinct(), "cid").select("cid", "dim", "v"))

    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    schema = "qcid long, best array<struct<less: long, low: long, cid: long>>"
    spark.createDataFrame([], schema).write.parquet(path)
    for (dim,) in sorted(asked.select("dim").distinct().collect()):  # lengths of vectors, one as a rule
        same = F.col("dim") == dim
        search(classes.filter(same), asked.filter(same), dim, k + 1, bits, chunk, rows_per_part, path)
    found = spark.read.schema(schema).parquet(path).select("qcid", F.explode("best").alias("b")).select("qcid", "b.less", "b.cid")
    entries = found.join(classes.select("cid", "ids"), "cid").select("qcid", F.explode("ids").alias("vec_id"), "less", "cid")
    entry = F.struct("less", "vec_id", (F.col("cid") == F.col("qcid")).alias("same"))
    lists = stored(entries.groupBy("qcid").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("best")))  # (k + 1)^2 entries at most
    others = F.filter("best", lambda e: ~(e["same"] & (e["vec_id"] == F.col("query_id"))))
    ranked = asking.join(lists, "qcid").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "e"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", (-F.col("e.less")).alias("score"))


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND (q.vec_id <> c.vec_id OR q.v <> c.v) WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
