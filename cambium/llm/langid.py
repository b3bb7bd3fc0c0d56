"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, free_name, least_hashed, one_row_each, release_memory, stored, tagged, text_slices

BUCKETS = 8192
CENTROIDS = 4
#: Bound of the labelled rows that centroids are fitted on, over all languages.
SAMPLE_ROWS = 4000
UNKNOWN = "und"
#: Rows counted at a time, and bytes of texts: a task takes some 30 MB, beside its batch, where all tasks of an executor add up.
_ROWS_AT_ONCE = 64
_BYTES_AT_ONCE = 512 << 10
#: Length classes of texts (powers of two of their trigrams), each with a least cosine of its own, and the rows it takes to find one.
LENGTHS = 18
_LEAST_ROWS = 20
CUT_CLASSES = 8


def ngram_counts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their counts of hashed byte trigrams (rows x BUCKETS, float32)."""
    for part, data, offsets in text_slices(batches, column, _BYTES_AT_ONCE):
        code = data.astype(np.uint32)
        code = (code[:-2] << 16 | code[1:-1] << 8 | code[2:]) if len(code) > 2 else code[:0]
        bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64)
        for lo in range(0, part.num_rows, _ROWS_AT_ONCE):
            hi = min(lo + _ROWS_AT_ONCE, part.num_rows)
            length = np.maximum(np.diff(offsets[lo : hi + 1]) - 2, 0)
            row = np.repeat(np.arange(hi - lo), length)
            ends = np.cumsum(length)
            at = np.arange(ends[-1]) + np.repeat(offsets[lo:hi] - (ends - length), length)
            counts = np.bincount(row * BUCKETS + bucket[at], minlength=(hi - lo) * BUCKETS)
            yield part.slice(lo, hi - lo), counts.reshape(hi - lo, BUCKETS).astype(np.float32)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square-root term frequency times idf, of length 1 (0 without any trigram); counts is overwritten."""
    x = np.sqrt(counts, out=counts)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=x, where=norm > 0)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of all docs each bucket occurs; BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, counts in ngram_counts(batches):
            total += (counts > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total)], names=["bucket", "df"])

    out = np.zeros(BUCKETS)
    for bucket, df in docs.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df")).collect():
        out[bucket] = df
    return out


def spherical_clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k centroids of unit vectors by cosine; the seeds are the mean and then the farthest rows."""
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-12)
    centres = unit(x.mean(0))[None]
    while len(centres) < min(k, len(x)):
        near = (x @ centres.T).max(1)
        centres = np.concatenate((centres, x[np.argsort(near)[: max(1, len(x) // 20)]].mean(0)[None]))
        centres[-1] = unit(centres[-1])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = np.stack([unit(x[own == c].mean(0)) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


def length_class(trigrams: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(trigrams, 1)).astype(int), 0, LENGTHS - 1)


def least_cosines(length: np.ndarray, clean: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The least accepted cosine of each length class, from rows kept out of the fit.

    clean: a row's cosine; noise: the cosine of the same counts in other buckets, which is what
    any text of that length gets by collisions. The bound lies half way (geometrically) between the top of the
    noise and the bottom of the clean rows of about that length, and well below the latter in any case. A class
    with few rows near takes the bound of the next shorter one, the first classes that of the next longer.
    """
    klass, out = length_class(length), np.full(LENGTHS, np.nan)
    for k in range(LENGTHS):
        near = np.abs(klass - k) <= 1
        if near.sum() >= _LEAST_ROWS:
            low, high = np.quantile(clean[near], 0.01), np.quantile(noise[near], 0.99)
            out[k] = min(np.sqrt(max(low, 0) * max(high, 0)), 0.7 * low)
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return np.full(LENGTHS, 0.1 * float(np.quantile(clean, 0.01)) if len(clean) else 0.0)
    return out[known[np.maximum(np.searchsorted(known, np.arange(LENGTHS), "right") - 1, 0)]]


class Model:
    """Centroids (one a row), their languages, the idf and the least accepted cosine of each by length class."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, langs: list[str], least: np.ndarray):
        self.idf, self.centres, self.langs, self.least = idf, centres, langs, least


def _dense(rows: list[tuple], move: np.ndarray | None = None) -> np.ndarray:
    counts = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, n, _) in enumerate(rows):
        counts[i, at if move is None else move[at]] = n
    return counts


def fit_language(rows: list[tuple], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and least cosines of one language's rows (buckets, counts, kept out).

    For the short lengths, trigrams drawn from the rows stand for short texts.
    """
    fitted, kept_out = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    own = spherical_clusters(unit_vectors(_dense(fitted or rows), idf), CENTROIDS)
    rows = kept_out if len(kept_out) >= _LEAST_ROWS else rows
    rng = np.random.default_rng(0)
    moved = rng.permutation(BUCKETS)
    flat = [rng.permutation(np.repeat(at, n.astype(np.int64))) for at, n, _ in rows]
    parts = [rows]
    for k in range(CUT_CLASSES):  # few rows are that short
        cut = (np.unique(x[: 3 << k >> 1], return_counts=True) for x in flat if len(x) >= 2 << k)
        parts.append([(at, n.astype(np.float32), True) for at, n in cut])
    lengths, clean, noise = [], [], []
    for part in parts:
        lengths += [n.sum() for _, n, _ in part]
        for move, out in ((None, clean), (moved, noise)):
            out += (unit_vectors(_dense(part, move), idf) @ own.T).max(1).tolist()
    return own, least_cosines(np.array(lengths), np.array(clean), np.array(noise))


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """train: doc_id, text, lang (not null). idf over all rows; centroids on sample_rows documents at
    most, the same number for each language (one at least), those with the least hashes of their doc_id. A quarter
    of those is kept out of the centroids and gives the least accepted cosines. Of rows that share doc_id
    and lang the one with the least text hash is taken; null doc_ids count for the idf only."""
    per_lang = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # one row per language
    frequency = document_frequencies(train)
    idf = np.log((1 + sum(per_lang.values())) / (1 + frequency)).astype(np.float32) + 1
    quota = max(1, sample_rows // max(len(per_lang), 1))
    by_lang: dict[str, list] = {lang: [] for lang in sorted(per_lang)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in ngram_counts(batches):
            at = [np.flatnonzero(row) for row in counts]
            arrays = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "lang", "h", "at")]
            arrays += [pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([row[a] for row, a in zip(counts, at, strict=True)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "h", "at", "places", "n"])

    if per_lang:
        picked = F.broadcast(least_hashed(train, "doc_id", "lang", quota))  # quota bounds it
        kind = train.schema["doc_id"].dataType.simpleString()
        matched = tagged(train.select("doc_id", "text", "lang").join(picked, ["doc_id", "lang"]))
        every = stored(matched.mapInArrow(sparse, f"doc_id {kind}, lang string, h long, at long, places array<int>, n array<float>"))
        found = one_row_each(every, ["doc_id", "lang"]).select("lang", F.xxhash64("h", "doc_id").alias("order"), "places", "n").toLocalIterator()  # a partition at a time
        for row in found:
            by_lang[row["lang"]].append((np.array(row["places"], np.uint16), np.array(row["n"], np.float32), row["order"] % 4 == 3, row["order"]))
    centres, langs, least = [], [], []
    for lang, rows in by_lang.items():
        rows = [r[:3] for r in sorted(rows, key=lambda r: r[3]) if len(r[0])]
        if not rows:
            continue
        own, bounds = fit_language(rows, idf)
        centres.append(own)
        langs += [lang] * len(own)
        least += [bounds] * len(own)
    release_memory()
    return Model(idf, np.concatenate(centres) if centres else np.zeros((0, BUCKETS), np.float32), langs, np.array(least).reshape(-1, LENGTHS))


def identify(docs: DataFrame, model: Model, carry: list[str], prefix: str = "") -> DataFrame:
    """The columns of `carry`, lang_pred, score and rejected (after `prefix`) for every row of docs.

    lang_pred is the language of the centroid with the highest cosine, score that cosine; rows
    with a cosine below the centroid's least for their length are rejected (too far from all that was learned;
    texts of fewer than three bytes have no trigram and can't be far).
    Null texts and texts without a letter: `und`, 0, rejected. So is every text if no language
    was learned. Ties go to the first language by name. Very long texts are counted whole, as a run of their
    own. Repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS x BUCKETS numbers a language

    lower, has_letters = (free_name(c, carry) for c in ("__lower", "__letters"))
    names = [*carry, f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = np.array([*m.langs, UNKNOWN], object)
        for part, counts in ngram_counts(batches, lower):
            letters = part.column(part.schema.get_field_index(has_letters)).to_numpy(zero_copy_only=False).astype(bool)
            if len(m.centres):
                length = counts.sum(1)
                some, klass = length > 0, length_class(length)
                near = unit_vectors(counts, m.idf) @ m.centres.T
                best = near.argmax(1)
                score = np.clip(near.max(1), 0, 1).astype(np.float64)
                rejected = ~letters | (score < m.least[best, klass]) & some
            else:
                best, score, rejected = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.ones(part.num_rows, bool)
            known = letters & bool(len(m.centres))
            arrays = [part.column(part.schema.get_field_index(c)) for c in carry]
            arrays += [pa.array(np.where(known, langs[best], UNKNOWN), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    letters = F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False))
    fed = docs.select(*carry, F.lower("text").alias(lower), letters.alias(has_letters))
    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return fed.mapInArrow(run, f"{head}, {prefix}lang_pred string, {prefix}score double, {prefix}rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs.

    Learns from text and lang of the rows with a lang whose fold (crc32 of doc_id, of 4) is not
    2; held_out marks fold 2. Null doc_ids: not held out and not learned from. See identify()
    for texts without letters. Other columns are ignored, whatever their names. Empty input: no rows.
    """
    fold = crc_fold(F.col("doc_id"), 4)
    lowered = F.lower("text").alias("text")
    model = fit(docs.filter((fold != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", lowered, "lang"))
    return identify(docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out")), model, ["doc_id", "held_out"])
