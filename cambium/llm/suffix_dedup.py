"""Removal of repeated byte strings by column-wise suffix sorting of text windows.

Every string of LENGTH bytes belongs to anchors: the positions with the least hash of GRAM
bytes among those that begin in it. Equal strings have equal anchors at equal places, so
windows around equal anchors meet in one bucket, and a match of LENGTH bytes is never missed.
A bucket's windows are aligned at their anchors and their collection's order, Burrows-Wheeler
column and common prefixes are built from the right, one symbol of each window a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import U64, mix64, release_memory, spread, text_bytes, text_slices, window_hashes
from .repeats import in_order, sliced, with_levels

LENGTH = 50
GRAM = 25
STARTS = LENGTH - GRAM + 1  # strings that can begin at or before an anchor
WIDTH = STARTS - 1 + LENGTH  # bytes of a full window
SPAN_BITS = 31


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors, and for every position the least hash of the string
    that begins there (0 where it would leave its document)."""
    hashes = window_hashes(data, GRAM)
    m = len(data) - LENGTH + 1
    if m <= 0:
        e = np.zeros(0, U64)
        return np.zeros(0, np.int64), e, e
    hashes |= U64(1)
    least = _sliding(hashes, STARTS, np.minimum)
    step = np.zeros(m + 1, np.int32)
    np.add.at(step, np.clip(offsets[1:] - LENGTH + 1, offsets[:-1], m), 1)
    np.add.at(step, np.minimum(offsets[1:], m), -1)
    least[np.cumsum(step[:-1]) > 0] = 0
    edge = np.zeros(STARTS - 1, U64)
    most = _sliding(np.concatenate((edge, least, edge)), STARTS, np.maximum)
    at = np.flatnonzero(hashes == most)
    return at, hashes[at], least


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = least(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return least(x[: len(x) - rest], x[rest:]) if rest else x.copy()


def _merged(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans with the same key."""
    if not len(key):
        return key, start, stop
    order = np.lexsort((start, key))
    key, start, stop = key[order], start[order], stop[order]
    base = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) << (SPAN_BITS + 1)
    reach = np.maximum.accumulate(base + stop)
    first = np.flatnonzero(np.concatenate(([True], base[1:] + start[1:] > reach[:-1])))
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], reach[last] - base[last]


def column_groups(windows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Insert the columns of equally long windows from the right, one symbol of each a round.

    After the round of a column that LENGTH symbols follow, yields the column, the windows in
    the order of their suffixes from there and each one's common prefix with the one before.
    The symbols before the ordered suffixes are the collection's Burrows-Wheeler column; sorting
    it stably (counting sort on bytes) gives the next order, and the new common prefixes are one
    more than the least of the old ones in between, or 0 where the symbols differ.
    """
    n, width = windows.shape
    order = np.arange(n)
    common = np.zeros(n, np.uint8)
    first_round = True
    columns = np.ascontiguousarray(windows.T)
    for column in range(width - 1, -1, -1):
        bwt = columns[column][order]
        move = np.argsort(bwt, kind="stable")
        symbol = bwt[move]
        same = np.concatenate(([False], symbol[1:] == symbol[:-1]))
        if first_round:
            least = np.zeros(n, np.uint8)  # of empty suffixes
            first_round = False
        else:
            least = _least_between(common, move)
        common = np.where(same, np.minimum(least, 254) + 1, 0).astype(np.uint8)
        order = order[move]
        if column + LENGTH <= width:
            yield column, order, common


def _least_between(common: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For each r: the least of common[move[r-1]+1 .. move[r]] (where that is a range)."""
    n = len(common)
    levels = [common]
    while 2 << (len(levels) - 1) <= n:
        half = 1 << (len(levels) - 1)
        x = levels[-1].copy()
        x[: n - half] = np.minimum(x[: n - half], x[half:])
        levels.append(x)
    table = np.concatenate(levels)
    lo = np.concatenate(([0], move[:-1] + 1))
    size = np.maximum(move - lo + 1, 1)
    level = np.frexp(size.astype(np.float64))[1] - 1
    lo = np.minimum(lo, n - 1)
    return np.minimum(table[level * n + lo], table[level * n + np.maximum(move - (1 << level) + 1, 0)])


def repeated_starts(windows: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """windows x STARTS: whether the string there is the window's own and begins in a window of a smaller doc."""
    out = np.zeros((len(windows), STARTS), bool)
    for column, order, common in column_groups(windows):
        if column >= STARTS:
            continue
        own = (low[order] <= column) & (column <= high[order])
        fresh = common < LENGTH
        group = np.cumsum(fresh) - 1
        who, of = order[own], group[own]
        if not len(who):
            continue
        cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        least = np.minimum.reduceat(doc[who], cut)
        out[who, column] = doc[who] > np.repeat(least, np.diff(np.append(cut, len(who))))
    return out


_ZSTD = pa.Codec("zstd", compression_level=3)


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Length and compressed length of each array, then the compressed arrays: like compresses best with like."""
    raw = [np.ascontiguousarray(a) for a in arrays]
    parts = [_ZSTD.compress(a.tobytes(), asbytes=True) if a.size else b"" for a in raw]
    return np.array([x for a, p in zip(raw, parts, strict=True) for x in (a.nbytes, len(p))], "<i8").tobytes() + b"".join(parts)


def _unpacked(blob: bytes, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    head, at, out = np.frombuffer(blob, "<i8", 2 * len(kinds)).tolist(), 16 * len(kinds), []
    for (kind, width), size, packed in zip(kinds, head[::2], head[1::2], strict=True):
        raw = _ZSTD.decompress(blob[at : at + packed], size) if size else b""
        flat = np.frombuffer(raw, kind)
        out.append(flat.reshape(-1, width) if width > 1 else flat)
        at += packed
    return out


#: Of windows: doc, number of runs, first and last own start, bytes; of their runs: row in the slice, first anchor position,
#: length; of settled spans: row, start, stop.
KINDS = [(np.int64, 1), (np.int32, 1), (np.uint8, 1), (np.uint8, 1), (np.uint8, WIDTH), (np.int32, 1), (np.int32, 1), (np.int32, 1), (np.int32, 1), (np.int32, 1), (np.int32, 1)]
SPANS = [(np.int32, 1), (np.int32, 1), (np.int32, 1)]
#: Occurrences from which an anchor is hot: its strings are dealt each by itself.
HOT = 4096
#: Bytes of a long text and windows that are worked on at once.
PIECE = 4 << 20
WINDOWS_AT_ONCE = 1 << 18


def _known(table: pa.Table) -> pa.Table:
    """The rows that take part: those with a doc_id."""
    return table.filter(pc.is_valid(table.column("doc_id")))


def _anchored(table: pa.Table, piece: int = PIECE) -> Iterator[tuple]:
    """Runs of a slice's rows: (rows, bytes, offsets, anchors, hashes, least hashes, place of the run's first byte in its text).

    A long text comes in pieces, which overlap by more than an anchor can depend on; each anchor is in one piece.
    """
    edge = 2 * WIDTH
    for part, data, offsets in text_slices(iter(_known(table).to_batches())):
        if part.num_rows > 1 or len(data) <= piece:
            yield part, data, offsets, *anchors_of(data, offsets), 0
            continue
        for lo in range(0, len(data), piece):
            begin, stop = max(lo - edge, 0), min(lo + piece + edge, len(data))
            cut = np.array([0, stop - begin])
            at, hashes, least = anchors_of(data[begin:stop], cut)
            own = (at >= lo - begin) & (at < lo + piece - begin)
            yield part, data[begin:stop], cut, at[own], hashes[own], least, begin


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + counts[0] - 1, then the same of the next."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _windows(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray, hashes: np.ndarray, least: np.ndarray, hot: np.ndarray, base: int, at_once: int) -> Iterator[tuple]:
    """Windows around the anchors at `at`, with the repeats among them settled.

    Of equal windows only one of the smallest doc is sent on, with the runs of places where that doc has it; all
    strings of the others begin in that doc too. Yields the hashes that deal windows to buckets, and the fields of KINDS.

    An anchor's windows meet under its hash. Where very many documents share a passage, its anchors are hot: windows at the
    edges differ by what stands around the passage. A hot anchor's strings are windows of their own, dealt by the
    hashes of their LENGTH bytes, so that only equal strings meet, and of those one a slice.
    """
    padded = np.concatenate((np.zeros(STARTS - 1, np.uint8), data, np.zeros(LENGTH, np.uint8)))
    edge = np.zeros(STARTS - 1, U64)
    bounds = np.concatenate((edge, least, np.zeros(LENGTH, U64)))
    cold = np.flatnonzero(~hot)
    for lo in range(0, len(cold), at_once):
        own = cold[lo : lo + at_once]
        low, high = _owned(bounds, at[own], hashes[own])
        yield _settled(padded, offsets, doc, at[own], hashes[own], low, high, base)
    warm, strings = np.flatnonzero(hot), window_hashes(data, LENGTH) if hot.any() else None
    for lo in range(0, len(warm), max(1, at_once // STARTS)):
        own = warm[lo : lo + max(1, at_once // STARTS)]
        low, high = _owned(bounds, at[own], hashes[own])
        each = high.astype(np.int64) - low + 1
        column = _ranges(low.astype(np.int64), each)
        where = np.repeat(at[own], each)
        yield _settled(padded, offsets, doc, where, strings[where - (STARTS - 1) + column], column.astype(np.uint8), column.astype(np.uint8), base)


def _owned(bounds: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the strings that belong to each anchor, by their place in its window."""
    owned = np.lib.stride_tricks.sliding_window_view(bounds, STARTS)[at] == hashes[:, None]
    return owned.argmax(1).astype(np.uint8), (STARTS - 1 - owned[:, ::-1].argmax(1)).astype(np.uint8)


def _settled(padded: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> tuple:
    windows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[at]
    column = np.arange(WIDTH)
    windows = np.where((column >= low[:, None]) & (column < high[:, None].astype(np.int64) + LENGTH), windows, 0).astype(np.uint8)
    row = np.searchsorted(offsets, at, "right") - 1
    place, whose = (at - offsets[row] + base).astype(np.int32), doc[row]
    # order by content, then doc and place; equal neighbours are compared byte by byte
    words = np.zeros((len(at), 80), np.uint8)
    words[:, :WIDTH] = windows
    words[:, WIDTH], words[:, WIDTH + 1] = low, high
    content = words.view(U64)
    mixed = mix64((mix64(content) * np.arange(1, 21, 2, dtype=U64)).sum(1, dtype=U64))
    order = np.lexsort((at, whose, mixed))
    new = np.concatenate(([True], (content[order[1:]] != content[order[:-1]]).any(1)))[: len(order)]
    group = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)]
    smallest = whose[first][group]
    settled = order[whose[order] > smallest]
    sent = whose[order] == smallest
    of, sent = group[sent], order[sent]
    fresh = np.concatenate(([True], (of[1:] != of[:-1]) | (at[sent[1:]] != at[sent[:-1]] + 1) | (row[sent[1:]] != row[sent[:-1]])))[: len(sent)]
    begins = np.flatnonzero(fresh)
    length = np.diff(np.append(begins, len(sent))).astype(np.int32)
    runs = np.bincount(of[begins], minlength=len(first)).astype(np.int32)
    begin = place.astype(np.int64) - (STARTS - 1)
    row_s, start, stop = _merged(row[settled], (begin + low)[settled], (begin + high + LENGTH)[settled])
    own = [whose[first], runs, low[first], high[first], windows[first]]
    return hashes[first], own, [row[sent[begins]].astype(np.int32), place[sent[begins]], length], [x.astype(np.int32) for x in (row_s, start, stop)]


def _to_buckets(table: pa.Table, levels: np.ndarray, buckets: int, piece: int, at_once: int) -> Iterator[tuple]:
    """(bucket, slice, blob) of the windows around anchors that may occur again."""
    here, parts, seen, rows, last = table.column("slice")[0].as_py(), [], 0, 0, None
    for part, data, offsets, at, h, least, base in _anchored(table, piece):
        rows += last.num_rows if last is not None and part is not last else 0
        last = part
        level = levels[seen : seen + len(at)]
        again = level > 0
        seen += len(at)
        doc = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
        for hashes, own, runs, spans in _windows(data, offsets, doc, at[again], h[again], least, level[again] > 1, base, at_once):
            runs[0] += np.int32(rows)
            spans[0] += np.int32(rows)
            parts.append((hashes, own, runs, spans))
    if not parts:
        return
    joined = lambda k: [np.concatenate(x) for x in zip(*(p[k] for p in parts), strict=True)]
    hashes, fields, runs, spans = np.concatenate([p[0] for p in parts]), joined(1), joined(2), joined(3)
    begins = np.cumsum(fields[1]) - fields[1]
    bucket = (mix64(hashes ^ U64(0x5851F42D4C957F2D)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    mine = here % buckets  # settled spans go along with any bucket
    for b in np.union1d(bucket, [mine] if len(spans[0]) else []).astype(int).tolist():
        own = order[cuts[b] : cuts[b + 1]]
        of_own = _ranges(begins[own], fields[1][own])
        yield b, here, _packed([*(x[own] for x in fields), *(x[of_own] for x in runs), *(spans if b == mine else [x[:0] for x in spans])])


def _match(table: pa.Table) -> pa.Table:
    """Spans to remove, by slice, from all windows of a bucket."""
    ids = table.column("slice").to_pylist()
    parts = [_unpacked(blob, KINDS) for blob in table.column("blob").to_pylist()]
    of = np.concatenate([np.full(len(p[5]), i, np.int64) for i, p in zip(ids, parts, strict=True)])
    of_settled = np.concatenate([np.full(len(p[8]), i, np.int64) for i, p in zip(ids, parts, strict=True)])
    doc, runs, low, high, windows, row, place, length, *settled = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    hit = np.zeros((len(doc), STARTS + 2), np.int8)
    if len(doc):
        hit[:, 1:-1] = repeated_starts(windows, low, high, doc)
    turn = np.diff(hit, axis=1)
    who, first = np.nonzero(turn == 1)
    last = np.nonzero(turn == -1)[1] - 1
    # each turn of a window for each of its runs
    run = _ranges((np.cumsum(runs) - runs)[who], runs[who])
    first, last = np.repeat(first, runs[who]), np.repeat(last, runs[who])
    begin = place[run].astype(np.int64) - (STARTS - 1)
    key = np.concatenate((of[run] << 32 | row[run], of_settled << 32 | settled[0]))
    start, stop = np.concatenate((begin + first, settled[1])), np.concatenate((begin + length[run] - 1 + last + LENGTH, settled[2]))
    key, start, stop = _merged(key, start, stop)
    where = key >> 32
    cuts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))[: len(key)].tolist()
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=False):
        out.append((int(where[lo]), _packed([x[lo:hi].astype(np.int32) for x in (key & 0xFFFFFFFF, start, stop)])))
    del windows, hit, turn
    release_memory()
    columns = list(zip(*out, strict=True)) or [[], []]
    return pa.table({"slice": pa.array(columns[0], pa.int32()), "blob": pa.array(columns[1], pa.binary())})


def _cut(table: pa.Table, spans: pa.Table) -> pa.Table:
    """The result rows of a slice."""
    table = in_order(table)
    valid = np.flatnonzero(pc.is_valid(table.column("doc_id")).to_numpy(zero_copy_only=False))
    parts = [_unpacked(blob, SPANS) for blob in spans.column("blob").to_pylist()]
    row, start, stop = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    row, start, stop = _merged(valid[row], start, stop)
    out, done = [], 0
    for part, data, offsets in text_slices(iter(table.to_batches())):
        own = slice(*np.searchsorted(row, (done, done + part.num_rows)))
        base = offsets[row[own] - done]
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, base + start[own], 1)
        np.add.at(step, base + stop[own], -1)
        kept = np.cumsum(step[:-1], dtype=np.int32) == 0
        runs = np.bincount(row[own] - done, minlength=part.num_rows)
        for i in range(part.num_rows):
            body = data[offsets[i] : offsets[i + 1]]
            if runs[i]:
                body = body[kept[offsets[i] : offsets[i + 1]]]
            size = int(offsets[i + 1] - offsets[i])
            out.append((size, size - len(body), int(runs[i]), hashlib.sha256(body.tobytes()).hexdigest()))
        done += part.num_rows
    columns = list(zip(*out, strict=True)) or [[]] * 4
    counts = {name: pa.array(c, pa.int64()) for name, c in zip(("n_bytes", "n_removed", "n_spans"), columns, strict=False)}
    return pa.table({"doc_id": table.column("doc_id"), **counts, "kept_sha256": pa.array(columns[3], pa.string())})


def suffix_dedup(docs: DataFrame, piece: int = PIECE, at_once: int = WINDOWS_AT_ONCE, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Removes each byte that a string of LENGTH bytes covers which also begins in a document with
    a smaller doc_id; matches never cross documents and are judged on the input. Documents are
    dealt to slices by one shuffle, which three steps share: counting the anchors, sending the
    windows of anchors that may occur again (compressed, and with the repeats inside a slice
    settled; those of anchors that occur `hot` times string by string) to their buckets, and cutting out the spans that the buckets reply.

    Null texts are empty. Rows without doc_id are neither smaller nor larger than others:
    nothing is removed from them. Rows that share a doc_id, and repeated rows, don't remove from each other. Very
    long texts are worked on in pieces that overlap; a run of one letter is one window with a run of places. Other
    columns are ignored, whatever their names. Empty input: no rows.
    """
    total = text_bytes(docs)
    texts, buckets = sliced(docs, total), spread(total, 8 << 20)

    def draw(table: pa.Table) -> np.ndarray:
        found = [mix64(hashes) for *_, hashes, _, _ in _anchored(table, piece)]
        return np.concatenate(found) if found else np.zeros(0, U64)

    fields = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("blob", pa.binary())])
    sent = with_levels(texts, draw, lambda t, levels: _to_buckets(t, levels, buckets, piece, at_once), fields, "bucket int, slice int, blob binary", total * 2 // (STARTS + 1), (2, hot))
    spans = sent.groupBy("bucket").applyInArrow(_match, "slice int, blob binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.groupBy("slice").cogroup(spans.groupBy("slice")).applyInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: Every string of LENGTH bytes as hexadecimal text; spans of hits that touch are one.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, i * 2 + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - {LENGTH - 1})) AS i FROM d WHERE length(x) >= {2 * LENGTH})),
h AS (SELECT doc_id, i FROM w JOIN (SELECT s, min(doc_id) AS first FROM w GROUP BY s) USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS nr FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM h)),
spans AS (SELECT doc_id, min(i) AS start, max(i) + {LENGTH} AS stop FROM g GROUP BY doc_id, nr),
pieces AS (
  SELECT doc_id, start, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS from_, start AS to_ FROM spans
  UNION ALL SELECT doc_id, 1::BIGINT << 40, max(stop), max(stop) + 1000000000 FROM spans GROUP BY doc_id
), kept AS (SELECT doc_id, string_agg(substr(x, from_ * 2 + 1, (to_ - from_) * 2), '' ORDER BY start) AS x FROM pieces JOIN d USING (doc_id) GROUP BY doc_id),
sizes AS (SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
