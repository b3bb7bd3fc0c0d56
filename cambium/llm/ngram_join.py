"""Jaccard join of word shingle sets by prefix trees.

Sets are ordered by one global order, rare shingles first. Linked sets share so many shingles of their
prefixes, so documents that do are brought together and each group is joined in a trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, U64, mix64, spread, stored, text_bytes, text_slices, word_bounds, word_hashes
from .components import components
from .exact_dedup import BITMAP_BITS, bloom_filter, with_maybe
from .repeats import sliced, with_levels

WORDS = 4
PERCENT = 85
#: Sets that one task joins; larger groups are cut into pairs of blocks.
BLOCK_SETS = 1024
#: A prefix shingle that more classes have is hot: it ties them all to one, instead of each two of them.
HOT = 64
#: Bits of the Bloom filter of the texts that are joined; with more of them it lets more of the others through.
MOST_BITS = 1 << 28
_FACTORS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """62-bit hashes of the distinct shingles of each document, sorted within it, and their offsets."""
    starts, ends, doc = word_bounds(~SPACE[data], offsets)
    h = word_hashes(LOWER[data], starts, ends)
    n = len(offsets) - 1
    if len(h) >= WORDS:
        runs = len(h) - WORDS + 1
        made = mix64(sum(h[k : k + runs] * _FACTORS[k] for k in range(WORDS)))
        inside = doc[:runs] == doc[WORDS - 1 :]
        made, owner = made[inside], doc[:runs][inside]
    else:
        made, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    words = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(words)))
    few = np.flatnonzero((words > 0) & (words < WORDS))
    if len(few):
        whole = np.array([mix64((h[first[d] : first[d + 1]] * _FACTORS[: words[d]]).sum(dtype=U64, keepdims=True) ^ U64(words[d]))[0] for d in few], U64)
        made, owner = np.concatenate((made, whole)), np.concatenate((owner, few))
        order = np.argsort(owner, kind="stable")
        made, owner = made[order], owner[order]
    made >>= U64(2)
    cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        made[lo:hi].sort()
    new = np.concatenate(([True], (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])))[: len(made)]
    return made[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=n))))


def least_shared(n: int | Column) -> int | Column:
    """How many shingles of their prefixes linked sets of n shingles or more share at least; prefixes are as long as that takes."""
    return 1 + (F.floor(n / 16) if isinstance(n, Column) else n // 16)


def least_overlap(a: int | np.ndarray, b: int | np.ndarray) -> int | np.ndarray:
    """Smallest intersection with 100 * intersection >= PERCENT * union."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


PROFILE = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("entries", pa.list_(pa.int64()))])


def _drawn(table: pa.Table) -> np.ndarray:
    found = [shingles(data, offsets)[0] << U64(2) for _, data, offsets in text_slices(iter(table.to_batches()))]
    return np.concatenate(found) if found else np.zeros(0, U64)


def _profiles(table: pa.Table, levels: np.ndarray) -> Iterator[tuple]:
    """Per row: doc_id, h, n, the set's key, and the repeated tokens of its prefix.

    A token is the shingle's hash below its level, so tokens sort rare first.
    """
    seen = 0
    for part, data, offsets in text_slices(iter(table.to_batches())):
        sets, cuts = shingles(data, offsets)
        tokens = sets | levels[seen : seen + len(sets)].astype(U64) << U64(62)
        seen += len(sets)
        sums = [np.concatenate((np.zeros(1, U64), np.cumsum(mix64(sets ^ U64(seed))))) for seed in (0, 0x5BF03635)]
        k1, k2 = ((s[cuts[1:]] - s[cuts[:-1]]).view(np.int64).tolist() for s in sums)
        ids, hashed = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "h"))
        for i, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            own = np.sort(tokens[lo:hi])
            n = hi - lo
            prefix = own[: n - (PERCENT * n + 99) // 100 + least_shared(n)] if n else own
            yield ids[i], hashed[i], n, k1[i], k2[i], prefix[prefix >= U64(1 << 62)].view(np.int64)


class Trie:
    """Sets in lexicographic order; each shares the start of its path with an earlier one.

    Set j leaves the path of its parent, the nearest earlier set that shares less with its own
    predecessor, at depth shared[j]; what follows is its tail. So every edge is stored once.
    Tails lie level by level, one after the other.
    """

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        paths = [sets[i] for i in order]
        m = len(paths)
        shared, parent, level, stack = np.zeros(m, np.int64), np.full(m, -1), np.zeros(m, np.int64), [0]
        for j in range(1, m):
            a, b = paths[j - 1], paths[j]
            k = min(len(a), len(b))
            differ = a[:k] != b[:k]
            shared[j] = int(differ.argmax()) if differ.any() else k
            if not shared[j]:
                stack = []
            while stack and shared[stack[-1]] >= shared[j]:
                stack.pop()
            if stack:
                parent[j] = stack[-1]
                level[j] = level[stack[-1]] + 1
            stack.append(j)
        by_level = np.argsort(level, kind="stable")
        place = np.empty(m, np.int64)
        place[by_level] = np.arange(m)
        self.order = np.array(order)[by_level]
        self.size = np.array([len(paths[j]) for j in by_level])
        self.shared, parent = shared[by_level], parent[by_level]
        self.parent = np.where(parent >= 0, place[parent], -1)
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(level))))
        self.begin = np.concatenate(([0], np.cumsum(self.size - self.shared)))
        self.flat = np.concatenate([paths[j][shared[j] :] for j in by_level])
        up = np.maximum(self.parent, 0)
        self.leaves_at = self.begin[up] + self.shared - self.shared[up]  # where a set leaves its parent's tail

    def overlaps(self, member: np.ndarray, most_misses: int) -> np.ndarray:
        """Intersection size of every set with the query (member: by token), or -1 in pruned subtrees.

        What a set shares with its parent is counted once, in the parent's tail. A subtree whose
        shared path already has more tokens outside the query than the remaining length allows
        is pruned, and levels without any other node aren't read.
        """
        m = len(self.size)
        total, before = np.full(m, -1), np.zeros(m, np.int64)
        hits, start = np.zeros(1, np.int32), 0  # hits[i]: in the flat tokens start .. start + i of the level above
        for lo, hi in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            nodes = np.arange(lo, hi)
            if lo:
                up = self.parent[lo:hi]
                before[lo:hi] = before[up] + hits[self.leaves_at[lo:hi] - start] - hits[self.begin[up] - start]
                alive = (total[up] >= 0) & (self.shared[lo:hi] - before[lo:hi] <= most_misses)
                nodes = nodes[alive]
                if not len(nodes):
                    break
            start, stop = self.begin[lo], self.begin[hi]
            hits = np.zeros(stop - start + 1, np.int32)
            np.cumsum(member[self.flat[start:stop]], out=hits[1:])
            total[nodes] = before[nodes] + hits[self.begin[nodes + 1] - start] - hits[self.begin[nodes] - start]
        return total


def trie_links(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of indices whose links connect the same sets as all links do.

    Linked sets differ in size by a factor of 100 / PERCENT at most, so the sets of each size
    class are looked up in the trie of their class and of the next. What is already connected
    isn't looked up again. side: a label of each set; with two labels, only links across them
    are of interest.
    """
    m, out = len(sets), []
    sizes = np.array([len(s) for s in sets])
    label = np.arange(m)
    klass = np.floor(np.log(sizes) / np.log(1.0001 * 100 / PERCENT)).astype(int)
    sides = [None] if side is None or len(np.unique(side)) < 2 else np.unique(side).tolist()
    for k in np.unique(klass).tolist():
        for one in sides:
            ask = np.flatnonzero((klass == k) & (True if one is None else side == one))
            found = np.flatnonzero(((klass == k) | (klass == k + 1)) & (True if one is None else side != one))
            if len(ask) and len(found) > (one is None):
                _look_up(sets, ask, found, label, out)
    return out


def _look_up(sets: list[np.ndarray], ask: np.ndarray, found: np.ndarray, label: np.ndarray, out: list) -> None:
    """Adds to out the links between ask and found that connect labels, and joins those."""
    every = np.union1d(ask, found)
    if len(np.unique(label[every])) == 1:
        return
    sizes = np.array([len(sets[i]) for i in every])
    values, inverse, counts = np.unique(np.concatenate([sets[i] for i in every]), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))  # shared tokens first: long shared paths
    ranked = dict(zip(every.tolist(), (np.sort(x) for x in np.split(rank[inverse.ravel()], np.cumsum(sizes)[:-1])), strict=True))
    trie = Trie([ranked[i] for i in found.tolist()])
    stored_as = found[trie.order]
    member = np.zeros(len(values), np.uint8)
    for q in ask.tolist():
        if (label[found] == label[q]).all():
            continue
        own = ranked[q]
        n = len(own)
        longest = 100 * n // PERCENT
        member[own] = 1
        shared = trie.overlaps(member, longest - int(least_overlap(n, longest)) + 1)
        member[own] = 0
        linked = stored_as[(shared >= 0) & (100 * shared >= PERCENT * (n + trie.size - shared))]
        for i in linked.tolist():
            if label[i] != label[q]:
                label[label == label[i]] = label[q]
                out.append((q, i))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _joined(table: pa.Table) -> pa.Table:
    """Links of the groups (cluster, i, j) in one task's rows, whose sets are made of their texts."""
    a, b = [], []
    table = table.sort_by([(c, "ascending") for c in ("cluster", "i", "j", "rep", "h")]).combine_chunks()
    keys = np.stack([table.column(c).to_numpy() for c in ("cluster", "i", "j")], 1)
    cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    ids, blocks = table.column("rep").to_numpy(), table.column("block").to_numpy()
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(table)], strict=True):
        if hi - lo > 1:
            sets = []
            for _, data, offsets in text_slices(iter(table.slice(lo, hi - lo).to_batches())):
                made, bounds = shingles(data, offsets)
                sets += np.split(made, bounds[1:-1])
            for x, y in trie_links(sets, blocks[lo:hi]):
                a.append(ids[lo + x])
                b.append(ids[lo + y])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the h of classes (h, n, entries) that connect all linked ones, and few others.

    Of least_shared(n) common prefix shingles a half, or more of the sizes differ, are hot, or the others aren't. Classes that share so many
    that aren't hot are found by pairs, of which a shingle has HOT * HOT / 2 at most. Those that share so many hot ones share one of the
    hot ones that are left without the last of them (less one), and only these tie classes to stars. One shingle alone connects short sets only:
    in a large corpus chance repeats of single shingles would connect nearly all.
    """
    entries = classes.select("h", "n", F.explode("entries").alias("token"))
    often = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = stored(entries.join(often.hint("merge"), "token"))
    half = lambda n: F.floor((least_shared(n) + 1) / 2)
    few = shared.filter(F.col("m") <= HOT)
    one, two = (few.select("token", F.col("h").alias(end), F.col("n").alias(f"n_{end}")) for end in "ab")
    less, more = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    pairs = one.join(two.hint("merge"), "token").filter((F.col("a") < F.col("b")) & (100 * less >= PERCENT * more)).groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("s"))
    pairs = pairs.filter(F.col("s") >= F.greatest(F.lit(1), least_shared(less) - half(more) + 1)).select("a", "b")
    hot = shared.filter(F.col("m") > HOT).groupBy("h", "n").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    kept = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), F.size("tokens") - half(F.col("n")) + 1).cast("int"))
    kept = hot.select("h", F.explode(kept).alias("token"))
    stars = stored(kept.groupBy("token").agg(F.min("h").alias("a")))
    return pairs.unionByName(kept.join(stars.hint("merge"), "token").select("a", F.col("h").alias("b")))


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Sets are the distinct shingles of WORDS words; a text of fewer words is one shingle, one
    without words has none and links with nothing. Two documents link if 100 * intersection >=
    PERCENT * union; component_id is the smallest doc_id reachable by links.

    1. Count how often shingles occur (a table of bounded size); the global order is by that
       level, then by hash. 2. Per document its prefix, in which linked sets share least_shared(n) shingles;
       shingles that occur once are left out, so a document without near copies sends nothing.
       Equal sets become one class. 3. Classes that share enough prefix shingles are clustered, by numbers
       only. 4. The texts of clustered classes, one each, are read again. Each cluster is joined in a prefix tree, small ones
       together; one of more than BLOCK_SETS sets is cut into blocks, and every pair of blocks
       is a task of its own. 5. Components of the links. Tables that grow with the documents are joined by shuffle,
       never by broadcast, which would pass them through the driver.

    Shingles are compared by 62-bit hashes. Null and empty texts: no shingles, a component of
    their own. Rows that share a doc_id, and repeated rows, count as one document of several texts; a row without
    doc_id takes no part and has no component. Very long texts are read whole, as a run of their own, and their
    sets meet only sets of about their size. Other columns are ignored, whatever their names. Empty input: no rows.
    """
    total = text_bytes(docs)
    kinds = "doc_id long, h long, n long, k1 long, k2 long, entries array<long>"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = lambda df: df.withColumn("h", F.xxhash64("doc_id", "text"))
    rows = stored(with_levels(told(sliced(own, total)), _drawn, _profiles, PROFILE, kinds, total // 6))
    key = ["k1", "k2", "n"]
    classes = stored(
        rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("entries").alias("entries"))
        .select(*key, F.col("least.doc_id").alias("rep"), F.col("least.h").alias("h"), "entries")
    )
    clusters = components(candidates(classes.select("h", "n", "entries")))
    blocks = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    placed = clusters.join(blocks.hint("merge"), "component").select(
        F.col("node").alias("h"), F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    )
    # of all texts only one of each class that shares a cluster moves again: the others are kept back by a filter where they are read
    wanted = stored(classes.select("rep", "h").join(placed.hint("merge"), "h"))
    bits = min(MOST_BITS, max(BITMAP_BITS, 16 * wanted.count()))
    near = with_maybe(told(own.filter("doc_id IS NOT NULL")), bloom_filter(wanted.select("h"), bits), bits).filter("maybe")
    near = near.select("h", F.col("doc_id").alias("rep"), "text").join(wanted.hint("merge"), ["h", "rep"]).dropDuplicates(["h", "rep"])
    keyed = near.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", "h", "text", "cluster", "block", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    parts = spread(total, 16 << 20)
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(parts))).otherwise(F.xxhash64("cluster", "i", "j"))
    links = keyed.withColumn("task", task).drop("blocks").groupBy("task").applyInArrow(_joined, "a long, b long")
    # a doc_id of several texts ties their classes together
    owned = rows.filter("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("owner"), *key).join(classes.select(*key, "rep").hint("merge"), key).select("owner", "rep")
    ties = stored(owned.groupBy("owner").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("owner", "a"))
    links = links.unionByName(owned.join(ties.hint("merge"), "owner").select("a", F.col("rep").alias("b")))
    found = components(links).select(F.col("node").alias("rep"), "component")
    known = classes.select(*key, "rep").join(found.hint("merge"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", *key).join(stored(known).hint("merge"), key, "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).cast(kind).alias("component_id"),
    )


ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {WORDS - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= {PERCENT} * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
