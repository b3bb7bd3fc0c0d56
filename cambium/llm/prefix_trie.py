"""The prefix tree of conversations, found by binary searches against the minima of prefix digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, stored

#: Turns of a conversation that one window adds up; longer conversations are cut into blocks of so many.
BLOCK = 256
#: Ids of neighbouring numbers that are joined into one text before a node's ids are hashed in their order.
PIECE = 256
#: Words of 32 bits of a turn's hash; their sums over a prefix are its digest.
LIMBS = 4


def numbered(turns: DataFrame, rows_per_part: int = 1_000_000) -> DataFrame:
    """conv_id, pos, sha, size of every turn: its place in its conversation from 1, the SHA-256 of role and text, the text's bytes; stored.

    In order of turn (null first); turns of one number by role and then by that hash. Texts are hashed where they are and
    don't move. Rows are range partitioned by conversation and order, so a long conversation is cut too: rows count within
    a part, and the parts that go on with a conversation (one a part at most) add what lies before them.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    known = turns.filter("conv_id IS NOT NULL")
    rows = stored(known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), sha.alias("sha"), F.octet_length(text).cast("long").alias("size")))
    parts = max(12, -(-rows.count() // rows_per_part))
    placed = stored(rows.repartitionByRange(parts, "conv_id", "turn", "role", "sha").withColumn("part", F.spark_partition_id()))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", before).filter("before IS NOT NULL").select("conv_id", "part", "before")
    nr = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("turn", "role", "sha"))
    counted = placed.withColumn("nr", nr).join(F.broadcast(offsets), ["conv_id", "part"], "left")  # a row a part at most
    return stored(counted.select("conv_id", (F.col("nr") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "sha", "size"))


def rebuilt(turns: DataFrame, siblings: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, depth, sha, size) of their rebuilt turns; both stored.

    Conversation c takes the first h turns of c - c % siblings, h = crc32(c) % heads, in place of its own first h. At most
    `siblings` conversations share a head of less than `heads` turns, so the join by it is bounded.
    """
    own = numbered(turns)
    lengths = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    wanted = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % siblings).alias("base"), crc_fold(F.col("conv_id"), heads).alias("h"))
    convs = stored(wanted.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    head = own.filter(F.col("pos") < heads).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "sha", "size")
    first = convs.join(head, "base").filter("depth <= taken").select("conv_id", "depth", "sha", "size")
    rest = own.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "sha", "size")
    return convs.select("conv_id"), stored(first.unionByName(rest))


def running(df: DataFrame, sums: list[str], down: bool = False) -> DataFrame:
    """df (conv_id, depth, ..) with each of `sums` added up along its conversation to its row, from the first depth or (down) from the last.

    Within blocks of BLOCK depths by a window; over a conversation's blocks by another, of a row a block.
    """
    block = F.expr(f"depth div {BLOCK}")
    blocks = df.groupBy("conv_id", block.alias("block")).agg(*(F.sum(c).alias(c) for c in sums))
    order = F.desc if down else F.asc
    past = Window.partitionBy("conv_id").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("conv_id", "block", *(F.sum(c).over(past).alias(f"before_{c}") for c in sums)).filter(f"before_{sums[0]} IS NOT NULL")
    own = Window.partitionBy("conv_id", "block").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumn("block", block).withColumns({c: F.sum(c).over(own) for c in sums})
    both = inner.join(before, ["conv_id", "block"], "left")
    return both.select(*(F.col(c) + F.coalesce(f"before_{c}", F.lit(0)) if c in sums else F.col(c) for c in df.columns)).toDF(*df.columns)


def _digest(limbs: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *limbs).cast("binary")))


def prefixes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, size of every prefix of every conversation, the empty one (depth 0) included; stored.

    A prefix's digest is made of the sums of its turns' hashes, each mixed with its depth: sums need no
    order, so that a long conversation is cut into blocks.
    """
    mixed = F.sha2(F.concat(F.concat(F.col("depth").cast("string"), F.lit(":")).cast("binary"), F.col("sha")), 256)
    limbs = [f"limb{k}" for k in range(LIMBS)]
    split = turns.withColumn("mixed", mixed).select("conv_id", "depth", "size", *(F.conv(F.substring("mixed", 8 * k + 1, 8), 16, 10).cast("long").alias(c) for k, c in enumerate(limbs)))
    full = running(split, limbs).select("conv_id", "depth", _digest([F.col(c) for c in limbs]).alias("digest"), "size")
    root = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), _digest([F.lit(0)] * LIMBS).alias("digest"), F.lit(0).cast("long").alias("size"))
    return stored(full.unionByName(root))


def first_owned(ends: DataFrame, known: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """conv_id, n, lo: each conversation's least depth whose node has no smaller member, n + 1 if there is none; stored.

    What a conversation owns at one depth it owns below it as well, so every round halves all conversations' ranges in one
    join: the digest of the middle by conversation and depth, then whether that pair of digest and conversation is
    among the minima. Both are keys that no shared prefix makes hot.
    """
    state = stored(ends.select("conv_id", "n", F.lit(0).cast("long").alias("lo"), (F.col("n") + 1).alias("hi")))
    minima = nodes.select("digest", "conv_id", F.lit(True).alias("owned"))
    at = known.select("conv_id", "depth", "digest")
    for _ in range((longest + 1).bit_length()):
        middle = state.filter("lo < hi").withColumn("depth", F.expr("(lo + hi) div 2"))
        found = middle.join(at, ["conv_id", "depth"]).join(minima, ["digest", "conv_id"], "left")
        owned = F.col("owned").isNotNull()
        halved = found.select("conv_id", "n", F.when(owned, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owned, F.col("depth")).otherwise(F.col("hi")).alias("hi"))
        state = stored(halved, state.filter("lo >= hi"))
    return state.select("conv_id", "n", "lo")


def gathered(chains: DataFrame, sums: list[str]) -> DataFrame:
    """conv_id and the sums over every chain and all chains below it; chains: conv_id, up (the chain it hangs on, or null), sums.

    Bottom-up with doubling: after round k a chain has the sums of those less than 2^k below it and points 2^k up, so
    the rounds are the logarithm of the tree's height, also where each conversation goes on with the one before.
    """
    state = stored(chains)
    while not (active := state.filter("up IS NOT NULL")).isEmpty():
        given = active.groupBy(F.col("up").alias("conv_id")).agg(*(F.sum(c).alias(f"more_{c}") for c in sums))
        higher = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = active.join(higher, "up").select("conv_id", F.col("next").alias("up"), *sums)
        both = moved.unionByName(state.filter("up IS NULL")).join(given, "conv_id", "left")
        state = stored(both.select("conv_id", "up", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums)))
    return state.drop("up")


def ends_hashed(ends: DataFrame) -> DataFrame:
    """digest, ends_sha256: SHA-256 of the ascending conv_ids (decimal, comma-joined) of each digest's rows.

    Ids of one stretch of PIECE numbers are joined first, a bounded group. Pieces are sorted by Spark and hashed as a
    stream, so that no group, however large, is held by a task.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("digest", F.expr(f"floor(conv_id / {PIECE})").alias("piece")).agg(ids.alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest == now:
                    sha.update(b"," + ids.encode())
                else:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = digest, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["digest", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["digest", "ends_sha256"])

    return pieces.repartition("digest").sortWithinPartitions("digest", "piece").select("digest", "ids").mapInArrow(stream, "digest binary, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ids: conv_id of every conversation; turns: conv_id, depth (from 1 without gaps), sha (a hash of the turn) and size.
    A conversation owns a node if no smaller one is its member. Its owned depths run from the first
    one, found by binary search, to its last turn: a chain, which hangs on the owner of the node above. Chains' sums are gathered
    bottom-up, and within a chain they are added up from its end. Keys are (conversation, depth) or digests that
    were grouped before, with map-side combining; that many chains hang on one node is left to Spark's skew join.
    Conversations without turns are members of the root. No conversations: no nodes.
    """
    known = prefixes(ids, turns)
    nodes = stored(known.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("size").alias("size")))
    ends = stored(known.groupBy("conv_id").agg(F.max("depth").alias("n")))
    longest = ends.agg(F.max("n")).first()[0]
    if longest is None:
        longest = 0
    owned = first_owned(ends, known, nodes, longest).filter("lo <= n")
    tops = owned.select("conv_id", "n", "lo", (F.col("lo") - 1).alias("depth")).join(known.select("conv_id", "depth", "digest"), ["conv_id", "depth"], "left")
    hung = tops.filter("lo > 0").join(nodes.select("digest", F.col("conv_id").alias("up")), "digest").select("conv_id", "n", "lo", "up")
    chains = stored(hung, tops.filter("lo = 0").select("conv_id", "n", "lo", F.lit(None).cast("long").alias("up")))

    at = ["conv_id", "depth"]
    below = chains.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("lo") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    last = chains.select("conv_id", F.col("n").alias("depth"), F.lit(1).alias("last"))
    first = chains.select("conv_id", F.col("lo").alias("depth"), "up", F.lit(True).alias("top"))
    children = F.coalesce("hung", F.lit(0)) + 1 - F.coalesce("last", F.lit(0))
    drawn = nodes.join(last, at, "left").join(first, at, "left").join(below, at, "left")
    drawn = stored(
        drawn.select(
            *at, "digest", "n_convs", F.when(F.col("top"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            children.alias("n_children"), (children == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
        )
    )
    sums = ["n_leaves", "saved_tokens"]
    own = drawn.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in sums))
    totals = gathered(chains.select("conv_id", "up").join(own, "conv_id"), sums)
    hanging = chains.filter("up IS NOT NULL").select("conv_id", "up", F.col("lo")).join(totals, "conv_id")
    added = hanging.groupBy(F.col("up").alias("conv_id"), (F.col("lo") - 1).alias("depth")).agg(*(F.sum(c).alias(f"more_{c}") for c in sums))
    each = drawn.join(added, at, "left").select(*(F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) if c in sums else F.col(c) for c in drawn.columns)).toDF(*drawn.columns)
    hashed = ends_hashed(ends.withColumnRenamed("n", "depth").join(known, at).select("digest", "conv_id"))
    return running(stored(each), sums, down=True).join(hashed, "digest", "left").select(
        *at, "parent_conv_id", "n_convs", "n_children", *sums, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the tree of rebuilt conversations, as prefix_trie returns them; all columns but the last are long.

    Turns without conv_id belong to no conversation. Null roles and texts are empty ones. Turns of one number (null is
    one, and comes first) are in the order of role and of the SHA-256 of role and text; repeated rows are turns of
    their own. For negative conv_ids the remainder has the sign of the id, as in SQL. Very long texts are hashed whole where they are. Other
    columns are ignored, whatever their names. Empty input: no rows.
    """
    return prefix_trie(*rebuilt(conversations.select("conv_id", "turn", "role", "text")))


ORACLE_SQL = r"""
WITH crc AS (  -- the table of the reversed polynomial
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id
), c AS (
  SELECT a.conv_id, a.conv_id - a.conv_id % 5 AS base, coalesce(b.n, 0) AS base_n,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(a.conv_id::VARCHAR)), '..'), lambda p: ('0x' || p)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) % 9 AS h
  FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id - a.conv_id % 5, crc
), r AS (
  SELECT c.conv_id, pos AS depth, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT conv_id, least(h, base_n) + pos - h, role, text FROM c JOIN t USING (conv_id) WHERE pos > h
), s AS (
  SELECT c.conv_id, coalesce(q, []) AS q FROM c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY depth) AS q FROM r GROUP BY conv_id) x USING (conv_id)
), p AS (
  SELECT conv_id, len(q) AS n, depth, md5(to_json(q[1 : depth])::VARCHAR) AS k, md5(to_json(q[1 : depth - 1])::VARCHAR) AS up,
    CASE WHEN depth > 0 THEN octet_length(encode(q[depth].text)) ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, len(q) + 1)) AS depth FROM s)
), node AS (
  SELECT k, depth, any_value(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(CASE WHEN depth = n THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM p GROUP BY k, depth
), kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up
), above AS (
  SELECT p.k, sum(node.saved) AS saved_tokens, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves
  FROM node LEFT JOIN kids USING (k) JOIN p ON p.conv_id = node.conv_id AND p.depth <= node.depth GROUP BY p.k
)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN above USING (k) LEFT JOIN kids USING (k) LEFT JOIN node parent ON parent.k = node.up
"""
