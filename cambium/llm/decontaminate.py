r"""Benchmark decontamination by winnowed fingerprints, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed: what stands between words, and the letters that are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
GRAM = 5
#: Rows up to which a side is broadcast (some tens of MB); beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of words up to which items are broadcast with their words.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _checked(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted rows allow one; df is stored, so the count is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _checked_words(items: DataFrame) -> DataFrame:
    """Items with a broadcast hint if their rows and the bytes of all their words allow one."""
    rows, size = items.agg(F.count("*"), F.sum(F.octet_length(F.array_join("words", "")) + 24 * F.size("words"))).first()
    return F.broadcast(items) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else items


def _indices(n: Column, length: int) -> Column:
    """0 .. n - length, or nothing."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _gram_hashes(hashes: Column, n: Column, size: int) -> Column:
    return F.transform(_indices(n, size), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(size))))


def _with_hashes(df: DataFrame) -> DataFrame:
    """Adds words, n_words, hashes (of words) and grams (hashes of GRAM words)."""
    df = df.withColumn("words", words_of(F.col("text")))
    df = df.withColumn("n_words", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("grams", _gram_hashes(F.col("hashes"), F.col("n_words"), GRAM))


def _winnowed(n: Column) -> Column:
    """The least gram hash of every WINDOW words: equal windows have equal fingerprints, so each
    shared span of WINDOW words is found."""
    return F.transform(_indices(n, WINDOW), lambda i: F.least(*(F.get("grams", i + j) for j in range(WINDOW - GRAM + 1))))


def _prints(short: list[int]) -> Column:
    """Fingerprints of a text: winnowed ones, and all grams of the lengths of short items."""
    parts = [_winnowed(F.col("n_words")), *(_gram_hashes(F.col("hashes"), F.col("n_words"), m) for m in short)]
    return F.concat(*parts) if short else parts[0]


def _at_each(grams: Column, size: int) -> Column:
    """(size, place, fp) of every gram."""
    return F.transform(grams, lambda x, i: F.struct(F.lit(size).alias("size"), i.alias("place"), x.alias("fp")))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(size, fp, item_id, place): where the fingerprints of items stand; an item of fewer than WINDOW words is one gram."""
    n = F.col("n_words")
    least = F.array_distinct(_winnowed(n))
    winnowed = F.filter(_at_each(F.col("grams"), GRAM), lambda g: F.array_contains(least, g["fp"]))
    seeds = F.when(n >= WINDOW, winnowed)
    for m in range(1, WINDOW):
        seeds = seeds.when(n == m, _at_each(_gram_hashes(F.col("hashes"), n, m), m))
    return items.select("item_id", F.explode(seeds).alias("s")).select("item_id", "s.*")


def _extended(seeds: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """(key, text_hash, item_id, spans): a seed's hit extended as far as it goes.

    seeds: (key, text_hash, item_id, shift), a document's and an item's words laid on each other at a
    shift. All words of the item that meet one of the document are compared, and the spans (pos, end) are the
    document's places of windows whose words are all the same.
    """
    shift, n = F.col("shift"), F.col("n_item")
    begin = F.greatest(shift, F.lit(0))  # in the document
    laid = (
        seeds.join(items.select("item_id", F.col("words").alias("item"), F.col("n_words").alias("n_item")), "item_id")
        .join(texts.select("key", "text_hash", "words"), ["key", "text_hash"])
        .select(
            "key", "text_hash", "item_id", begin.alias("begin"), F.least(n, F.lit(WINDOW)).alias("window"),
            F.slice("words", begin + 1, n - (begin - shift)).alias("own"), F.slice("item", begin - shift + 1, n).alias("item"),
        )
    )
    window = F.col("window")
    last = F.least(F.size("own"), F.size("item")) - window
    starts = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda j: F.slice("own", j + 1, window) == F.slice("item", j + 1, window)))
    spans = F.transform(starts, lambda j: F.struct((F.col("begin") + j).alias("pos"), (F.col("begin") + j + window).alias("end")))
    return laid.select("key", "text_hash", "item_id", spans.alias("spans")).filter(F.size("spans") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Winnowing: a text's fingerprints are the least hash of GRAM words in every window of WINDOW
    words. Documents that share a fingerprint with an item are read again, their grams are joined with the
    items' fingerprints, and every hit is extended: at its shift, document and item are compared word by
    word, and each run of WINDOW equal words counts. Equal windows have the same least gram at the same place, so no
    shared span of WINDOW words is missed. An item of fewer words is one window and found by the hash of its length.

    The items' fingerprints and the ids of suspect documents are broadcast only behind a count
    of their rows, the items' words behind a sum of their bytes; larger sides are joined by shuffle. The texts never shuffle in the first pass, and of a
    very long suspect each hit takes no more words than its item has.

    Null texts and texts without words: 0 words, nothing hit; items of that sort never occur.
    Equal items count each by their item_id; repeated item rows count once, null item_ids not.
    Rows that share doc_id and text, and repeated rows, get equal results. Empty benchmark: nothing hit. Other
    columns are ignored, whatever their names. Empty input: no rows.
    """
    items = stored(_with_hashes(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")).filter("n_words > 0 AND item_id IS NOT NULL").select("item_id", "words", "n_words", "hashes", "grams").distinct())
    short = sorted(r[0] for r in items.filter(F.col("n_words") < WINDOW).select("n_words").distinct().collect())  # 9 values at most
    item_seeds = stored(_item_seeds(items).distinct())
    prints = _checked(stored(item_seeds.select("fp").distinct()))

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    hashed = _with_hashes(rows).withColumn("fps", F.array_distinct(_prints(short)))
    tested = stored(
        hashed.select("row_id", "doc_id", "text_hash", "n_words", F.explode_outer("fps").alias("fp"))
        .join(prints.withColumn("known", F.lit(1)), "fp", "left")
        .groupBy("row_id", "doc_id", "text_hash", "n_words")
        .agg(F.count("known").alias("shared"))
    )
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text_hash")]
    suspects = _checked(stored(tested.filter("shared > 0").select(*key).distinct()))
    again = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).select(*key, "text").join(suspects, ["key", "text_hash"], "left_semi").dropDuplicates(["key", "text_hash"])
    texts = stored(_with_hashes(again).select("key", "text_hash", "words", "n_words", "hashes", "grams"))
    every = [_at_each(F.col("grams"), GRAM), *(_at_each(_gram_hashes(F.col("hashes"), F.col("n_words"), m), m) for m in short)]
    seeds = (
        texts.select("key", "text_hash", F.explode(F.concat(*every)).alias("s"))
        .select("key", "text_hash", "s.size", "s.fp", F.col("s.place").alias("own"))
        .join(_checked(item_seeds), ["size", "fp"])
        .select("key", "text_hash", "item_id", (F.col("own") - F.col("place")).alias("shift"))
        .distinct()
    )
    # an item_id with several texts: each is laid on
    hits = (
        _extended(seeds, texts, _checked_words(items.select("item_id", "words", "n_words")))
        .groupBy("key", "text_hash")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + s["end"] - F.least(s["end"], F.greatest(s["pos"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")),
    )["n"]
    found = hits.select("key", "text_hash", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("joined"))
    return tested.select("doc_id", *key, F.col("n_words").cast("long").alias("n_words")).join(found, ["key", "text_hash"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)
), hit AS (
  SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, win)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS j FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(j, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
