"""How quality filters overlap: every order of the filters replayed over the documents' flags."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Characters between words beside the space: U+0009 to U+000D.
GAPS = "\t\n\x0b\x0c\r"
FILTERS = "ABCDE"


def words(text: Column) -> Column:
    """The words of a text; plain replacements and one split at spaces, which cost half of a split by a pattern."""
    for gap in GAPS:
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def flags(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, with a boolean for each failure condition that hangs on the text alone (column text, not null).

    Words are split once: as they are used twice, Spark keeps them in a projection of their own.
    """
    counted = docs.withColumn("words", words(F.col("text"))).select(*keep, "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("different"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    return counted.select(
        *keep,
        (F.col("n") < 200).alias("A"),
        (F.lit(100) * F.col("different").cast("long") < F.lit(50) * F.col("n").cast("long")).alias("B"),
        (F.lit(100) * capitals > F.lit(3) * F.length("text").cast("long")).alias("C"),
        F.rlike("text", F.lit("[#$%&*|]")).alias("D"),
    )


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the flag of every filter, good and toxic of every row of docs; stored.

    A repeats filter E fails a row if an equal text has a smaller doc_id. The least doc_id of each text comes from one grouping
    (a hot text sends one row a task), and is found again by text and doc_id together, a key that no text makes hot.
    """
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = texts.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = stored(flags(hashed, "doc_id", "part", "sha"))
    least = rows.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).dropna().withColumn("first", F.lit(True))
    known = labels.groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    both = rows.join(least, ["sha", "doc_id"], "left").join(known, "doc_id", "left")
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return both.select("part", *"ABCD", repeats.alias("E"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def replay(flagged_rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts for every part, order of the filters and step; flagged_rows has part, a boolean for each filter, good and toxic.

    Rows with the same flags fare alike, so they are counted first, with map-side combining: what is crossed with the
    orders (a broadcast of 120 rows for five filters) is at most 128 patterns a part, not the documents. Each
    pattern and order gives a row a step; the first failing step decides, and conditional sums count documents.
    """
    spark = flagged_rows.sparkSession
    patterns = flagged_rows.groupBy("part", *filters, "good", "toxic").agg(F.count("*").alias("n"))
    orders = F.broadcast(spark.createDataFrame([("".join(p),) for p in permutations(filters)], "filter_order string"))
    fails = F.create_map(*(x for c in filters for x in (F.lit(c), F.col(c))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    failing = F.array_compact(F.array(*(F.when(fails[F.substring("filter_order", k, 1)], k) for k in range(1, len(filters) + 1))))
    crossed = patterns.join(orders).withColumns({"first": F.array_min(failing), "n_failing": F.size(failing), "fails": fails})
    steps = crossed.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters))))).withColumn("filter", letter)
    fail, here = F.col("fails")[F.col("filter")], F.col("first") == F.col("step")
    total = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    counted = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(F.col("first").isNull() | (F.col("first") > F.col("step")), "kept"),
        total(here, "removed"),
        total(fail & (F.col("first") < F.col("step")), "redundant"),
        total(fail & (F.col("n_failing") == 1), "unique_fails"),
        total(here & F.col("good"), "good_lost"),
        total(here & F.col("toxic"), "toxic_lost"),
    )
    counted = stored(counted)
    shapley = counted.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return counted.join(shapley, ["part", "filter"])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, filter.

    A part is a value of lang, null and the empty text alike; each has 120 orders of 5 steps, zeros included. Null
    texts are empty ones. A null doc_id is smaller than none and has none that is smaller, so it never repeats; rows of one
    doc_id don't repeat each other, and repeated rows count each. Of several labels for a doc_id, quality 1 and toxic 1 win;
    without one neither holds. Very long texts are split into words where they are, and nothing but flags and hashes of texts is
    shuffled. Other columns are ignored, whatever their names. Empty input: no rows.
    """
    return replay(flagged(docs.select("doc_id", "lang", "text"), labels.select("doc_id", "quality", "toxic"))).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley", "filter"
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), f AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM t
), l AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id
), p AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_failing,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT k1.x || k2.x || k3.x || k4.x || k5.x AS filter_order FROM k k1, k k2, k k3, k k4, k k5
  WHERE len(list_distinct([k1.x, k2.x, k3.x, k4.x, k5.x])) = 5
), s AS (
  SELECT *, list_min([i FOR i IN range(1, 6) IF fails[substr(filter_order, i::INT, 1)]]) AS first FROM p, o
), e AS (
  SELECT *, substr(filter_order, step, 1) AS filter, fails[substr(filter_order, step, 1)] AS fail FROM s, (SELECT unnest(range(1, 6))::INT AS step)
), c AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN first IS NULL OR first > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fail AND first < step THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fail AND n_failing = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN first = step THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN first = step THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM e GROUP BY ALL
)
SELECT *, sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM c
"""
