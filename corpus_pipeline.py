"""The corpus pipeline: documents -> identified, deduplicated, decontaminated, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of `documents`, and others that docs has,
whatever their names. Each row has a decision of its own: doc_ids may be null or shared. Texts of any
length are read whole. Without rows a stage returns none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm import bpe, decontaminate, exact_dedup, langid, ngram_join
from cambium.llm.common import free_name, stored, table
from cambium.llm.queries import VOCABULARY


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects: no letter (null and empty texts too), or too
    far from every centroid that was learned from this stage's own input.

    Repeated rows are judged alike. Rows without doc_id or lang aren't learned from. If nothing can be learned, every row
    goes, since none can be told from junk.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    learned = docs.filter((fold != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = langid.fit(learned.select("doc_id", F.lower("text").alias("text"), "lang"))
    prefix = "langid_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    judged = langid.identify(docs, model, docs.columns, prefix=prefix)
    return judged.filter(~F.col(f"{prefix}rejected")).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts.

    Within a group the operator's decision hangs on doc_id alone, so doc_id and the normalised
    text's hash are the key of a row's own decision. Null and empty texts are one group. Null doc_ids come last; of rows
    with the winner's doc_id the longest text stays, and of fully equal rows any one.
    """
    found = stored(exact_dedup.exact_dedup(docs.select("doc_id", "text")).filter("group_size > 1").select("doc_id", F.unhex("text_sha256").alias("sha"), "kept"))
    gone = found.filter("NOT kept").select("doc_id", "sha").distinct()
    many = found.filter("kept").groupBy("doc_id", "sha").count().filter("count > 1").select("doc_id", "sha")
    return _without(docs, [F.col("doc_id"), F.unhex(F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256))], gone, many)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id (null: last) of each component of linked shingle sets.

    The operator ties rows of one doc_id together and leaves out those without, so it gets a
    number for the SHA-256 of doc_id and text as the id, which no other pair has. Rows without words (null texts too) link with nothing and stay. Of
    rows with the first one's doc_id and text one stays.
    """
    known = lambda c: F.coalesce(F.concat(F.lit("1"), F.col(c).cast("string")), F.lit("0")).cast("binary")
    key = F.unhex(F.sha2(F.concat(F.sha2(known("doc_id"), 256).cast("binary"), known("text")), 256))
    rows = _numbered(docs.select("doc_id", "text", key.alias("key")))
    joined = stored(ngram_join.ngram_join(rows.select(F.col("id").alias("doc_id"), "text")).filter("n_shingles > 0").select(F.col("doc_id").alias("id"), "component_id"))
    shared = joined.groupBy("component_id").count().filter("count > 1").select("component_id")
    linked = joined.join(shared, "component_id").select("id", "component_id").distinct()
    members = stored(linked.join(rows.select("id", "key", "doc_id"), "id").groupBy("component_id", "key", "doc_id").agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = stored(members.groupBy("component_id").agg(F.min(order)["key"].alias("first")))
    judged = members.join(first, "component_id")
    gone = judged.filter("key <> first").select("key")
    many = judged.filter("key = first AND n > 1").select("key")
    return _without(docs, [key], gone, many)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows in which a window of a benchmark item occurs; the text alone decides, so repeated rows
    go or stay together, whatever their doc_ids. Null texts and texts without words stay."""
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    found = decontaminate.decontaminate(docs.select(F.hex(sha).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, [sha], found.filter("contaminated").select(F.unhex("doc_id").alias("sha")).distinct())


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row that is left; null text: no ids."""
    return bpe.bpe_digest(docs, VOCABULARY, with_ids=True)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with id, a number of the key: its 64-bit hash, and where several keys have one hash, another one for all but the first.

    That takes some 10^9 different keys, so the keys that move are a few, if any.
    """
    numbered = rows.withColumn("id", F.xxhash64("key"))
    shared = numbered.groupBy("id").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first <> last").select("id", "first")
    moved = stored(shared)
    if moved.isEmpty():
        return numbered
    again = numbered.join(moved, "id", "left")
    return again.withColumn("id", F.when(F.col("key") != F.col("first"), F.xxhash64("key", F.lit(1))).otherwise(F.col("id"))).drop("first")


def _without(docs: DataFrame, key: list[Column], gone: DataFrame, many: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose key isn't in gone (the same columns in the same order); of the rows with a key in many only
    one, the longest text.

    What goes is less than what stays, so the keys that go are joined against: by broadcast
    behind a count, by shuffle beyond it. Nulls are equal. Helper columns have names that docs hasn't.
    """
    names = [free_name(f"key_{i}", docs.columns) for i in range(len(key))]
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(key, names, strict=True)))

    def joined(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        others = [free_name(f"of_{n}", [*docs.columns, *names]) for n in names]
        keys = keys.toDF(*others)
        same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(names, others, strict=True)]
        return rows.join(F.broadcast(keys) if keys.count() <= decontaminate.BROADCAST_ROWS else keys, same, how)

    rest = joined(keyed, stored(gone), "left_anti")
    many = None if many is None else stored(many)
    if many is None or many.isEmpty():
        return rest.select(*docs.columns)
    row = F.struct(*docs.columns)
    longest = F.max_by(row, F.struct(F.length("text"), F.to_json(row)))
    kept = free_name("kept_row", [*docs.columns, *names])
    one = joined(rest, many, "left_semi").groupBy(*names).agg(longest.alias(kept)).select(f"{kept}.*")
    return joined(rest, many, "left_anti").select(*docs.columns).unionByName(one)


STAGES = [
    ("language identification", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding", encoding_stage),
]

#: Language identification and BPE are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
