"""Manual ring flags: initial columns, edits, checks, coverage and duplicate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.sources.scratch import file_system

from .model import RING_KEY, require
from .tables import arranged

#: Fixed: flag columns of the ring editor.
DISCRETE_FEATURES = ["blue_ring", "frost_ring", "light_ring", "iadf", "traum_resin_ducts", "trabeculae", "other_discrete"]
DISQUALIFYING = [
    "duplicate_ring", "incomplete_ring", "missing_ring", "x_dating", "compression_wood",
    "orientation", "tyloses", "decay", "technical_issues", "other_disqual",
]
TECHNICAL = ["out_of_focus", "cracks", "paraffin", "compressed_cells", "overlapping_cells", "broken_cells", "tang_incomplete"]
#: Fixed: flags that should come with an exclusion.
SHOULD_EXCLUDE = ["incomplete_ring", "missing_ring", "x_dating", "compression_wood", "orientation"]


def init_flags(rings: DataFrame) -> DataFrame:
    """Adds the flag columns that are absent (false) and comment (null)."""
    absent = {c: F.lit(False) for c in [*DISCRETE_FEATURES, *DISQUALIFYING, *TECHNICAL] if c not in rings.columns}
    if "comment" not in rings.columns:
        absent["comment"] = F.lit(None).cast("string")
    return rings.withColumns(absent) if absent else rings


def apply_edits(rings: DataFrame, edits: DataFrame, order: str = "edit_nr") -> DataFrame:
    """Keyed update: for each ring and column the last edit that isn't null wins.

    edits has image_label, year, `order` and any of the rings' other columns. Edits of rings
    that don't exist change nothing. Undo is the same with fewer edits.
    """
    require(edits, [*RING_KEY, order], "apply_edits")
    columns = [c for c in edits.columns if c in rings.columns and c not in RING_KEY]
    last = edits.groupBy(*RING_KEY).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"new_{c}") for c in columns))
    joined = rings.join(last, RING_KEY, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rings.columns))


def undo_edits(edits: DataFrame, last: int, order: str = "edit_nr") -> DataFrame:
    """The edits up to the one numbered `last`; 0 leaves none, which is the input again."""
    return edits.filter(F.col(order) <= last)


#: Buckets of images that committed rings are stored in.
BUCKETS = 256


def _bucket() -> Column:
    return F.pmod(F.xxhash64("image_label"), F.lit(BUCKETS)).cast("int")


def _write_buckets(rings: DataFrame, path: str) -> None:
    """Replaces the buckets that rings are in, and no other."""
    out = rings.withColumn("bucket", _bucket()).repartition("bucket").sortWithinPartitions("bucket", "woodpiece_label", "year", "image_label")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def commit_edits(rings: DataFrame, edits: DataFrame, path: str, order: str = "edit_nr") -> DataFrame:
    """Commits edits to the rings stored at path and reads them back: from here on they are the input.

    Rings are stored by buckets of images; the first commit puts `rings` there, later ones take them from there. Only the
    buckets of the edits' images are read, changed and overwritten, all others stay as they are. Committing the
    same edits again changes nothing. Within a bucket rings are in the order of woodpieces and years. What was read
    before a commit is to be read again after it.
    """
    spark = rings.sparkSession
    fs, at = file_system(spark, path)
    if not fs.exists(at(path)):
        _write_buckets(rings, path)
    stored = spark.read.schema(T.StructType([*rings.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
    touched = [r[0] for r in edits.select(_bucket()).distinct().collect()]  # BUCKETS at most
    _write_buckets(apply_edits(stored.filter(F.col("bucket").isin(touched)).drop("bucket"), edits, order), path)
    return spark.read.schema(stored.schema).parquet(path).drop("bucket")


#: Kinds that columns of an editor's input must have.
RING_KINDS = {
    **dict.fromkeys(["woodpiece_label", "slide_label", "image_label", "other_reason"], "string"),
    **dict.fromkeys(["year", "cno", "mrw", "duplicate_rank"], "number"),
    **dict.fromkeys(["incomplete_ring", "missing_ring", "duplicate_ring", "duplicate_sel", "other_issues"], "boolean"),
}


def inconsistent_exclusions(rings: DataFrame) -> DataFrame:
    """Rings with a flag that should exclude them, but that aren't excluded: key and the flags."""
    flags = F.concat_ws(", ", *(F.when(F.col(c), F.lit(c)) for c in SHOULD_EXCLUDE if c in rings.columns))
    return rings.select(*RING_KEY, flags.alias("flags"), F.coalesce("exclude_issues", F.lit(False)).alias("excluded")).filter("flags <> '' AND NOT excluded").drop("excluded")


def duplicate_selection(rings: DataFrame) -> DataFrame:
    """Adds duplicate_rank (by cell count, +100 if missing or incomplete), duplicate_sel, other_issues and other_reason."""
    group = Window.partitionBy("woodpiece_label", "year")
    place = F.row_number().over(group.orderBy(F.col("cno").desc_nulls_last(), F.col("image_label").asc_nulls_last()))
    late = F.when(F.col("missing_ring") | F.col("incomplete_ring"), 100).otherwise(0)
    ranked = rings.withColumn("duplicate_rank", F.when(F.col("duplicate_ring"), place + late))
    best = F.col("duplicate_rank") == F.min("duplicate_rank").over(group)
    more = {"duplicate_sel": F.when(F.col("duplicate_ring"), best)}
    if "other_issues" not in rings.columns:
        more["other_issues"] = F.lit(False)
    if "other_reason" not in rings.columns:
        more["other_reason"] = F.lit(None).cast("string")
    return ranked.withColumns(more)


def flag_checks(rings: DataFrame) -> DataFrame:
    """One row of three booleans: each duplicate group has one selection, no comment is missing, none is stray."""
    groups = rings.filter("duplicate_ring").groupBy("woodpiece_label", "year").agg(
        F.when(F.count(F.lit(1)) == F.count("duplicate_sel"), F.count_if(F.col("duplicate_sel"))).alias("n")
    )
    bad = groups.agg(F.count_if(F.col("n") != 1).alias("bad_groups"))
    empty = F.col("other_reason").isNull() | (F.col("other_reason") == "")
    comments = rings.agg(
        F.count_if(F.col("other_issues") & empty).alias("missing_comments"), F.count_if(~F.col("other_issues") & ~empty).alias("stray_comments")
    )
    return comments.crossJoin(bad).select(  # one row each
        (F.col("bad_groups") == 0).alias("one_selected"),
        (F.col("missing_comments") == 0).alias("comments_complete"),
        (F.col("stray_comments") == 0).alias("comments_needed"),
    )


def ring_table_issues(rings: DataFrame) -> DataFrame:
    """(issue, n) of an editor's input: columns of a wrong kind, nulls in the key and flags, repeated keys, duplicates without rank or the reverse."""
    required = ["woodpiece_label", "slide_label", *RING_KEY, "incomplete_ring", "missing_ring", "duplicate_ring"]
    require(rings, required, "ring_table_issues")
    nulls = rings.agg(*(F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in required)).unpivot([], [f"null {c}" for c in required], "issue", "n")
    repeated = rings.groupBy(*RING_KEY).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated ring").alias("issue"), "n")
    out = nulls.unionByName(repeated)
    if {"duplicate_rank", "duplicate_sel"} <= set(rings.columns):
        ranked = F.col("duplicate_rank").isNotNull() & F.col("duplicate_sel").isNotNull()
        odd = rings.agg(F.count_if(F.col("duplicate_ring") != ranked).alias("n")).select(F.lit("rank of duplicates").alias("issue"), "n")
        out = out.unionByName(odd)
    kind = lambda t: "string" if isinstance(t, T.StringType) else "boolean" if isinstance(t, T.BooleanType) else "number" if isinstance(t, T.NumericType) else "other"
    wrong = [c for c, k in RING_KINDS.items() if c in rings.columns and kind(rings.schema[c].dataType) != k]
    if wrong:
        out = out.unionByName(rings.sparkSession.createDataFrame([(f"type of {c}", 1) for c in wrong], "issue string, n long"))
    return out.filter("n > 0")


def coverage_table(rings: DataFrame) -> DataFrame:
    """Plot data of the flags: each flag's year where it is set, and a label that lists them."""
    selected = F.col("duplicate_sel") if "duplicate_sel" in rings.columns else F.lit(None).cast("boolean")
    other = F.col("other_issues") if "other_issues" in rings.columns else F.lit(False)
    dupl = F.col("duplicate_ring") & F.coalesce(~selected, F.lit(False))
    flags = [("incomplete_ring", F.col("incomplete_ring"), "incomplete"), ("duplicate_ring", dupl, "duplicate"), ("duplicate_sel", selected, "best duplicate"), ("missing_ring", F.col("missing_ring"), "missing"), ("other_issues", other, "other")]
    names = F.concat_ws(", ", *(F.when(on, F.lit(word)) for _, on, word in flags))
    label = F.concat(F.lit("flags: "), F.when(names == "", F.lit("none")).otherwise(names))
    return rings.select("woodpiece_label", "slide_label", *RING_KEY, *(F.when(on, F.col("year")).alias(name) for name, on, _ in flags), label.alias("labels"))


def coverage_limits(rings: DataFrame) -> DataFrame:
    """Per woodpiece: years rounded outwards to fives and the plot's size in pixels."""
    span = rings.groupBy("woodpiece_label").agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.count_distinct("image_label").alias("images"))
    clamp = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi)).cast("int")
    return span.select(
        "woodpiece_label",
        (F.floor(F.col("lo") / 5) * 5).cast("int").alias("min_year"),
        (F.ceil(F.col("hi") / 5) * 5).cast("int").alias("max_year"),
        clamp((F.col("hi") - F.col("lo")) * 75 + 800, 2000, 6000).alias("width_px"),
        clamp(F.col("images") * 100 + 200, 750, 2000).alias("height_px"),
    )
