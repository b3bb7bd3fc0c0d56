"""Newly arriving cell files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.sources.measurements import CELL_COLUMNS, CELL_VARIANTS, ENDINGS, any_case, listed_files, named_as, opened, parsed, spread
from cambium.sources.scratch import file_system


def arrived_cells(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The lines of the cell files that arrive below a folder: their stem, line, problem and columns, as `parsed` gives them.

    Columns are found by each file's own header, as in a batch. Each file is read once; the checkpoint of the sink
    remembers which ones have been. A file must arrive whole (by a rename).
    """
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", any_case(ENDINGS["cells"])).load(folder)
    name = F.element_at(F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/"), -1)
    return parsed(raw.select(F.regexp_replace(name, f"(?i){ENDINGS['cells']}$", "").alias("stem"), "value"), ["stem"], CELL_COLUMNS, CELL_VARIANTS)


def cell_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Cells with a year of the files that arrive below a folder, with their stem."""
    return arrived_cells(spark, folder, files_per_trigger).filter("year IS NOT NULL").drop("line", "problem")


def note_arrived(spark: SparkSession, folder: str, notes: str) -> None:
    """Adds the paths of the cell files below a folder that the notes (a folder of Parquet files) don't have yet. Tasks list the folder and write the notes."""
    found = listed_files(spark, folder).filter(named_as(F.col("path"), "cells"))
    fs, at = file_system(spark, notes)
    if fs.exists(at(notes)):
        found = found.join(spark.read.schema("path string").parquet(notes), "path", "left_anti")
    found.repartition(spread(spark), "path").write.mode("append").parquet(notes)


def noted_cells(spark: SparkSession, notes: str) -> DataFrame:
    """cell_stream of the files in notes (note_arrived), for archives whose files the driver can't hold: it sees the notes only, of which each has many.

    The checkpoint of the sink remembers which notes have been read. The files must be on a file system of known_to_python.
    """
    paths = spark.readStream.schema("path string").parquet(notes)
    name = F.element_at(F.split("path", "/"), -1)
    texts = opened(paths.select("path", F.regexp_replace(name, f"(?i){ENDINGS['cells']}$", "").alias("stem")))
    return parsed(texts, ["stem"], CELL_COLUMNS, CELL_VARIANTS).filter("year IS NOT NULL").drop("line", "problem")


def problem_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """stem, line and problem of what was wrong with the files that arrive."""
    return arrived_cells(spark, folder, files_per_trigger).filter("problem IS NOT NULL").select("stem", "line", "problem")


def ring_counts(cells: DataFrame) -> DataFrame:
    """Running cell counts per stem and year (complete or update output mode)."""
    return cells.groupBy("stem", F.col("year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("cno"))


def count_arrived(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Processes all files that have arrived, writing the counts to path after each batch, and ends."""

    def write(batch: DataFrame, nr: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
