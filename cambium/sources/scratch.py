"""Folders for what a query writes and reads again."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only a local session, whose executors are threads of this process, gets one of its own where none is set.
    """
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="cambium-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that isn't there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting for whether a query's shuffle files go with its end, not with the driver's garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a write in here is deleted once it is written, since no later query reads it."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps read it instead of what it was made from."""
    path = new_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its Path class."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, from any file system that Spark knows."""
    fs, at = file_system(spark, path)
    stream = fs.open(at(path))
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; nothing below it is looked at."""
    fs, path = file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path(folder)))


def drop_folders(spark: SparkSession) -> None:
    """Delete the session's folders, once no result that reads them is needed any more."""
    fs, path = file_system(spark, shared_folder(spark))
    for found in fs.listStatus(path(shared_folder(spark))):
        fs.delete(found.getPath(), True)
