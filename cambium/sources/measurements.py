"""Reading measurement files: discovery, cells, rings, settings, images and processed tables."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.functions import expr as X
from cambium.operators.model import Measurements, require
from cambium.operators.tables import head_lines
from cambium.operators.validate import Table, align_to_schema

from .scratch import file_system, kept, listed

#: Fixed: kinds of files and their endings, in any case; images in such paths don't count.
ENDINGS = {"cells": r"_Output_Cells\.txt", "rings": r"_Output_Rings\.txt", "settings": r"_ROXAS_Settings\.txt", "image": r"\.jpe?g"}
NOT_IMAGES = ["annotated", "ReferenceSeries", "Preview"]
#: Fixed: columns of the files and their names in older versions.
CELL_COLUMNS = [
    "YEAR", "XPIX", "YPIX", "RADDISTR", "RRADDISTR", "NBRNO", "NBRID", "LA", "ASP", "MAJAX", "KH", "CWTPI", "CWTBA", "CWTLE",
    "CWTRI", "CWTTAN", "CWTRAD", "CWTALL", "RTSR", "CTSR", "DH", "DRAD", "DTAN", "TB2", "CWA", "RWD",
]
CELL_VARIANTS = {"TB2": ["BEND", "CRI"], "LA": ["CA"]}
RING_COLUMNS = ["YEAR", "RA", "MRW", "RVGI", "RVSF", "RGSGV", "AOIAR", "DH", "DH2"]
RING_RENAMED = {"dh": "dh_w", "dh2": "dh_m"}
#: Fixed: settings by row number.
SETTINGS = {
    8: "configuration_file", 9: "created_at", 10: "sw_version", 12: "spatial_resolution", 13: "origin_calibrated", 17: "meas_geometry",
    18: "circ_lower_limit", 19: "circ_upper_limit", 20: "outmost_year", 31: "min_cell_area", 33: "max_cell_area", 166: "dbl_cwt_threshold",
    203: "max_cwtrad_s", 204: "max_cwtrad_l", 205: "relwidth_cwt_window", 206: "maxrel_opp_cwt", 207: "max_cwttan_s", 208: "max_cwttan_l",
}
#: Fixed: types of settings and of the columns of processed tables.
INT_SETTINGS = ["circ_lower_limit", "circ_upper_limit", "outmost_year", "min_cell_area", "max_cell_area"]
DOUBLE_SETTINGS = ["spatial_resolution", "dbl_cwt_threshold", "max_cwtrad_s", "max_cwtrad_l", "relwidth_cwt_window", "maxrel_opp_cwt", "max_cwttan_s", "max_cwttan_l"]
INT_COLUMNS = ["year", "cno", "xpix", "ypix", "nbrno", "nbrid", "sector100"]
TEXT_COLUMNS = ["site_label", "tree_label", "woodpiece_label", "slide_label", "image_label", "ew_lw", "comment"]
FLAG_COLUMNS = ["incomplete_ring", "missing_ring", "duplicate_ring", "exclude_dupl", "exclude_issues"]

#: Labels and paths of so many bytes are broadcast.
BROADCAST_BYTES = 64 << 20
#: Folders with more entries aren't listed by Spark, whose driver would hold them all: tasks open the files that are named.
LISTED_FILES = 10_000
#: Bytes of files that a task sends on at a time.
_SENT_BYTES = 4 << 20


# -- discovery ----------------------------------------------------------------------------------


#: Python's names of file systems that Spark calls otherwise.
_PYTHON_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _system(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path, for a task, and the path in it."""
    scheme = path.split(":/", 1)[0] if ":/" in path else ""
    if scheme in ("", "file"):
        return pa_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa_fs.FileSystem.from_uri(path.replace(scheme, _PYTHON_SCHEMES.get(scheme, scheme), 1))


def open_file(path: str):
    """A file of random access in a task."""
    system, inner = _system(path)
    return system.open_input_file(inner)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, value) into files, a run of one path each; how many files. A file gets its name when it is whole."""
    path, out, made = None, None, 0

    def close() -> None:
        if out is not None:
            out.close()
            system, inner = _system(path)
            system.move(_aside(inner, task), inner)

    task = uuid.uuid4().hex
    for batch in batches:
        names, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lo = 0
        for hi in range(1, len(names) + 1):
            if hi < len(names) and names[hi] == names[lo]:
                continue
            if names[lo] != path:
                close()
                path, made = names[lo], made + 1
                system, inner = _system(path)
                out = system.open_output_stream(_aside(inner, task))
            out.write(b"".join(values[lo:hi]))
            lo = hi
    close()
    yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], names=["files"])


def _aside(path: str, task: str) -> str:
    folder, name = path.rsplit("/", 1)
    return f"{folder}/.{name}.{task}"


def spread(spark: SparkSession) -> int:
    """Number of partitions of paths: given, so that few bytes of many paths aren't put into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def write_files(rows: DataFrame, order: list[str]) -> int:
    """Write rows (path, value: binary, and the columns of order) into the files that they name, values of a path in order; the number of files.

    Tasks write the files, each those of its paths, as the rows come: no file is held whole, and the driver sees none. Paths
    must be on a file system of known_to_python, and their folders there. A task that runs again writes its files again.
    """
    ordered = rows.repartition(spread(rows.sparkSession), "path").sortWithinPartitions("path", *order).select("path", "value")
    return ordered.mapInArrow(_written, "files long").agg(F.sum("files")).first()[0] or 0


def known_to_python(path: str) -> bool:
    """Whether tasks can open files of the path's file system by themselves."""
    scheme = path.split(":/", 1)[0] if ":/" in path else ""
    if scheme in ("", "file"):
        return True
    try:
        pa_fs.FileSystem.from_uri(f"{_PYTHON_SCHEMES.get(scheme, scheme)}://host/path")
    except (OSError, ValueError):
        return False
    return True


def _entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is in folders, a row each; hidden entries (with a dot or an underscore in front) and empty files count for nothing, as in Spark."""
    for p in parts:
        for folder in p["folder"]:
            system, inner = _system(folder)
            found = [(f"{folder.rstrip('/')}/{x.base_name}", x.type == pa_fs.FileType.Directory) for x in system.get_file_info(pa_fs.FileSelector(inner)) if x.base_name[0] not in "._" and (x.size or x.type == pa_fs.FileType.Directory)]
            yield pd.DataFrame(found, columns=["path", "folder"])


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a folder.

    Folders are rows that tasks list, level by level: the folders found on one level are the rows of the next, so the driver holds
    neither files nor folders. On a file system that only Spark knows, Spark's own listing does it.
    """
    if not known_to_python(root):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    level, files = spark.createDataFrame([(root,)], "folder string"), None
    while not level.isEmpty():
        found = kept(level.repartition("folder").mapInPandas(_entries, "path string, folder boolean"), "listing")
        own = found.filter("NOT folder").select("path")
        files = own if files is None else files.unionByName(own)
        level = found.filter("folder").select(F.col("path").alias("folder"))
    return files


def found_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, kind) of the measurement files below a folder; contents aren't read."""
    files = listed_files(spark, folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind, stem = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, ending in ENDINGS.items():
        hit = F.rlike(name, F.lit(f"(?i){ending}$"))
        kind, stem = F.when(hit, k).otherwise(kind), F.when(hit, F.regexp_replace(name, f"(?i){ending}$", "")).otherwise(stem)
    out = files.select("path", stem.alias("stem"), kind.alias("kind")).filter("kind IS NOT NULL")
    for word in NOT_IMAGES:
        out = out.filter(~((F.col("kind") == "image") & F.col("path").contains(word)))
    return out


def file_sets(files: DataFrame) -> DataFrame:
    """One row per stem: fname_image, fname_cells, fname_rings, fname_settings (null where absent), paired by stem."""
    out = files.groupBy("stem").pivot("kind", list(ENDINGS)).agg(F.min("path"))
    return out.select("stem", *(F.col(k).alias(f"fname_{k}") for k in ("image", "cells", "rings", "settings")))


def incomplete_sets(files: DataFrame) -> DataFrame:
    """(stem, missing) of the stems that lack a file."""
    return file_sets(files).select("stem", F.concat_ws(", ", *(F.when(F.col(f"fname_{k}").isNull(), F.lit(k)) for k in ENDINGS)).alias("missing")).filter("missing <> ''")


class IncompleteError(ValueError):
    """Raised for a folder whose images lack files."""


def assert_complete(files: DataFrame, shown: int = 9) -> None:
    """An error if there are no files, or if an image lacks one of its four; it names the first of them."""
    if files.isEmpty():
        raise IncompleteError("no measurement files")
    lines = head_lines(incomplete_sets(files), F.concat("stem", F.lit(" has no "), "missing"), ["stem"], shown)
    if lines:
        raise IncompleteError("images without all files:\n" + "\n".join(lines))


# -- tab separated files --------------------------------------------------------------------------


def _key(c: Column) -> Column:
    """Paths alike, however they name their file system."""
    return F.regexp_replace(c, "^[a-z][a-z0-9+.-]*:/*", "/")


def _metadata_key() -> Column:
    """The key of a scan's own path, whose odd characters are encoded."""
    return _key(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def any_case(ending: str) -> str:
    """A glob for a file ending in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending.replace("\\", ""))


def folders_of(structure: DataFrame, fname: str) -> list[str]:
    """The folders of the files that structure names, without those that aren't there. The driver holds folders, not files."""
    spark = structure.sparkSession
    found = structure.select(F.regexp_extract(fname, "^(.*)/[^/]*$", 1).alias("folder")).dropna().distinct().collect()
    there = lambda folder: (fs := file_system(spark, folder))[0].exists(fs[1](folder))
    return sorted(r[0] for r in found if there(r[0]))


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many entries folders have."""
    for p in parts:
        for folder in p["folder"]:
            system, inner = _system(folder)
            yield pd.DataFrame({"n": [len(system.get_file_info(pa_fs.FileSelector(inner, allow_not_found=True)))]})


def by_tasks(spark: SparkSession, folders: list[str]) -> bool:
    """Whether tasks open the files of these folders: they know their file systems, and the folders have more than LISTED_FILES entries."""
    if not folders or not all(map(known_to_python, folders)):
        return False
    counts = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(spread(spark), "folder").mapInPandas(_counted, "n long")
    return counts.agg(F.sum("n")).first()[0] > LISTED_FILES


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, labels) as rows (labels, value) with the files' bytes; without files that are empty or can't be read."""
    for batch in batches:
        own, values, size = [], [], 0
        paths = batch.column(0).to_pylist()
        for i, path in enumerate(paths):
            try:
                with open_file(path) as f:
                    value = f.read()
            except OSError:
                value = b""
            if value:
                own.append(i)
                values.append(value)
                size += len(value)
            if values and (size >= _SENT_BYTES or i == len(paths) - 1):
                labels = batch.take(pa.array(own, pa.int64())).columns[1:]
                yield pa.RecordBatch.from_arrays([*labels, pa.array(values, pa.binary())], names=[*batch.schema.names[1:], "value"])
                own, values, size = [], [], 0


def named_as(path: Column, kind: str) -> Column:
    """Whether a path has a kind's ending and no dot or underscore in front, as Spark reads files."""
    return F.rlike(path, F.lit(f"(?i)(^|/)[^/._][^/]*{ENDINGS[kind]}$"))


def opened(named: DataFrame) -> DataFrame:
    """Rows, batch or stream, whose first column is a path, with the file's whole text (value) in its place, behind the others: read by the row's task."""
    schema = T.StructType([*named.schema.fields[1:], T.StructField("value", T.BinaryType())])
    return named.mapInArrow(_opened, schema).withColumn("value", F.col("value").cast("string"))


def beside(structure: DataFrame, fname: str, kind: str, labels: list[str]) -> DataFrame:
    """(labels, value) of the files that structure names in fname, each a row with its whole text.

    Only the folders that occur are read, by Spark's text source, so any file system that Spark knows will do. The labels are
    joined to files, not to lines: by broadcast up to BROADCAST_BYTES of labels and paths, else by a shuffle of the files.
    Of folders with more entries (by_tasks), tasks open the files beside their labels, and nothing of them reaches the driver. Files that are missing, empty (Spark lists none) or can't be read are left out.
    """
    spark = structure.sparkSession
    side = structure.select(_key(F.col(fname)).alias("file_key"), *labels)
    folders = folders_of(structure, fname)
    if not folders:
        return side.limit(0).select(*labels, F.lit(None).cast("string").alias("value"))
    if by_tasks(spark, folders):
        return opened(structure.select(F.col(fname).alias("path"), *labels).filter(named_as(F.col("path"), kind)).repartition(spread(spark), "path"))
    source = spark.read.format("text").options(wholetext=True, ignoreCorruptFiles=True, ignoreMissingFiles=True, pathGlobFilter=any_case(ENDINGS[kind]))
    texts = source.load(folders).select(_metadata_key().alias("file_key"), "value")
    size = side.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 for c in side.columns), F.lit(0)))).first()[0] or 0
    return texts.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, "file_key").select(*labels, "value")


def parsed(files: DataFrame, keep: list[str], columns: list[str], variants: dict[str, list[str]] | None = None) -> DataFrame:
    """The lines of whole files (column value), batch or stream: keep, line, problem and the columns as doubles.

    A file's own first line says where each column stands, by its name or else an older one. What isn't a number is null.
    problem says what is wrong with a row: a file that lacks columns is one row that names them; a line with too few fields has
    nulls for the rest; a line may have no year. Blank lines count for nothing. A file with no other line is a row of nulls.
    """
    older = variants or {}
    clean = lambda c: F.trim(c, F.lit('"\r \ufeff'))
    place = lambda c: F.coalesce(*(F.nullif(F.array_position("head", n), F.lit(0)) for n in [c, *older.get(c, [])])).cast("int") - 1
    lines = files.select(*keep, F.split("value", "\n").alias("lines"))
    heads = lines.select(*keep, "lines", F.transform(F.split(F.get("lines", F.lit(0)), "\t"), clean).alias("head"))
    placed = heads.select(*keep, "lines", F.array(*(place(c) for c in columns)).alias("places"))
    lacks = F.array_compact(F.array(*(F.when(F.get("places", F.lit(k)).isNull(), c) for k, c in enumerate(columns))))
    told = placed.select(*keep, "lines", "places", F.when(F.size(lacks) > 0, F.concat(F.lit("no column "), F.array_join(lacks, ", "))).alias("lacking"))
    body = F.when(F.col("lacking").isNull(), F.filter(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda t: clean(t) != ""))
    each = told.select(*keep, "places", "lacking", F.posexplode_outer(body).alias("line", "text"))
    cut = each.select(*keep, "line", "places", "lacking", F.split("text", "\t").alias("parts"))
    number = lambda k: X.clean_double(clean(F.get("parts", F.get("places", F.lit(k)))).try_cast("double"))
    short = F.size("parts") <= F.array_max("places")
    rows = cut.select(*keep, "line", "lacking", short.alias("short"), *(number(k).alias(c.lower()) for k, c in enumerate(columns)))
    dated = _integral_year(rows)
    problem = F.coalesce("lacking", F.when(F.col("short"), "short line"), F.when(F.col("line").isNotNull() & F.col("year").isNull(), "no year"))
    return dated.select(*keep, "line", problem.alias("problem"), *(c.lower() for c in columns))


def _integral_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.when(F.col("year") == F.floor("year"), F.col("year")).cast("int"))


def read_tsv(structure: DataFrame, fname: str, kind: str, labels: list[str], columns: list[str], variants: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that structure names in `fname`: its labels and the columns; and (image_label, problem) of the images with any.

    Rows without a year are left out. A file that is missing or empty, lacks columns, or has short lines or lines without a
    year is reported, and the load goes on with the rest.
    """
    rows = parsed(beside(structure, fname, kind, labels), labels, columns, variants)
    told = F.array_join(F.array_sort(F.collect_set("problem")), "; ")  # a few kinds for a file
    seen = rows.groupBy("image_label").agg(told.alias("problem"))
    problems = structure.select("image_label").distinct().join(seen, "image_label", "left").withColumn("problem", F.coalesce("problem", F.lit("no file")))
    return rows.filter("year IS NOT NULL").select(*labels, *(c.lower() for c in columns)), problems.filter("problem <> ''")


def collect_cells(spark: SparkSession, structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of all files (rows without a year left out), and (image_label, problem) of the files that weren't read whole."""
    return read_tsv(structure, "fname_cells", "cells", ["image_label"], CELL_COLUMNS, CELL_VARIANTS)


def collect_rings(spark: SparkSession, structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rings of all files with their labels, and (image_label, problem) of the files that weren't read whole."""
    df, failed = read_tsv(structure, "fname_rings", "rings", ["woodpiece_label", "slide_label", "image_label"], RING_COLUMNS)
    return df.withColumnsRenamed(RING_RENAMED), failed


def collect_measurements(spark: SparkSession, structure: DataFrame) -> Measurements:
    return Measurements(collect_cells(spark, structure)[0], collect_rings(spark, structure)[0])


def pivot_settings(rows: DataFrame) -> DataFrame:
    """Rows (path, rnum, setting) -> one row per file with named, typed settings."""
    names = F.create_map(*(x for k, v in SETTINGS.items() for x in (F.lit(k), F.lit(v))))
    named = rows.withColumn("name", names[F.col("rnum").cast("int")]).filter("name IS NOT NULL")
    wide = named.groupBy("path").pivot("name", list(SETTINGS.values())).agg(F.first("setting"))
    origin = F.split("origin_calibrated", r"\s*/\s*")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    out = wide.withColumns(
        {
            "meas_geometry": F.when(F.col("meas_geometry").isNull(), None).when(F.col("meas_geometry") == "1", "linear").otherwise("circular"),
            "origin_calibrated_x": F.get(origin, F.lit(0)),
            "origin_calibrated_y": F.get(origin, F.lit(1)),
            "software": F.lit("ROXAS"),
        }
    )
    out = out.withColumns({c: number(c) for c in [*DOUBLE_SETTINGS, "origin_calibrated_x", "origin_calibrated_y"]})
    return out.withColumns({c: number(c).cast("int") for c in INT_SETTINGS}).drop("origin_calibrated").withColumnRenamed("path", "fname_settings")


def _named(spark: SparkSession, files: DataFrame | list[str], fname: str) -> DataFrame:
    """The paths (column fname) of a structure or of a list, once each."""
    known = files if isinstance(files, DataFrame) else spark.createDataFrame([(f,) for f in files], f"{fname} string")
    return known.select(fname).dropna().distinct()


def collect_settings(spark: SparkSession, files: DataFrame | list[str], version: str = "classic") -> DataFrame:
    """One row of named, typed settings for each file that a structure names in fname_settings (or of a list of paths).

    Folders are read, not paths, or with many entries (by_tasks) the paths by tasks; a file that isn't there has no row.
    """
    if version != "classic":
        raise NotImplementedError(f"settings of version {version}")
    known = _named(spark, files, "fname_settings")
    source = spark.read.schema("RNUM string, SETTING string, DESCRIPTION string").options(sep="\t", header=True, pathGlobFilter=any_case(ENDINGS["settings"]))
    folders = folders_of(known, "fname_settings")
    if not folders:
        return pivot_settings(spark.createDataFrame([], "path string, rnum double, setting string"))
    if by_tasks(spark, folders):
        paths = known.filter(named_as(F.col("fname_settings"), "settings")).select("fname_settings", F.col("fname_settings").alias("path")).repartition(spread(spark), "fname_settings")
        lines = F.filter(F.split("value", "\r\n|\r|\n"), lambda t: F.rlike(t, F.lit(r"\S")))
        each = opened(paths).select("path", F.explode(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).alias("line"))
        rows = each.select("path", F.from_csv("line", "RNUM string, SETTING string, DESCRIPTION string", {"sep": "\t"}).alias("r"))
        rows = rows.select("path", F.expr("try_cast(r.RNUM as double)").alias("rnum"), F.col("r.SETTING").alias("setting"))
        return pivot_settings(rows.filter(F.col("rnum").isin(list(SETTINGS))))
    raw = source.csv(folders).select(_metadata_key().alias("file_key"), F.expr("try_cast(RNUM as double)").alias("rnum"), F.col("SETTING").alias("setting"))
    named = raw.filter(F.col("rnum").isin(list(SETTINGS))).join(known.select(_key(F.col("fname_settings")).alias("file_key"), F.col("fname_settings").alias("path")), "file_key")
    return pivot_settings(named.select("path", "rnum", "setting"))


#: Bytes that a step through an image's segments reads.
_STEP_BYTES = 64


def frame_size(read: Callable[[int, int], bytes]) -> tuple[int | None, int | None]:
    """Width and height of a JPEG by `read(at, n)`: from segment to segment up to the frame header, wherever it is."""
    if read(0, 2) != b"\xff\xd8":
        return None, None
    at = 2
    while True:
        head = read(at, _STEP_BYTES)
        fill = len(head) - len(head.lstrip(b"\xff")) - 1  # any number of 0xFF may come before a marker
        if fill > 0 and fill + 1 < len(head):
            at, head = at + fill, head[fill:]
        elif fill > 0:
            at += fill
            continue
        if len(head) < 4 or head[0] != 0xFF:
            return None, None
        marker, length = head[1], struct.unpack(">H", head[2:4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if len(head) < 9:
                head = read(at, 9)
            return (None, None) if len(head) < 9 else struct.unpack(">HH", head[5:9])[::-1]
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2  # no length follows
        elif marker in (0xD9, 0xDA) or length < 2:
            return None, None  # image data, or its end, without a frame header
        else:
            at += 2 + length


def _heads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size, width and height of files by ranged reads; nulls for one that can't be opened."""
    for p in parts:
        rows = []
        for path in p["fname_image"]:
            try:
                with open_file(path) as f:
                    size = f.size()
                    rows.append((path, size, *frame_size(lambda at, n: f.read_at(max(0, min(n, size - at)), at) if at < size else b"")))  # noqa: B023
            except OSError:
                rows.append((path, None, None, None))
        yield _image_rows(rows)


def _image_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["fname_image", "img_size", "img_width", "img_height"]).astype({c: "Int64" for c in ("img_size", "img_width", "img_height")})
    out.insert(1, "img_filetype", ["JPEG" if w is not None else None for *_, w, _ in rows])
    return out


def _whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        yield _image_rows([(path, size, *frame_size(lambda at, n: bytes(c[at : at + n]))) for path, size, c in zip(p["path"], p["length"], p["content"], strict=True)])  # noqa: B023


def collect_image_info(spark: SparkSession, files: DataFrame | list[str]) -> DataFrame:
    """fname_image, img_filetype, img_size, img_width, img_height of the JPEG files that a structure names (or of a list of paths).

    Tasks step through each file's segments and read some bytes of each, however large the file and wherever its frame
    header is. On a file system that only Spark knows, its folders are read whole. A file that can't be opened has nulls, and
    so has one that isn't a JPEG, but for its size.
    """
    known = _named(spark, files, "fname_image").filter(F.rlike("fname_image", F.lit(r"(?i)\.jpe?g$")))
    schemes = known.select(F.regexp_extract("fname_image", "^([a-z][a-z0-9+.-]*):/", 1).alias("scheme")).distinct().collect()  # a few
    foreign = [r[0] for r in schemes if not known_to_python(f"{r[0]}:/" if r[0] else "/")]
    scheme = F.regexp_extract("fname_image", "^([a-z][a-z0-9+.-]*):/", 1)
    columns = "fname_image string, img_filetype string, img_size long, img_width int, img_height int"
    near = known.filter(~scheme.isin(foreign)) if foreign else known
    out = near.repartition("fname_image").mapInPandas(_heads, columns)
    if foreign:
        far = known.filter(scheme.isin(foreign))
        read = spark.read.format("binaryFile").option("pathGlobFilter", any_case(".jp") + "*").load(folders_of(far, "fname_image"))
        named = far.select(_key(F.col("fname_image")).alias("file_key"), F.col("fname_image").alias("path"))
        out = out.unionByName(read.select(_key(F.col("path")).alias("file_key"), "length", "content").join(named, "file_key").select("path", "length", "content").mapInPandas(_whole, columns))
    return out


# -- processed tables ----------------------------------------------------------------------------


def processed_schema(columns: list[str]) -> T.StructType:
    kind = lambda c: T.IntegerType() if c in INT_COLUMNS else T.StringType() if c in TEXT_COLUMNS else T.BooleanType() if c in FLAG_COLUMNS else T.DoubleType()
    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def read_processed(spark: SparkSession, folder: str, dataset: str) -> Measurements:
    """The one cells and the one rings CSV (plain or gzip) of a data set in a folder."""
    names, tables = listed(spark, folder), {}
    for kind in ("cells", "rings"):
        hits = [n for n in names if ".csv" in n and dataset in n and kind in n.split(dataset, 1)[1]]
        if len(hits) != 1:
            raise FileNotFoundError(f"{len(hits)} files for {kind} of {dataset}")
        path = f"{folder}/{hits[0]}"
        head = spark.read.option("header", True).csv(path).columns
        tables[kind] = spark.read.schema(processed_schema(head)).csv(path, header=True, nullValue="NA")
    return Measurements(tables["cells"], tables["rings"])


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A profile table from CSV: key, sector and at least one measure, all doubles; the key must be whole."""
    df = _typed_csv(spark, path, lambda c: "string" if c == "image_label" else "int" if c in ("year", "sector_n") else "double")
    require(df, ["image_label", "year", "sector_n"], "read_profiles")
    if len(df.columns) < 4:
        raise ValueError("read_profiles: no measure")
    return _without_nulls(df, ["image_label", "year", "sector_n"])


def read_ring_flags(spark: SparkSession, path: str) -> DataFrame:
    """A ring table from CSV with its labels and flags; the key must be whole."""
    df = spark.read.schema(processed_schema(spark.read.option("header", True).csv(path).columns)).csv(path, header=True, nullValue="NA")
    require(df, ["woodpiece_label", "slide_label", "image_label", "year", *FLAG_COLUMNS], "read_ring_flags")
    return _without_nulls(df, ["woodpiece_label", "slide_label", "image_label", "year"])


def read_image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Image metadata from CSV, all text."""
    df = _typed_csv(spark, path, lambda c: "string")
    require(df, ["image_label", "slide_label", "woodpiece_label", "tree_label", "species_code", "site_label", "fname_image"], "read_image_metadata")
    return df


def _typed_csv(spark: SparkSession, path: str, kind) -> DataFrame:
    head = spark.read.option("header", True).csv(path).columns
    return spark.read.schema(", ".join(f"`{c}` {kind(c)}" for c in head)).csv(path, header=True, nullValue="NA")


def _without_nulls(df: DataFrame, key: list[str]) -> DataFrame:
    """df, if it has rows and no null in its key; else an error."""
    seen = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in key)).first()
    if not seen["n"] or any(seen[c] < seen["n"] for c in key):
        raise ValueError(f"no rows, or missing values in {', '.join(c for c in key if seen[c] < seen['n'])}")
    return df


def read_raw_table(spark: SparkSession, path: str, table: Table, force_required: bool = True, by_position: bool = False) -> tuple[DataFrame, list[str]]:
    """A CSV of any columns, read as text and aligned to a table's schema; with the warnings."""
    return align_to_schema(spark.read.csv(path, header=True, nullValue=""), table, force_required, by_position)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Country polygons from CSV (code, wkt): code, part and ring, an array of (lon, lat); a row for each ring, holes too.

    POLYGON and MULTIPOLYGON texts in longitude and latitude. All rings of a text are one part, for the even-odd rule.
    """
    raw = spark.read.csv(path, header=True, nullValue="", escape='"', schema="code string, wkt string").distinct()
    rings = raw.select("code", F.xxhash64("code", "wkt").alias("part"), F.explode(F.regexp_extract_all("wkt", F.lit(r"\(([^()]+)\)"), F.lit(1))).alias("text"))
    point = lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).cast("double").alias("lon"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).cast("double").alias("lat"))
    return rings.select("code", "part", F.transform(F.split("text", ","), point).alias("ring"))


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Reference list of countries; the code NA is a value."""
    return spark.read.csv(path, header=True, nullValue="", schema="country_name string, country_iso_code string, combined string")


def read_species(spark: SparkSession, path: str) -> DataFrame:
    """Reference list of species with their codes and traits; other columns are left out."""
    columns = ["species_name", "itrdb_species_code", "phylogenetic_group", "leaf_habit", "tree_ring_structure"]
    return spark.read.csv(path, header=True, nullValue="").select(*columns)
