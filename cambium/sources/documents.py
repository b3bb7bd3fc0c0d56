"""Metadata documents: a JSON object of record arrays, in and out; processed tables out."""

from __future__ import annotations

import codecs
import datetime as dt
import io
import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.operators.structure import file_name_of
from cambium.operators.tables import arranged
from cambium.operators.validate import SchemaError, Table, validated_document, violations

from .measurements import known_to_python, open_file
from .scratch import file_system, kept, listed, new_folder, shuffles_dropped


#: What splitting a document looks at: whole strings (or one that the text breaks off in) and brackets.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[\[\]{}]', re.DOTALL)
_CHUNK = 1 << 20
FAST_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
_ROWS = 10_000


def split_records(chunks: Iterator[str]) -> Iterator[tuple[str, str | None]]:
    """(table, record) of the text of an object of record arrays, as it comes in; (table, None) where an array begins.

    No more than a chunk and a record is held. Members that aren't arrays are left out.
    """
    text, at, depth, name, table, start = "", 0, 0, None, None, None
    for chunk in chunks:
        text += chunk
        for m in _TOKEN.finditer(text, at):
            token = m[0]
            if token[0] == '"':
                if len(token) == 1 or token[-1] != '"' or m.end() == len(text):
                    break  # it may go on in the next chunk
                if depth == 1:
                    name = token
            elif token in "[{":
                depth += 1
                if depth == 2 and token == "[":
                    table = json.loads(name)
                    yield table, None
                elif depth == 3 and table is not None and token == "{":
                    start = m.start()
            else:
                if depth == 3 and start is not None:
                    yield table, text[start : m.end()]
                    start = None
                depth -= 1
                if depth == 1:
                    table = None
            at = m.end()
        cut = at if start is None else start
        text, at, start = text[cut:], at - cut, None if start is None else 0


def _texts(read: Callable[[int], bytes]) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    while part := read(_CHUNK):
        yield decoder.decode(part)


def _split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of documents: path, or content where only Spark can read the path."""
    for p in parts:
        for row in p.itertuples(index=False):
            with io.BytesIO(row.content) if row.content is not None else open_file(row.path) as f:
                records = split_records(_texts(f.read))
                while rows := list(islice(records, _ROWS)):
                    yield pd.DataFrame(rows, columns=["tbl", "record"])


def read_metadata(spark: SparkSession, path: str, tables: dict[str, Table]) -> dict[str, DataFrame]:
    """The document's tables that are known, typed by their schemas; absent ones are left out.

    A document is one value, so one task goes through it, but as a stream that cuts records out; they are stored, and
    parsed wherever they are read.
    """
    fs, at = file_system(spark, path)
    files = [f.getPath().toString() for f in fs.listStatus(at(path)) if f.getLen() and not f.getPath().getName().startswith(("_", "."))]
    if all(known_to_python(f) for f in files):
        documents = spark.createDataFrame([(f, None) for f in files], "path string, content binary")
    else:
        documents = spark.read.format("binaryFile").load(files).select("path", "content")
    records = kept(documents.mapInPandas(_split, "tbl string, record string"), "records")
    there = {r[0] for r in records.filter("record IS NULL").select("tbl").distinct().collect()}  # the document's tables
    schema = lambda t: T.StructType([T.StructField(c, k) for c, k in t.columns.items()])
    of = lambda name: records.filter((F.col("tbl") == name) & F.col("record").isNotNull())
    return {name: of(name).select(F.from_json("record", schema(t)).alias("r")).select("r.*") for name, t in tables.items() if name in there}


def read_valid_metadata(spark: SparkSession, folder: str, tables: dict[str, Table], dataset: str | None = None, force_valid: bool = True) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The one metadata document of a folder (and data set) with the rules that it breaks, as violations() gives them.

    force_valid: a broken rule or an absent table is an error.
    """
    names = [n for n in listed(spark, folder) if ".json" in n and "metadata" in n and (dataset is None or dataset in n)]
    if len(names) != 1:
        raise FileNotFoundError(f"{len(names)} metadata documents in {folder}")
    read = read_metadata(spark, f"{folder}/{names[0]}", tables)
    absent = [k for k in tables if k not in read]
    found = None
    for name, df in read.items():
        broken = violations(df, tables[name])
        found = broken if found is None else found.unionByName(broken)
    if force_valid and (absent or found is not None and not found.isEmpty()):
        raise SchemaError(f"the metadata document isn't valid; absent: {', '.join(absent) or 'none'}")
    return read, found


#: Fixed: the tables of a submission by part.
DATASET_TABLES = ["ds_data", "author_data", "funding_data", "relresource_data"]
SITE_TABLES = ["site_data", "tree_data", "woodpiece_data", "slide_data"]
IMAGE_TABLE = "roxas_data"


def read_submission(spark: SparkSession, path: str, tables: dict[str, Table]) -> tuple[DataFrame, dict[str, DataFrame], dict[str, DataFrame], list[str]]:
    """An unfinished submission: its image table, its dataset tables, its site tables (those there are), and warnings."""
    found, warnings = validated_document(read_metadata(spark, path, tables), tables, IMAGE_TABLE)
    part = lambda names: {k: v for k, v in found.items() if k in names}
    return found[IMAGE_TABLE], part(DATASET_TABLES), part(SITE_TABLES), warnings


def write_metadata(tables: dict[str, DataFrame], folder: str, dataset: str) -> str:
    """Writes one JSON object of the tables, each an array with a record a line, and gives its path.

    Tables are written by tasks, in the order of their partitions; the parts are then copied behind each other into one file,
    as bytes. No row holds a table, and the document is there whole or not at all.
    """
    spark = next(iter(tables.values())).sparkSession
    path = f"{folder}/{file_name_of(dataset)}_metadata.json"
    parts = new_folder(spark, "parts")
    for name, df in tables.items():
        record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        df.select(F.concat(F.lit(","), record).alias("value")).write.text(f"{parts}/{name}")
    fs, at = file_system(spark, path)
    source, part_at = file_system(spark, parts)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    unfinished = f"{path}.unfinished"
    out = fs.create(at(unfinished))
    put = lambda text: out.write(bytearray(text.encode()))
    for k, name in enumerate(tables):
        put(("{" if k == 0 else ",") + f"\n{json.dumps(name)} : [\n")
        files = sorted(f.getPath().toString() for f in source.globStatus(part_at(f"{parts}/{name}/part-*")) if f.getLen())
        for i, file in enumerate(files):
            stream = source.open(part_at(file))
            stream.seek(0 if i else 1)  # the first record has no comma before it
            copy(stream, out, _CHUNK, False)
            stream.close()
        put("]")
    put("\n}\n")
    out.close()
    fs.delete(at(path), True)
    fs.rename(at(unfinished), at(path))
    source.delete(part_at(parts), True)
    return path


#: Bytes of a table, eight a value, that are sorted at a time where the sink knows how its rows are spread.
ROUND_BYTES = 32 << 30
#: A row of so many, and values of a sort column at most, that stand for all of them where stretches are cut; no result hangs on them.
_ROWS_EACH, _STANDING = 64, 4096


def _stretches(rows: DataFrame, order: str, width: int) -> list[Column]:
    """Conditions that cut a table of so many columns into stretches of its first sort column, in order, each of about ROUND_BYTES. rows has that column of the table's rows."""
    name = order.removeprefix("-")
    counts = kept(rows.sample(1 / _ROWS_EACH, 7).groupBy(name).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = (counts.agg(F.sum("n")).first()[0] or 0) * _ROWS_EACH
    rounds = -(-total * width * 8 // ROUND_BYTES)
    c, found = F.col(name), counts.dropna().orderBy(F.xxhash64(name), name).limit(_STANDING).collect() if rounds > 1 else []
    cuts, share, seen = [], sum(r["n"] for r in found) / max(rounds, 1), 0
    for value, n in sorted(tuple(r) for r in found):
        if seen >= share * (len(cuts) + 1):
            cuts.append(value)
        seen += n
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    parts = [(F.lit(True) if lo is None else c >= lo) & (F.lit(True) if hi is None else c < hi) for lo, hi in (bounds[::-1] if order != name else bounds)]
    return [*parts[:-1], c.isNull() | parts[-1]]


def write_table(df: DataFrame, folder: str, dataset: str, kind: str, day: dt.date, compress: bool = False, order: list[str] | None = None, rows: DataFrame | None = None) -> str:
    """CSV named after the day, the data set and the kind; gzip if asked for; sorted by `order`, nulls last.

    Gzip is at its fastest level: at the usual one, compressing takes over half the time of writing cells. rows: the first sort column of
    df's rows, from where it costs little. With it a large table is written stretch by stretch, each of which reads what df is made of and shuffles its own rows
    only, so that the disk holds the table and one stretch, not all that was joined and sorted for it.
    """
    path = f"{folder}/{day:%Y%m%d}_{dataset}_{kind}.csv"

    def write(part: DataFrame, at: str) -> None:
        writer = (arranged(part, order) if order else part).write.mode("overwrite").option("header", True).option("nullValue", "NA")
        with shuffles_dropped(df.sparkSession):
            (writer.options(**FAST_GZIP) if compress else writer).csv(at)

    stretches = _stretches(rows, order[0], len(df.columns)) if order and rows is not None else []
    if len(stretches) < 2:
        write(df, path)
        return path
    fs, at = file_system(df.sparkSession, path)
    unfinished = f"{path}.unfinished"
    fs.delete(at(unfinished), True)
    fs.mkdirs(at(unfinished))
    for nr, stretch in enumerate(stretches):
        made = f"{unfinished}/_{nr}"
        write(df.filter(stretch), made)
        for name in listed(df.sparkSession, made):
            if name.startswith("part-"):  # in the order of the stretches, and in it of the parts
                fs.rename(at(f"{made}/{name}"), at(f"{unfinished}/part-{nr:05}-{name.removeprefix('part-')}"))
        fs.delete(at(made), True)
    fs.delete(at(path), True)
    fs.rename(at(unfinished), at(path))
    return path


def write_cells(cells: DataFrame, path: str) -> None:
    """Parquet in the order of images and years, for whole archives: later steps group by them and filters
    on images skip files and row groups. A folder for each image would be millions of them."""
    cells.repartitionByRange("image_label", "year").sortWithinPartitions("image_label", "year").write.mode("overwrite").parquet(path)
