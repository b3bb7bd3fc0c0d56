"""Queries that read what they or the archive wrote, and those on metadata tables; each with its DuckDB counterpart."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.operators import clean, flags, profiles, structure, tables, validate
from cambium.operators.model import CELL_MEASURES, RING_KEY, RING_MEASURES, require
from cambium.sources import documents
from cambium.sources import measurements as files
from cambium.sources.scratch import file_system, new_folder
from cambium.streaming import arrivals

from . import adapters, archive, registry
from .oracles import BOUNDARY, EDITED, INNER, LOG, MEASURED, YEARS, K, r, views

DAY = dt.date(2025, 1, 2)
NOW = dt.datetime(2025, 1, 1)
tidy = registry.tidy


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _file(spark: SparkSession, name: str, text: str) -> str:
    """A small file of its own in the shared folder."""
    path = new_folder(spark, name)
    fs, at = file_system(spark, path)
    stream = fs.create(at(path))
    stream.write(bytearray(text.encode()))
    stream.close()
    return path


def _base(c: str):
    return F.element_at(F.split(c, "/"), -1).alias(c)


# -- archive ------------------------------------------------------------------------------------


def found_sets(spark, d):
    sets = files.file_sets(files.found_files(spark, archive.folder(spark, d)))
    return sets.select("stem", *(_base(c) for c in ("fname_image", "fname_cells", "fname_rings", "fname_settings")))


def image_structure(spark, d):
    return archive.structure(spark, d).select("name", "site_label", "species_code", *structure.LABELS)


def load_cells(spark, d):
    return tidy(files.collect_cells(spark, archive.structure(spark, d))[0])


def load_rings(spark, d):
    return tidy(files.collect_rings(spark, archive.structure(spark, d))[0])


def load_failures(spark, d):
    data = archive.structure(spark, d)
    return data.join(files.collect_cells(spark, data)[1], "image_label").select("image_label", _base("fname_cells"), "problem")


def load_bundle(spark, d):
    data = archive.bundle(spark, d)
    counts = lambda df, name: df.groupBy("image_label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "image_label", "n")
    return counts(data.cells, "cells").unionByName(counts(data.rings, "rings"))


def _settings(spark, d, data):
    return files.collect_settings(spark, data)


def load_settings(spark, d):
    kept = ["configuration_file", "created_at", "sw_version", "software", "spatial_resolution", "origin_calibrated_x", "origin_calibrated_y", "meas_geometry", "circ_lower_limit", "outmost_year", "min_cell_area", "max_cell_area"]
    return _settings(spark, d, archive.structure(spark, d)).select(_base("fname_settings"), *kept)


def image_info(spark, d):
    data = archive.structure(spark, d)
    info = files.collect_image_info(spark, data)
    return info.select(_base("fname_image"), "img_filetype", "img_size", "img_width", "img_height")


def combined_metadata(spark, d):
    """Structure, images and settings joined, the file names last, as text lines of the columns' order and values."""
    data = archive.structure(spark, d)
    info = files.collect_image_info(spark, data)
    whole = structure.combine_metadata(data, info, _settings(spark, d, data))
    last = F.lit(",".join(whole.columns[-4:]))
    return whole.select("image_label", "woodpiece_label", "img_width", "meas_geometry", "outmost_year", _base("fname_image"), last.alias("last_columns"))


def streamed_counts(spark, d):
    out, folder = new_folder(spark, "arrived"), archive.folder(spark, d)
    if files.known_to_python(folder):
        arrivals.note_arrived(spark, folder, notes := new_folder(spark, "notes"))
        cells = arrivals.noted_cells(spark, notes)
    else:
        cells = arrivals.cell_stream(spark, folder)
    arrivals.count_arrived(arrivals.ring_counts(cells), out, new_folder(spark, "offsets"))
    return spark.read.parquet(out)


CELLS_OF_FILES = f"""images AS ({archive.oracle_images()}), of_files AS (
  SELECT i.image_label, i.stem, i.suppkey, c.* EXCLUDE (image_label, suppkey) FROM raw_cells c JOIN images i USING (suppkey) WHERE NOT {archive.UNREAD}
  UNION ALL BY NAME SELECT image_label, stem, suppkey, 1990 AS year FROM images WHERE {archive.SHORT} AND NOT {archive.UNREAD}
), rings_of_files AS (SELECT i.woodpiece_label, i.slide_label, i.image_label, g.* EXCLUDE (woodpiece_label, slide_label, image_label) FROM raw_rings g JOIN images i ON g.image_label = concat('I', i.suppkey))"""
NO_FILE = f"({archive.GONE} OR {archive.EMPTY})"
PROBLEM = f"CASE WHEN {NO_FILE} THEN 'no file' WHEN {archive.BROKEN} THEN 'no column {files.CELL_COLUMNS[-1]}' ELSE concat_ws('; ', CASE WHEN {archive.UNDATED} THEN 'no year' END, CASE WHEN {archive.SHORT} THEN 'short line' END) END"

# -- processed tables ---------------------------------------------------------------------------


def processed(part: str) -> Callable:
    """Writes both processed tables as CSV, sorted, and reads them back by folder and data set."""

    def run(spark, d):
        folder, raw = new_folder(spark, "processed"), registry._numbered(spark, d)
        data = clean.complete_cell_measures(raw)
        cells = data.cells.withColumn("sector100", F.col("sector100").cast("int"))
        documents.write_table(cells, folder, "demo", "cells", DAY, compress=True, order=["image_label", "year"], rows=raw.cells.select("image_label"))
        documents.write_table(data.rings, folder, "demo", "rings", DAY, order=["image_label", "year"])
        found = files.read_processed(spark, folder, "demo")
        if part == "rings":
            return tidy(found.rings.select("woodpiece_label", "slide_label", *RING_KEY, *RING_MEASURES, "eww", "lww"))
        return tidy(found.cells.select(*RING_KEY, "xpix", "ypix", "la", "rtsr", "tca", "cdratio", "sector100", "ew_lw"))

    return run


def profile_file(spark, d):
    prf = profiles.calculate_profiles(registry._clean(spark, d).cells, 5, ["la", "cwttan"], [0.5])
    return tidy(files.read_profiles(spark, documents.write_table(prf, new_folder(spark, "profiles"), "demo", "profiles", DAY, order=["image_label", "year", "sector_n"])))


def _edited(spark, d) -> tuple[DataFrame, DataFrame]:
    rings = flags.init_flags(registry._rings(spark, d))
    return rings, registry._edits(rings)


def edited_rings_file(spark, d):
    rings, edits = _edited(spark, d)
    path = documents.write_table(flags.apply_edits(rings, edits), new_folder(spark, "edited"), "demo", "rings", DAY, order=["woodpiece_label", "year"])
    return files.read_ring_flags(spark, path).select("woodpiece_label", "slide_label", *RING_KEY, "cno", "exclude_dupl", "exclude_issues", "comment")


def sorted_sink(spark, d):
    """Where each ring stands in the file that was written in order, among those of its woodpiece: by part and line, as the bytes are."""
    rings, edits = _edited(spark, d)
    path = documents.write_table(flags.apply_edits(rings, edits).select("woodpiece_label", *RING_KEY), new_folder(spark, "sorted"), "demo", "rings", DAY, order=["-woodpiece_label", "year", "image_label"])
    parts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("part"), F.posexplode(F.split("value", "\n")).alias("line", "text")).filter("line > 0 AND text <> ''")
    rows = parts.select("part", "line", F.from_csv("text", "woodpiece_label string, image_label string, year int").alias("r")).select("part", "line", "r.*")
    return tables.positions(rows, ["woodpiece_label"], ["part", "line"]).drop("part", "line")


def committed_rings(spark, d):
    rings, edits = _edited(spark, d)
    return flags.commit_edits(rings, edits, new_folder(spark, "committed")).select("woodpiece_label", *RING_KEY, "exclude_issues", "comment")


def undone_edits(spark, d):
    rings, edits = _edited(spark, d)
    return flags.apply_edits(rings, flags.undo_edits(edits, 1)).select("woodpiece_label", *RING_KEY, "exclude_issues", "comment")


def image_metadata_file(spark, d):
    whole = adapters.meta(spark, d).withColumn("fname_image", F.concat("image_label", F.lit(".jpg")))
    path = documents.write_table(whole, new_folder(spark, "images"), "demo", "metadata", DAY, order=["image_label"])
    return files.read_image_metadata(spark, path)


def named_table(spark, d):
    known = {"data": registry._clean(spark, d), "meta": adapters.meta(spark, d)}
    rings = tables.table_by_name(spark, "data$rings", known).select("image_label", "year")
    return rings.join(tables.table_by_name(spark, "meta", known).select("image_label", "site_label"), "image_label").unionByName(
        tables.table_by_name(spark, 'data[["cells"]]', known).select("image_label", "year", F.lit("cells").alias("site_label")).distinct()
    )


# -- metadata tables ----------------------------------------------------------------------------

SITE = validate.Table(
    "site_data",
    {"site_label": T.StringType(), "site_name": T.StringType(), "n_trees": T.LongType(), "longitude": T.DoubleType(), "latitude": T.DoubleType(), "country_code": T.StringType()},
    {"site_label": validate.Rule("character", required=True, unique=True), "n_trees": validate.Rule("numeric", minimum=1), "country_code": validate.Rule("autocomplete", title="Country")},
    ("site_label",),
)
SPECIES_TRAITS = ["species_name", "phylogenetic_group", "leaf_habit", "tree_ring_structure"]
TREE = validate.Table(
    "tree_data",
    {**dict.fromkeys(["tree_label", "site_label", "species_code", *SPECIES_TRAITS], T.StringType()), "n_woodpieces": T.LongType(), "dbh": T.DoubleType()},
    {"tree_label": validate.Rule("character", required=True), "dbh": validate.Rule("numeric", maximum=500)},
    ("tree_label",),
)
WOODPIECE = validate.Table("woodpiece_data", {"woodpiece_label": T.StringType(), "tree_label": T.StringType(), "n_slides": T.LongType(), "sampling_year": T.IntegerType()})
SLIDE = validate.Table("slide_data", {"slide_label": T.StringType(), "woodpiece_label": T.StringType(), "n_images": T.LongType(), "comment": T.StringType()})
ROXAS = validate.Table("roxas_data", dict.fromkeys(["image_label", "slide_label", "tree_label", "site_label"], T.StringType()), {}, ("image_label",))
DS = validate.Table("ds_data", dict.fromkeys(["ds_name", "description", "ds_access", "embargoed_until"], T.StringType()))
SCHEMAS = {t.name.removesuffix("_data"): t.columns for t in (SITE, TREE, WOODPIECE, SLIDE)}


def _species(spark) -> DataFrame:
    """Read from a reference file, of which only the known columns are taken."""
    lines = ["species_name,itrdb_species_code,phylogenetic_group,leaf_habit,tree_ring_structure,note", *(f"Species {k},SP{k},group {k % 2},habit {k},ring {k},x" for k in range(2))]
    return files.read_species(spark, _file(spark, "species", "\n".join(lines)))


def hierarchy_table(name: str) -> Callable:
    def run(spark, d):
        return structure.hierarchy_tables(adapters.meta(spark, d), SCHEMAS, _species(spark))[name]

    return run


def species_join(spark, d):
    """Traits of changed codes are filled in from the list; codes it hasn't keep their own."""
    trees = adapters.meta(spark, d).select("tree_label", "species_code").distinct().withColumn("species_name", F.concat(F.lit("own "), "tree_label"))
    return structure.enrich_species(trees, _species(spark)).select("tree_label", "species_code", *SPECIES_TRAITS)


def _sites(spark, d) -> DataFrame:
    """A site for each customer; some coordinates are out of range, no numbers or null."""
    k = F.col("c_custkey")
    lon = F.when(k % 17 == 0, "x").when(k % 19 == 0, F.lit(None)).otherwise(F.concat((k % 59).cast("string"), F.lit(".25")))
    lat = F.when(k % 23 == 0, "95.5").otherwise(F.concat((k % 37).cast("string"), F.lit(".75")))
    return _read(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("site_label"), lon.alias("longitude"), lat.alias("latitude"), F.lit("old").alias("country_code"))


SITES_SQL = """sites AS (SELECT 'C' || c_custkey AS site_label, CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN NULL ELSE c_custkey % 59 + 0.25 END::DOUBLE AS longitude,
  CASE WHEN c_custkey % 23 = 0 THEN 95.5 ELSE c_custkey % 37 + 0.75 END::DOUBLE AS latitude FROM customer)"""


def site_coordinates(spark, d):
    return structure.site_coordinates(_sites(spark, d))


def _polygons(spark) -> DataFrame:
    """Squares of ten degrees, with names AA to EC; one is unknown, and one of two parts."""
    square = lambda i, j: f"(({i}0 {j}0, {i + 1}0 {j}0, {i + 1}0 {j + 1}0, {i}0 {j + 1}0))"
    lines = ["code,wkt"]
    for i in range(5):
        for j in range(3):
            code = "-99" if (i, j) == (2, 1) else chr(65 + i) + chr(65 + j)
            if (i, j) != (4, 2):
                lines.append(f'{code},"{"MULTIPOLYGON" if (i, j) == (0, 2) else "POLYGON "}{"(" + square(0, 2) + ", " + square(4, 2) + ")" if (i, j) == (0, 2) else square(i, j)}"')
    return files.read_polygons(spark, _file(spark, "polygons", "\n".join(lines)))


def _countries(spark) -> DataFrame:
    rows = [f"Land {chr(65 + i)}{chr(65 + j)},{chr(65 + i)}{chr(65 + j)},Land {chr(65 + i)}{chr(65 + j)} ({chr(65 + i)}{chr(65 + j)})" for i in range(5) for j in range(3) if (i, j) != (1, 1)]
    return files.read_countries(spark, _file(spark, "countries", "\n".join(["country_name,country_iso_code,combined", "Namibia,NA,Namibia (NA)", *rows])))


def country_names(spark, d):
    return structure.with_country_names(_sites(spark, d), _polygons(spark), _countries(spark))


def country_list(spark, d):
    """Each nation's name looked up by a code: the code NA is a value, unknown codes have no name."""
    code = F.when(F.col("n_nationkey") == 7, "NA").otherwise(F.concat(F.expr("chr(65 + n_nationkey % 6)"), F.expr("chr(65 + n_nationkey % 4)")))
    return _read(spark, d, "nation").select("n_name", code.alias("country_iso_code")).join(_countries(spark), "country_iso_code", "left").select("n_name", "country_iso_code", "country_name", "combined")


def raw_metadata_table(spark, d):
    """A table without any schema, read as text and aligned: cast, padded and in order."""
    raw = _read(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("site_label"), (F.col("c_custkey") % 40).cast("string").alias("latitude"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise("7.9").alias("n_trees"), F.lit("no").alias("more"))
    path = documents.write_table(raw, new_folder(spark, "raw"), "demo", "site", DAY)
    return files.read_raw_table(spark, path, SITE)[0]


def _document(spark, d) -> tuple[str, str, dict[str, validate.Table]]:
    meta = adapters.meta(spark, d)
    site, tree = (structure.hierarchy_tables(meta, SCHEMAS, _species(spark))[n] for n in ("site", "tree"))
    ds = spark.createDataFrame([("a b", "text", "restricted", None)], "ds_name string, description string, ds_access string, embargoed_until string")
    folder = new_folder(spark, "documents")
    path = documents.write_metadata({"roxas_data": structure.padded(meta, ROXAS.columns), "site_data": site, "tree_data": tree, "ds_data": ds}, folder, "demo set")
    return folder, path, {t.name: t for t in (ROXAS, SITE, TREE, DS, WOODPIECE)}


def metadata_document(spark, d):
    folder, _, known = _document(spark, d)
    del known["woodpiece_data"]
    read, _ = documents.read_valid_metadata(spark, folder, known, "demo_set")
    return read["tree_data"].select("tree_label", "site_label", "species_code", "species_name", "n_woodpieces").unionByName(read["site_data"].select(F.lit(None).alias("tree_label"), "site_label", F.lit(None).alias("species_code"), F.lit(None).alias("species_name"), F.col("n_trees").alias("n_woodpieces")))


def document_rules(spark, d):
    """What a document breaks where validity isn't forced."""
    folder, _, known = _document(spark, d)
    strict = validate.Table("site_data", SITE.columns, {"n_trees": validate.Rule("numeric", minimum=1000), "site_name": validate.Rule("text", required=True)})
    return documents.read_valid_metadata(spark, folder, known | {"site_data": strict}, force_valid=False)[1]


def submission_parts(spark, d):
    _, path, known = _document(spark, d)
    images, dataset, site, warnings = documents.read_submission(spark, path, known)
    parts = {"image": {"roxas_data": images}, "dataset": dataset, "site": site}
    found = tables.bind_named({f"{part}/{name}": df.agg(F.count(F.lit(1)).alias("n")) for part, held in parts.items() for name, df in held.items()}, "part")
    return found.unionByName(spark.createDataFrame([(w, 0) for w in warnings], "part string, n long"))


def _schemas(spark) -> str:
    """A folder of schema files: a base, an old and a new version that extends the base."""
    folder = new_folder(spark, "schemas")
    fs, at = file_system(spark, folder)
    base = {"type": "array", "items": {"type": "object", "properties": {"label": {"type": "string"}, "n": {"type": ["integer", "null"], "minimum": 1}, "day": {"type": "string", "format": "date"}, "on": {"type": "boolean"}}, "required": ["label"]}}
    more = {"allOf": [{"$ref": "base.json"}, {"items": {"properties": {"label": {"unique": True, "title": "Label"}, "size": {"type": "number"}, "code": {"unique": True, "htType": "text"}}}}]}
    for name, node in {"base.json": base, "20240101_site_schema.json": {"items": {"properties": {}}}, "20250101_site_schema.json": more}.items():
        stream = fs.create(at(f"{folder}/{name}"))
        stream.write(bytearray(json.dumps(node).encode()))
        stream.close()
    return folder


def schema_rules(spark, d):
    """Customers under the latest schema of a folder, its references resolved: for each field the values that its type keeps, and what is broken."""
    table = validate.table_of("site", validate.resolve_schema(validate.latest_schema(_schemas(spark), "site", spark), spark))
    k = F.col("c_custkey")
    raw = _read(spark, d, "customer").select(
        F.when(k % 100 == 0, "").otherwise(F.concat(F.lit("C"), k % 1400)).alias("label"), F.when(k % 9 == 0, "x").otherwise((k % 50).cast("string")).alias("n"), F.when(k % 4 == 0, "2020-02-30").otherwise("2020-02-28").alias("day"),
        F.when(k % 3 == 0, "yes please").otherwise("true").alias("on"), F.col("c_acctbal").cast("string").alias("size"), F.concat(F.lit("K"), k).alias("code"),
    )
    aligned, _ = validate.align_to_schema(raw, table)
    kept_values = aligned.agg(*(F.count(c).alias(c) for c in table.columns)).unpivot([], list(table.columns), "field", "n_values")
    titles = F.create_map(*(F.lit(x) for c, rule in table.rules.items() for x in (c, rule.title or c)))
    return kept_values.withColumn("field", titles[F.col("field")]).join(validate.violations(raw, table).drop("tbl"), "field", "left")


def empty_tables(spark, d):
    """Trees, with a dummy row for the submission that has no known column, and two for one without any row."""
    trees = structure.hierarchy_tables(adapters.meta(spark, d), SCHEMAS, _species(spark))["tree"]
    odd, _ = validate.validated_table(_read(spark, d, "customer").select("c_name"), TREE, force_required=False)
    return trees.unionByName(odd).unionByName(validate.empty_table(spark, TREE, 2)).unionByName(validate.empty_table(spark, TREE)).select("tree_label", "site_label", "n_woodpieces", "dbh")


def checked_calls(spark, d):
    """Which calls are refused (wrong columns, names, bundles and years), and how many rows the others give."""
    data, out = registry._raw(spark, d), []
    calls = {
        "missing measure": lambda: clean.without_negatives(data.cells.drop("la"), CELL_MEASURES),
        "all there": lambda: clean.without_negatives(data.cells, CELL_MEASURES).filter("raddistr IS NULL"),
        "year not whole": lambda: clean.complete_years(registry._log(spark, d).withColumn("year", F.col("year").cast("double"))),
        "years whole": lambda: clean.complete_years(registry._log(spark, d)),
        "unknown method": lambda: profiles.chronology_mean(data.rings.withColumn("exclude_issues", F.lit(False)), "mrw", method="other"),
        "known method": lambda: profiles.chronology_mean(data.rings.withColumn("exclude_issues", F.lit(False)), "mrw"),
        "site given twice": lambda: structure.structure_from_names(registry._names(spark, d), site="X"),
        "no such table": lambda: tables.table_by_name(spark, "data$other", {"data": data}),
        "such a table": lambda: tables.table_by_name(spark, "data$rings", {"data": data}),
        "not a name": lambda: tables.table_by_name(spark, "a b"),
        "no labels": lambda: flags.ring_table_issues(data.cells),
    }
    for name, call in calls.items():
        try:
            out.append(call().select(F.lit(name).alias("call"), F.lit(False).alias("refused"), F.lit(1).alias("row")))
        except ValueError:
            out.append(spark.range(1).select(F.lit(name).alias("call"), F.lit(True).alias("refused"), F.lit(None).cast("int").alias("row")))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.groupBy("call", "refused").agg(F.count("row").alias("n_rows"))


AUTHOR = validate.Table("author_data", {"author_nr": T.LongType(), "name": T.StringType()}, {"author_nr": validate.Rule("numeric", others=("valid_seq",))})
RELATED = validate.Table("relresource_data", {"doi": T.StringType(), "rel_ds_label": T.StringType()}, {"doi": validate.Rule("character", others=("check_doi",), title="DOI"), "rel_ds_label": validate.Rule("character", others=("check_dsid",))})


def declared_checks(spark, d):
    """Nations as sites, customers as trees, orders as woodpieces, suppliers as authors and parts as related works, with faults in each."""
    k = F.col("n_nationkey")
    customers = _read(spark, d, "customer").withColumn("site_label", F.when(F.col("c_custkey") % 97 == 0, "N99").otherwise(F.concat(F.lit("N"), "c_nationkey")))
    counted = customers.groupBy("site_label").agg(F.count("*").alias("n_trees"))
    named = _read(spark, d, "nation").withColumn("site_label", F.concat(F.lit("N"), k))
    place = {"longitude": (k * 2 + 0.25).cast("string"), "latitude": (k + 0.75).cast("string")}
    right = F.concat(F.expr("chr(cast(65 + floor((n_nationkey * 2 + 0.25) / 10) AS int))"), F.expr("chr(cast(65 + floor((n_nationkey + 0.75) / 10) AS int))"))
    sites = named.join(counted, "site_label", "left").withColumns(place).select("site_label", (F.col("n_trees") + (k % 5 == 0).cast("int")).alias("n_trees"), "longitude", "latitude", F.when(k % 7 == 0, "XX").otherwise(F.concat(F.lit("Land ("), right, F.lit(")"))).alias("country_code"))
    species = lambda c: F.when(F.col("c_custkey") % 11 == 0, "wrong").otherwise(c)
    trees = customers.select(
        F.concat(F.lit("T"), "c_custkey").alias("tree_label"), "site_label", F.concat(F.lit("SP"), F.col("c_custkey") % 3).alias("species_code"), species(F.concat(F.lit("Species "), F.col("c_custkey") % 3)).alias("species_name"),
        F.when(F.col("c_custkey") % 13 == 0, "").otherwise(F.concat(F.lit("habit "), F.col("c_custkey") % 3)).alias("leaf_habit"), F.lit(10).cast("long").alias("n_woodpieces"),
    )
    pieces = _read(spark, d, "orders").select(F.concat(F.lit("T"), F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 10_000_000).otherwise(0)).alias("tree_label"), F.concat(F.lit("P"), "o_orderkey").alias("woodpiece_label"))
    authors = _read(spark, d, "supplier").select((F.col("s_suppkey") + (F.col("s_suppkey") > 50).cast("int")).alias("author_nr"))
    p = F.col("p_partkey")
    related = _read(spark, d, "part").select(F.when(p % 5 == 0, F.concat(F.lit("10.12/"), p)).when(p % 7 == 0, "").otherwise(F.concat(F.when(p % 2 == 0, "https://doi.org/").otherwise(""), F.lit("10.1234/part."), p)).alias("doi"), F.concat(F.lit("DS"), p % 10).alias("rel_ds_label"))
    label = lambda *others: validate.Rule("character", others=others)
    known = {
        "site_data": validate.Table("site_data", SITE.columns, {"n_trees": validate.Rule("numeric", others=("check_counts",)), "country_code": validate.Rule("autocomplete", title="Country", others=("check_coords",))}),
        "tree_data": validate.Table("tree_data", TREE.columns, {"site_label": label("valid_label"), "n_woodpieces": validate.Rule("numeric", others=("check_counts",)), "species_name": label("check_speciescode"), "leaf_habit": label("check_speciescode")}),
        "woodpiece_data": validate.Table("woodpiece_data", WOODPIECE.columns, {"tree_label": label("valid_label")}), "author_data": AUTHOR, "relresource_data": RELATED,
    }
    data = {"site_data": sites, "tree_data": trees, "woodpiece_data": pieces, "author_data": authors, "relresource_data": related}
    squares = registry.squares(spark)
    return validate.declared_problems(data, known, _species(spark), squares, spark.range(8).select(F.concat(F.lit("DS"), "id").alias("label")))


def cleaned_names(spark, d):
    """A table with odd column names, tidied and aligned."""
    raw = _read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("Tree Label"), F.lit("4.9").alias("nWoodpieces"), F.col("c_acctbal").cast("string").alias(" dbh "))
    return tidy(validate.validated_table(raw, TREE)[0].select("tree_label", "n_woodpieces", "dbh"))


def arranged_rings(spark, d):
    """Each ring's place in its woodpiece's plot: images from the last to the first, years rising."""
    return tables.positions(registry._rings(spark, d).select("woodpiece_label", *RING_KEY), ["woodpiece_label"], ["-image_label", "year"])


def dating_report(spark, d):
    """The first nine issues as they are reported, in order."""
    issues = clean.dating_issues(registry._log(spark, d), adapters.meta(spark, d), registry.YEAR)
    return spark.createDataFrame(list(enumerate(clean.dating_lines(issues), 1)), "nr int, line string")


def sampled_images(spark, d):
    return tables.slice_sample(adapters.meta(spark, d).select("image_label", "woodpiece_label"), 10, "image_label", seed=3)


def bound_tables(spark, d):
    two = {"nations": _read(spark, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), "regions": _read(spark, d, "region").select(F.col("r_name").alias("name"))}
    return tables.bind_named(two, "search_terms")


def option_violations(spark, d):
    customers = _read(spark, d, "customer").select(F.col("c_mktsegment").alias("country_code"), F.col("c_name").alias("site_label"))
    segments = _read(spark, d, "customer").select("c_mktsegment").distinct()
    some, every = validate.Table("some", {}, SITE.rules), validate.Table("every", {}, SITE.rules)
    return validate.option_violations(customers, some, {"country_code": segments.filter("c_mktsegment <> 'BUILDING'")}).unionByName(validate.option_violations(customers, every, {"country_code": segments}))


def date_violations(spark, d):
    orders = _read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("good"), F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise("2020-01-01").alias("bad"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("2020-01-01").alias("blank"))
    return validate.violations(orders, validate.Table("orders", {}, {c: validate.Rule("date", required=True) for c in ("good", "bad", "blank")}))


def settings_dates(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss")).when(k % 5 == 1, F.date_format("o_orderdate", "d/M/yyyy HH:mm")).when(k % 5 == 2, "01.02.2099 00:00:00").when(k % 5 == 3, "2021-02-03").otherwise(F.lit(None))
    return structure.parsed_dates(_read(spark, d, "orders").select("o_orderkey", text.alias("created_at")), "created_at", NOW)


def name_problems(spark, d):
    names = registry._names(spark, d)
    return structure.structure_problems(structure.structure_from_names(names.unionByName(names.filter("name LIKE '%1.jpg'").withColumn("name", F.concat(F.lit("copy/"), "name")))))


def dataset_rules(spark, d):
    k = F.col("c_custkey")
    ds = _read(spark, d, "customer").select(
        "c_custkey", F.when(k % 11 == 0, "").when(k % 13 == 0, F.repeat(F.lit("n"), 65)).otherwise(F.col("c_name")).alias("ds_name"),
        F.when(k % 7 == 0, "[ADD INFO here]").when(k % 17 == 0, F.lit(None)).otherwise("text").alias("description"),
        F.when(k % 2 == 0, "restricted").otherwise("public").alias("ds_access"), F.when(k % 3 == 0, "2030-01-01").when(k % 10 == 0, "soon").alias("embargoed_until"),
    )
    return validate.dataset_problems(ds).groupBy("field", "message").agg(F.count(F.lit(1)).alias("n"))


def label_orphans(spark, d):
    """Customers' nations that no supplier has, and regions whose declared number of nations isn't so."""
    nations = _read(spark, d, "nation")
    lost = validate.orphans(_read(spark, d, "customer").select(F.col("c_nationkey").alias("key")), _read(spark, d, "supplier").filter("s_nationkey % 2 = 0").select(F.col("s_nationkey").alias("key")), "key")
    wrong = validate.count_mismatches(_read(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.lit(5).cast("long").alias("declared")), nations.filter("n_nationkey <> 3").select(F.col("n_regionkey").alias("key")), "key", "declared")
    return tables.bind_named({"orphans": lost, "counts": wrong}, "check")


def ring_kinds(spark, d):
    chosen = flags.duplicate_selection(registry._rings(spark, d))
    return flags.ring_table_issues(chosen.withColumns({"year": F.col("year").cast("string"), "other_issues": F.lit(0)}))


def file_names(spark, d):
    names = _read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, " -_").otherwise(F.concat(F.lit(" _x/"), "p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand")).alias("name"))
    return names.select("p_partkey", structure.file_name_column(F.col("name")).alias("file_name"))


def readable_patterns(spark, d):
    """How many names each pattern fits, beside the pattern as it is shown."""
    names, out = registry._names(spark, d), None
    for pattern in (structure.DEFAULT_PATTERN, "(?<site>SITE[:digit:])_(?<species>PCAB)_(?<tree>[:alnum:]+)_(?<image>[:digit:]+)"):
        fits = structure.structure_from_names(names, pattern).agg(F.count("matched").alias("n_fit"), F.count_if(F.col("matched").isNull()).alias("n_not"))
        part = fits.select(F.lit(structure.readable(pattern)).alias("shown"), "n_fit", "n_not")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "found_sets": found_sets, "image_structure": image_structure, "load_cells": load_cells, "load_rings": load_rings, "load_failures": load_failures, "load_bundle": load_bundle,
    "load_settings": load_settings, "image_info": image_info, "combined_metadata": combined_metadata, "streamed_counts": streamed_counts,
    "processed_cells": processed("cells"), "processed_rings": processed("rings"), "profile_file": profile_file, "edited_rings_file": edited_rings_file,
    "sorted_sink": sorted_sink, "committed_rings": committed_rings, "undone_edits": undone_edits, "image_metadata_file": image_metadata_file, "named_table": named_table,
    "site_table": hierarchy_table("site"), "tree_table": hierarchy_table("tree"), "woodpiece_table": hierarchy_table("woodpiece"), "slide_table": hierarchy_table("slide"),
    "species_join": species_join, "site_coordinates": site_coordinates, "country_names": country_names, "country_list": country_list,
    "raw_metadata_table": raw_metadata_table, "metadata_document": metadata_document, "document_rules": document_rules, "submission_parts": submission_parts,
    "schema_rules": schema_rules, "empty_tables": empty_tables, "checked_calls": checked_calls, "declared_checks": declared_checks, "cleaned_names": cleaned_names, "arranged_rings": arranged_rings,
    "dating_report": dating_report, "sampled_images": sampled_images, "bound_tables": bound_tables, "unknown_options": option_violations, "date_violations": date_violations,
    "settings_dates": settings_dates, "name_problems": name_problems, "dataset_rules": dataset_rules, "label_orphans": label_orphans, "ring_kinds": ring_kinds,
    "file_names": file_names, "readable_patterns": readable_patterns,
}


# -- the same in DuckDB -------------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    archived = views(CELLS_OF_FILES)
    images = f"WITH images AS ({archive.oracle_images()}) "
    edited, meta = views(LOG, INNER, EDITED), views()
    rings = ", ".join(r(c, c) for c in RING_MEASURES)
    species = """species AS (SELECT 'SP' || k AS species_code, 'Species ' || k AS species_name, 'group ' || (k % 2) AS phylogenetic_group, 'habit ' || k AS leaf_habit, 'ring ' || k AS tree_ring_structure FROM range(2) t(k))"""
    distinct = lambda c: f"(count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END)::BIGINT"
    site = f"site AS (SELECT site_label, {distinct('tree_label')} AS n_trees FROM meta GROUP BY 1)"
    tree = f"tree AS (SELECT t.*, s.* EXCLUDE (species_code) FROM (SELECT site_label, species_code, tree_label, {distinct('woodpiece_label')} AS n_woodpieces FROM meta GROUP BY ALL) t LEFT JOIN species s USING (species_code))"
    square = "CASE WHEN longitude >= 0 AND longitude < 50 AND latitude >= 0 AND latitude < 30 THEN floor(longitude / 10)::INT * 3 + floor(latitude / 10)::INT END"
    part = "concat(' _x/', p_name, ' ', p_type, ' ', p_brand)"
    names = """names AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN concat('scan ', p_partkey)
      WHEN p_partkey % 3 = 0 THEN printf('dir/SITE%d_PISY_%02d_%d_%d.jpg', p_partkey % 5, p_partkey % 90, p_partkey % 7, p_partkey)
      ELSE printf('SITE%d_PCAB_%02d%s_%d_%d.jpg', p_partkey % 5, p_partkey % 90, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'AB' END, p_partkey % 7, p_partkey) END AS name FROM part)"""
    flag = lambda on, field, message: f"SELECT '{field}' AS field, '{message}' AS message, count(*) FILTER (WHERE {on}) AS n FROM ds"
    return {
        "found_sets": images + f"SELECT stem, stem || '.jpg' AS fname_image, CASE WHEN NOT {NO_FILE} THEN stem || '_Output_Cells.txt' END AS fname_cells, stem || '_Output_Rings.txt' AS fname_rings, stem || '_ROXAS_Settings.txt' AS fname_settings FROM images",
        "image_structure": images + "SELECT stem AS name, split_part(stem, '_', 1) AS site_label, 'PISY' AS species_code, tree_label, woodpiece_label, slide_label, image_label FROM images",
        "load_cells": archived + f"SELECT image_label, year, {', '.join(r(f'{c}::DOUBLE', c) for c in ['xpix', 'ypix', *CELL_MEASURES])} FROM of_files",
        "load_rings": archived + f"SELECT woodpiece_label, slide_label, image_label, year, {rings} FROM rings_of_files",
        "load_failures": images + f"SELECT * FROM (SELECT image_label, CASE WHEN NOT {NO_FILE} THEN stem || '_Output_Cells.txt' END AS fname_cells, {PROBLEM} AS problem FROM images) WHERE problem <> ''",
        "load_bundle": archived + "SELECT 'cells' AS tbl, image_label, count(*) AS n FROM of_files GROUP BY ALL UNION ALL SELECT 'rings', image_label, count(*) FROM rings_of_files GROUP BY ALL",
        "load_settings": images + """SELECT stem || '_ROXAS_Settings.txt' AS fname_settings, 'conf' || suppkey AS configuration_file, '03.02.2021 10:11:12' AS created_at, '3.0.' || (suppkey % 4) AS sw_version, 'ROXAS' AS software,
            2.27::DOUBLE AS spatial_resolution, suppkey + 0.5::DOUBLE AS origin_calibrated_x, (suppkey % 7)::DOUBLE AS origin_calibrated_y, CASE suppkey % 2 WHEN 1 THEN 'linear' ELSE 'circular' END AS meas_geometry,
            (suppkey % 100)::INT AS circ_lower_limit, (1990 + suppkey % 30)::INT AS outmost_year, (suppkey % 50)::INT AS min_cell_area, NULL::INT AS max_cell_area FROM images""",
        "image_info": images + f"SELECT stem || '.jpg' AS fname_image, 'JPEG' AS img_filetype, {len(archive.jpeg(1, 1))}::BIGINT AS img_size, (100 + suppkey % 900)::INT AS img_width, (200 + suppkey % 700)::INT AS img_height FROM images",
        "combined_metadata": images + "SELECT image_label, woodpiece_label, (100 + suppkey % 900)::INT AS img_width, CASE suppkey % 2 WHEN 1 THEN 'linear' ELSE 'circular' END AS meas_geometry, (1990 + suppkey % 30)::INT AS outmost_year, stem || '.jpg' AS fname_image, 'fname_settings,fname_image,fname_cells,fname_rings' AS last_columns FROM images",
        "streamed_counts": archived + "SELECT stem, year, count(*) AS cno FROM of_files GROUP BY ALL",
        "processed_cells": views(MEASURED, BOUNDARY) + f"SELECT {K}, xpix::INT AS xpix, ypix::INT AS ypix, {r('la', 'la')}, {r('rtsr', 'rtsr')}, {r('tca', 'tca')}, {r('cdratio', 'cdratio')}, sector100, CASE WHEN sector100 IS NULL OR max_ew_sector IS NULL THEN NULL WHEN sector100 <= max_ew_sector THEN 'EW' ELSE 'LW' END AS ew_lw FROM measured LEFT JOIN boundary USING ({K})",
        "processed_rings": views(MEASURED, BOUNDARY) + f"SELECT woodpiece_label, slide_label, {K}, {rings}, {r('eww', 'eww')}, {r('lww', 'lww')} FROM rings LEFT JOIN boundary USING ({K})",
        "profile_file": views() + f"SELECT {K}, sector_n, {r('avg(la)', 'la_mean')}, {r('avg(cwttan)', 'cwttan_mean')}, {r('quantile_cont(la, 0.5)', 'la_q50')}, {r('quantile_cont(cwttan, 0.5)', 'cwttan_q50')} FROM (SELECT *, CASE WHEN rraddistr > 100 AND rraddistr <= 101 THEN 5 WHEN rraddistr BETWEEN 0 AND 100 THEN greatest(ceil(rraddistr / 20), 1)::INT END AS sector_n FROM cells) WHERE sector_n IS NOT NULL GROUP BY {K}, sector_n",
        "edited_rings_file": edited + f"SELECT woodpiece_label, slide_label, {K}, cno, exclude_dupl, exclude_issues, comment FROM edited",
        "sorted_sink": edited + f"SELECT woodpiece_label, {K}, row_number() OVER (PARTITION BY woodpiece_label ORDER BY year, image_label)::INT AS position FROM edited",
        "committed_rings": edited + f"SELECT woodpiece_label, {K}, exclude_issues, comment FROM edited",
        "undone_edits": edited + f"SELECT woodpiece_label, {K}, exclude_issues, CASE WHEN comment IS NOT NULL THEN 'checked' END AS comment FROM edited",
        "image_metadata_file": meta + "SELECT image_label, slide_label, woodpiece_label, tree_label, site_label, species_code, printf('%.1f', spatial_resolution) AS spatial_resolution, outmost_year::VARCHAR AS outmost_year, image_label || '.jpg' AS fname_image FROM meta",
        "named_table": meta + "SELECT image_label, year, site_label FROM rings JOIN (SELECT image_label, site_label FROM meta) USING (image_label) UNION ALL SELECT DISTINCT image_label, year, 'cells' FROM cells",
        "site_table": views(site) + "SELECT site_label, NULL::VARCHAR AS site_name, n_trees, NULL::DOUBLE AS longitude, NULL::DOUBLE AS latitude, NULL::VARCHAR AS country_code FROM site",
        "tree_table": views(species, tree) + "SELECT tree_label, site_label, species_code, species_name, phylogenetic_group, leaf_habit, tree_ring_structure, n_woodpieces, NULL::DOUBLE AS dbh FROM tree",
        "woodpiece_table": views() + f"SELECT woodpiece_label, tree_label, {distinct('slide_label')} AS n_slides, NULL::INT AS sampling_year FROM meta GROUP BY woodpiece_label, tree_label",
        "slide_table": views() + f"SELECT slide_label, woodpiece_label, {distinct('image_label')} AS n_images, NULL::VARCHAR AS comment FROM meta GROUP BY slide_label, woodpiece_label",
        "species_join": views(species) + "SELECT tree_label, species_code, coalesce(species_name, 'own ' || tree_label) AS species_name, phylogenetic_group, leaf_habit, tree_ring_structure FROM (SELECT DISTINCT tree_label, species_code FROM meta) LEFT JOIN species USING (species_code)",
        "site_coordinates": f"WITH {SITES_SQL} SELECT DISTINCT longitude, latitude FROM sites WHERE longitude IS NOT NULL AND latitude <= 90",
        "country_names": f"""WITH {SITES_SQL}, s AS (SELECT *, {square} AS nr FROM sites), n AS (SELECT *, CASE WHEN nr = 14 THEN 'AC' WHEN nr = 7 OR nr IS NULL OR nr = 4 THEN '' ELSE chr(65 + nr // 3) || chr(65 + nr % 3) END AS code FROM s)
            SELECT site_label, longitude, latitude, CASE WHEN longitude IS NULL OR latitude > 90 THEN NULL WHEN code = '' THEN '' ELSE 'Land ' || code || ' (' || code || ')' END AS country_code FROM n""",
        "country_list": """WITH c AS (SELECT chr((65 + i)::INT) || chr((65 + j)::INT) AS c, i, j FROM range(5) a(i), range(3) b(j)), known AS (
              SELECT 'Land ' || c AS country_name, c AS country_iso_code, 'Land ' || c || ' (' || c || ')' AS combined FROM c WHERE NOT (i = 1 AND j = 1) UNION ALL SELECT 'Namibia', 'NA', 'Namibia (NA)')
            SELECT n_name, country_iso_code, country_name, combined FROM (SELECT n_name, CASE n_nationkey WHEN 7 THEN 'NA' ELSE chr(65 + n_nationkey::INT % 6) || chr(65 + n_nationkey::INT % 4) END AS country_iso_code FROM nation) LEFT JOIN known USING (country_iso_code)""",
        "raw_metadata_table": "SELECT 'C' || c_custkey AS site_label, NULL::VARCHAR AS site_name, CASE WHEN c_custkey % 3 <> 0 THEN 7 END::BIGINT AS n_trees, NULL::DOUBLE AS longitude, (c_custkey % 40)::DOUBLE AS latitude, NULL::VARCHAR AS country_code FROM customer",
        "metadata_document": views(species, site, tree) + "SELECT tree_label, site_label, species_code, species_name, n_woodpieces FROM tree UNION ALL SELECT NULL, site_label, NULL, NULL, n_trees FROM site",
        "document_rules": "SELECT 'site_data' AS tbl, 'n_trees' AS field, 'error' AS severity, 'Out of range values' AS message UNION ALL SELECT 'site_data', 'site_name', 'error', 'Required'",
        "submission_parts": views(species, site, tree) + "SELECT 'image/roxas_data' AS part, count(*) AS n FROM meta UNION ALL SELECT 'dataset/ds_data', 1 UNION ALL SELECT 'site/site_data', count(*) FROM site UNION ALL SELECT 'site/tree_data', count(*) FROM tree UNION ALL SELECT 'missing tables: woodpiece_data', 0",
        "schema_rules": """WITH c AS (SELECT CASE WHEN c_custkey % 100 = 0 THEN '' ELSE 'C' || (c_custkey % 1400) END AS label, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 50 END AS n, c_custkey FROM customer)
            SELECT 'Label' AS field, count(*) AS n_values, CASE WHEN count(label) FILTER (WHERE label <> '') > count(DISTINCT label) FILTER (WHERE label <> '') THEN 'Required, Non-unique values' ELSE 'Required' END AS message, 'error' AS severity FROM c
            UNION ALL SELECT 'n', count(n), 'Out of range values', 'error' FROM c UNION ALL SELECT 'day', count(*) FILTER (WHERE c_custkey % 4 <> 0), 'Invalid date formats', 'warning' FROM c
            UNION ALL SELECT 'on', count(*) FILTER (WHERE c_custkey % 3 <> 0), NULL, NULL FROM c UNION ALL SELECT 'size', count(*), NULL, NULL FROM c UNION ALL SELECT 'code', count(*), NULL, NULL FROM c""",
        "empty_tables": views(species, tree) + "SELECT tree_label, site_label, n_woodpieces, NULL::DOUBLE AS dbh FROM tree UNION ALL SELECT '', '', NULL, NULL FROM range(3)",
        "checked_calls": views(LOG, YEARS) + f"""SELECT * FROM (VALUES ('missing measure', true, 0), ('year not whole', true, 0), ('unknown method', true, 0), ('site given twice', true, 0), ('no such table', true, 0), ('not a name', true, 0), ('no labels', true, 0)) v(call, refused, n_rows)
            UNION ALL SELECT 'all there', false, count(*) FROM raw_cells WHERE raddistr IS NULL OR raddistr < 0 UNION ALL SELECT 'such a table', false, count(*) FROM raw_rings UNION ALL SELECT 'known method', false, count(DISTINCT year) FROM raw_rings
            UNION ALL SELECT 'years whole', false, count(*) FROM years""",
        "declared_checks": """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'N99' ELSE 'N' || c_nationkey END AS site_label FROM customer), o AS (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS tree, count(*) AS n FROM orders GROUP BY 1), r AS (
              SELECT 'site_data' AS tbl, 'n_trees' AS field, 'Wrong counts' AS message, (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 0 AND 'N' || n_nationkey IN (SELECT site_label FROM t)) AS n
              UNION ALL SELECT 'site_data', 'Country', 'Outside the country', (SELECT count(*) FROM nation WHERE n_nationkey % 7 = 0)
              UNION ALL SELECT 'tree_data', 'site_label', 'Unknown labels', (SELECT count(*) FROM t WHERE site_label = 'N99')
              UNION ALL SELECT 'tree_data', 'n_woodpieces', 'Wrong counts', (SELECT count(*) FROM t LEFT JOIN o ON tree = c_custkey WHERE coalesce(o.n, 0) <> 10)
              UNION ALL SELECT 'tree_data', 'species_name', 'Not the species'' value', (SELECT count(*) FROM t WHERE c_custkey % 11 = 0 OR c_custkey % 3 = 2)
              UNION ALL SELECT 'tree_data', 'leaf_habit', 'Not the species'' value', (SELECT count(*) FROM t WHERE c_custkey % 13 <> 0 AND c_custkey % 3 = 2)
              UNION ALL SELECT 'woodpiece_data', 'tree_label', 'Unknown labels', (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer))
              UNION ALL SELECT 'author_data', 'author_nr', 'Invalid sequence', (SELECT CASE WHEN count(*) > 50 THEN 1 ELSE 0 END FROM supplier)
              UNION ALL SELECT 'relresource_data', 'DOI', 'Invalid DOI', (SELECT count(*) FROM part WHERE p_partkey % 5 = 0)
              UNION ALL SELECT 'relresource_data', 'rel_ds_label', 'Unknown labels', (SELECT count(*) FROM part WHERE p_partkey % 10 > 7))
            SELECT * FROM r WHERE n > 0""",
        "cleaned_names": f"SELECT c_custkey::VARCHAR AS tree_label, 4::BIGINT AS n_woodpieces, {r('c_acctbal', 'dbh')} FROM customer",
        "arranged_rings": views(LOG, INNER) + f"SELECT woodpiece_label, {K}, row_number() OVER (PARTITION BY woodpiece_label ORDER BY image_label DESC NULLS LAST, year)::INT AS position FROM valid",
        "dating_report": "WITH i AS (" + registry.oracles.oracle_sql()["dating_issues"] + "), n AS (SELECT *, row_number() OVER (ORDER BY image_label, year) AS nr FROM i) SELECT nr::INT AS nr, CASE WHEN nr = 10 THEN '...' ELSE image_label || ', ' || year || ': ' || issues END AS line FROM n WHERE nr <= 10",
        "sampled_images": views() + "SELECT image_label, woodpiece_label FROM meta ORDER BY md5('3:' || image_label), image_label LIMIT 10",
        "bound_tables": "SELECT 'nations' AS search_terms, n_name AS name, n_regionkey FROM nation UNION ALL SELECT 'regions', r_name, NULL FROM region",
        "unknown_options": "SELECT 'some' AS tbl, 'Country' AS field, 'warning' AS severity, 'Invalid options' AS message WHERE EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING')",
        "date_violations": "SELECT 'orders' AS tbl, 'bad' AS field, 'warning' AS severity, 'Invalid date formats' AS message UNION ALL SELECT 'orders', 'blank', 'error', 'Required'",
        "settings_dates": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('minute', o_orderdate) WHEN 2 THEN TIMESTAMP '2099-02-01 00:00:00' END AS created_at,
            CASE WHEN o_orderkey % 5 >= 3 THEN 'unparsed' WHEN o_orderkey % 5 = 2 THEN 'future' END AS date_problem FROM orders""",
        "name_problems": f"""WITH {names}, x AS (SELECT name FROM names UNION ALL SELECT 'copy/' || name FROM names WHERE name LIKE '%1.jpg'),
            m AS (SELECT name, nullif(regexp_extract(name, '[A-Za-z0-9]+_[A-Za-z0-9]+_[A-Za-z0-9]{{2}}[A-Za-z0-9]*_[A-Za-z0-9]+_[A-Za-z0-9]+'), '') AS matched FROM x), n AS (SELECT *, count(*) OVER (PARTITION BY matched) AS n FROM m)
            SELECT name, CASE WHEN matched IS NULL THEN 'no match' ELSE 'duplicate' END AS problem FROM n WHERE matched IS NULL OR n > 1""",
        "dataset_rules": f"""WITH ds AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN repeat('n', 65) ELSE c_name END AS ds_name, CASE WHEN c_custkey % 7 = 0 THEN '[ADD INFO here]' WHEN c_custkey % 17 = 0 THEN NULL ELSE 'text' END AS description,
            c_custkey % 2 = 0 AS restricted, CASE WHEN c_custkey % 3 = 0 THEN '2030-01-01' WHEN c_custkey % 10 = 0 THEN 'soon' END AS until FROM customer)
            SELECT * FROM ({" UNION ALL ".join([flag("ds_name = ''", "ds_name", "Required"), flag("length(ds_name) > 64", "ds_name", "Invalid lengths"), flag("description IS NULL", "description", "Required"), flag("contains(description, '[ADD INFO')", "description", "Unfinished template"), flag("restricted AND until IS NULL", "embargoed_until", "Required"), flag("NOT restricted AND until IS NOT NULL", "embargoed_until", "Must be empty"), flag("until = 'soon'", "embargoed_until", "Invalid date formats")])}) WHERE n > 0""",
        "label_orphans": """SELECT 'orphans' AS "check", c_nationkey::BIGINT AS key, NULL::BIGINT AS declared, NULL::BIGINT AS found FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 2 = 0))
            UNION ALL SELECT 'counts', r_regionkey, 5, n FROM (SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) ON n_regionkey = r_regionkey GROUP BY 1) WHERE n <> 5""",
        "ring_kinds": "SELECT 'type of year' AS issue, 1::BIGINT AS n UNION ALL SELECT 'type of other_issues', 1",
        "file_names": f"SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'dataset' ELSE substr(regexp_replace(regexp_replace(trim({part}), '[^A-Za-z0-9_-]', '_', 'g'), '^[-_]+', ''), 1, 32) END AS file_name FROM part",
        "readable_patterns": f"WITH {names}, m AS (SELECT regexp_matches(name, 'SITE[0-9]_PCAB_[0-9A-Z]+_[0-9]+') AS other, name NOT LIKE 'scan%' AS usual FROM names) SELECT '{{site}}_{{species}}_{{tree}}{{woodpiece}}_{{slide}}_{{image}}' AS shown, count(*) FILTER (WHERE usual) AS n_fit, count(*) FILTER (WHERE NOT usual) AS n_not FROM m UNION ALL SELECT '{{site}}_{{species}}_{{tree}}_{{image}}', count(*) FILTER (WHERE other), count(*) FILTER (WHERE NOT other) FROM m",
    }

