"""Table schemas with rules, alignment to them, and violations as data."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.sources.scratch import kept, listed, read_text

from .structure import site_countries

#: Fixed: JSON schema type -> Spark type.
JSON_TYPES = {"string": T.StringType(), "integer": T.IntegerType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType(), "null": T.StringType()}


@dataclass(frozen=True)
class Rule:
    """What a column must satisfy. kind: character, text, numeric, dropdown, autocomplete, checkbox or date."""

    kind: str = "character"
    required: bool = False
    unique: bool = False
    min_length: int = -1
    max_length: int = 10_000
    pattern: str | None = None
    minimum: float | None = None
    maximum: float | None = None
    options: tuple[str, ...] = ()
    min_checks: int | None = None
    max_checks: int | None = None
    title: str | None = None
    #: Names of checks that look beyond a row: see declared_problems.
    others: tuple[str, ...] = ()


@dataclass
class Table:
    """A table's columns (name -> Spark type), rules and required columns."""

    name: str
    columns: dict[str, T.DataType]
    rules: dict[str, Rule] = field(default_factory=dict)
    required: tuple[str, ...] = ()


# -- schema files -------------------------------------------------------------------------------


def latest_schema(folder: str, name: str, spark: SparkSession | None = None) -> str:
    """The path of the last schema file, by name, that has `name` in it; names begin with their dates.

    With spark, folders and files may be on any file system that Spark knows.
    """
    found = sorted({f for f in (listed(spark, folder) if spark else os.listdir(folder)) if name in f and f.endswith(".json")})
    if not found:
        raise FileNotFoundError(f"no schema {name} in {folder}")
    return f"{folder}/{found[-1]}"


def resolve_schema(path: str, spark: SparkSession | None = None) -> dict:
    """A JSON schema with its $ref and allOf resolved: later parts win, required names become required: true."""

    def load(at: str) -> dict:
        if spark:
            return json.loads(read_text(spark, at))
        with open(at, encoding="utf-8") as f:
            return json.load(f)

    return _resolved(load(path), os.path.dirname(path), load)


def _resolved(node, folder: str, load: Callable[[str], dict]):
    if isinstance(node, list):
        return [_resolved(x, folder, load) for x in node]
    if not isinstance(node, dict):
        return node
    out: dict = {}
    if "$ref" in node:
        target = os.path.join(folder, node["$ref"].split("#")[0])
        out = _resolved(load(target), os.path.dirname(target), load)
    for part in node.get("allOf", []):
        out = _merged(out, _resolved(part, folder, load))
    own = {k: _resolved(v, folder, load) for k, v in node.items() if k not in ("$ref", "allOf")}
    out = _merged(out, own)
    if isinstance(out.get("properties"), dict) and isinstance(out.get("required"), list):
        for name in out["required"]:
            if isinstance(out["properties"].get(name), dict):
                out["properties"][name]["required"] = True
    return out


def _merged(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def spark_type(prop: dict) -> T.DataType:
    """The first of a union of types counts; a date format overrides it."""
    kind = prop.get("type", "string")
    kind = kind[0] if isinstance(kind, list) else kind
    kind = {"date": "date", "date-time": "datetime"}.get(prop.get("format", ""), kind)
    return JSON_TYPES.get(kind, T.StringType())


def table_of(name: str, schema: dict) -> Table:
    """Columns and rules of an array-of-records schema."""
    props = schema["items"]["properties"]
    kinds = {"StringType": "character", "IntegerType": "numeric", "DoubleType": "numeric", "BooleanType": "checkbox", "DateType": "date", "TimestampType": "date"}
    rules = {}
    for c, p in props.items():
        options = tuple(x for x in p.get("enum", []) if x is not None)
        kind = p.get("htType") or ("dropdown" if options else kinds[type(spark_type(p)).__name__])
        rules[c] = Rule(
            kind, bool(p.get("required")), bool(p.get("unique")), p.get("minLength", -1), p.get("maxLength", 10_000), p.get("pattern"),
            p.get("minimum"), p.get("maximum"), options, p.get("min_checks"), p.get("max_checks"), p.get("title"), tuple(p.get("otherChecks", [])),
        )
    return Table(name, {c: spark_type(p) for c, p in props.items()}, rules, tuple(c for c, r in rules.items() if r.required))


def empty_table(spark: SparkSession, table: Table, rows: int = 0) -> DataFrame:
    """No rows, or dummy rows of empty strings, false and nulls."""
    schema = T.StructType([T.StructField(c, t) for c, t in table.columns.items()])
    blank = tuple("" if isinstance(t, T.StringType) else False if isinstance(t, T.BooleanType) else None for t in table.columns.values())
    return spark.createDataFrame([blank] * rows, schema)


# -- alignment ----------------------------------------------------------------------------------


class SchemaError(ValueError):
    """Raised where a table can't be aligned."""


def converted(c: str, kind: T.DataType) -> Column:
    """The column cast, null where it can't be; text of a number becomes an integer by truncation."""
    name = f"`{c}`"
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return F.expr(f"cast(try_cast({name} as double) as {kind.simpleString()})")
    return F.expr(f"try_cast({name} as {kind.simpleString()})")


def clean_name(name: str) -> str:
    """Lower case with underscores."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_") or "x"


def align_to_schema(df: DataFrame, table: Table, force_required: bool = True, by_position: bool = False) -> tuple[DataFrame, list[str]]:
    """df with exactly the table's columns and types, and the warnings.

    by_position: the first columns take the table's names. Missing required columns are an error
    if forced, else a warning; extra columns are dropped with a warning; absent ones are null.
    Without any known column: an error if forced, else one dummy row.
    """
    warnings, names = [], list(table.columns)
    if by_position:
        df = df.toDF(*names[: len(df.columns)], *df.columns[len(names) :])
    common = [c for c in names if c in df.columns]
    if not common:
        if force_required:
            raise SchemaError(f"no valid columns in {table.name}")
        return empty_table(df.sparkSession, table, 1), [f"no valid columns in {table.name}"]
    if missing := [c for c in table.required if c not in df.columns]:
        message = f"missing required columns in {table.name}: {', '.join(missing)}"
        if force_required:
            raise SchemaError(message)
        warnings.append(message)
    if [c for c in df.columns if c not in names]:
        warnings.append(f"extra columns ignored in {table.name}")
    out = df.select(*((converted(c, t) if c in common else F.lit(None).cast(t)).alias(c) for c, t in table.columns.items()))
    return out, warnings


def validated_table(df: DataFrame, table: Table, force_required: bool = True, by_position: bool = False) -> tuple[DataFrame | None, list[str]]:
    """align_to_schema with tidied names; an error becomes a message and no table."""
    try:
        return align_to_schema(df.toDF(*map(clean_name, df.columns)), table, force_required, by_position)
    except SchemaError as e:
        return None, [str(e)]


def validated_document(tables: dict[str, DataFrame], known: dict[str, Table], main: str) -> tuple[dict[str, DataFrame], list[str]]:
    """Aligned tables of a metadata document. `main` must be there and whole; names with `$` are ignored."""
    given = {k: v for k, v in tables.items() if not k.startswith("$")}
    if main not in given:
        raise SchemaError(f"the required table {main} is missing")
    warnings = [f"missing tables: {', '.join(m)}"] if (m := [k for k in known if k not in given]) else []
    out = {}
    for name, table in known.items():
        if name in given:
            df, said = align_to_schema(given[name], table, force_required=name == main)
            out[name] = df
            warnings += said
    return out, warnings


# -- rules --------------------------------------------------------------------------------------


def rule_failures(column: str, rule: Rule) -> list[tuple[str, Column]]:
    """(message, aggregate that is true if the rule is broken)."""
    c = F.col(column)
    text = c.cast("string")
    blank = c.isNull() | (text == "")
    given = ~blank
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    out: list[tuple[str, Column]] = []
    if rule.kind in ("character", "text"):
        out.append(("Required", some(blank) & F.lit(rule.required)))
        out.append(("Invalid lengths", some(given & ~F.length(text).between(rule.min_length, rule.max_length))))
        if rule.pattern:
            out.append(("Invalid formats", some(given & ~F.rlike(text, F.lit(rule.pattern)))))
    elif rule.kind == "numeric":
        number = F.expr(f"try_cast(`{column}` as double)")
        out.append(("Required", some(number.isNull()) & F.lit(rule.required)))
        low = number < rule.minimum if rule.minimum is not None else F.lit(False)
        high = number > rule.maximum if rule.maximum is not None else F.lit(False)
        out.append(("Out of range values", some(low | high)))
    elif rule.kind in ("dropdown", "autocomplete"):
        out.append(("Required", some(blank) & F.lit(rule.required)))
        out.append(("Invalid options", some(given & ~text.isin(list(rule.options)))))
    elif rule.kind == "checkbox":
        checks = F.count_if(c.try_cast("boolean"))
        least = rule.min_checks if rule.min_checks is not None else int(rule.required)
        out.append(("Too few checked", checks < least))
        if rule.max_checks is not None:  # else a table of any length is checked as it likes
            out.append(("Too many checked", (checks >= least) & (checks > rule.max_checks)))
    elif rule.kind == "date":
        out.append(("Required", some(blank) & F.lit(rule.required)))
        out.append(("Invalid date formats", some(given & F.expr(f"try_cast(`{column}` as date)").isNull())))
    else:
        raise ValueError(f"unknown column kind {rule.kind}")
    return out


def repeated_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_values) of the columns in which a value occurs more than once; nulls and empty texts don't count.

    All columns in one grouping by (column, value), with map-side combining, however many columns there are.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    counted = df.select(F.inline(pairs)).filter("value <> ''").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n > 1").groupBy("column").agg(F.count(F.lit(1)).alias("n_values"))


def violations(df: DataFrame, table: Table) -> DataFrame:
    """(tbl, field, severity, message) of the broken rules; one aggregation for all columns, and one for what must be unique."""
    checks = {c: rule_failures(c, r) for c, r in table.rules.items() if c in df.columns}
    if not checks:
        return df.sparkSession.createDataFrame([], "tbl string, field string, severity string, message string")
    one = df.agg(*(F.array_compact(F.array(*(F.when(broken, F.lit(m)) for m, broken in found))).alias(c) for c, found in checks.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(table.rules[c].title or c).alias("field"), F.col(c).alias("said")) for c in checks))
    flat = one.select(F.lit(table.name).alias("tbl"), F.inline(rows))
    unique = [c for c in checks if table.rules[c].unique and table.rules[c].kind in ("character", "text")]
    if unique:
        twice = repeated_values(df, unique).select("column", F.lit("Non-unique values").alias("twice"))
        flat = flat.join(F.broadcast(twice), "column", "left")  # a row a column
        flat = flat.withColumn("said", F.array_compact(F.concat("said", F.array("twice"))))
    told = flat.select("tbl", "field", F.array_join("said", ", ").alias("message")).filter("message <> ''")
    # a message that says invalid is a warning only
    return told.select("tbl", "field", F.when(F.lower("message").contains("invalid"), "warning").otherwise("error").alias("severity"), "message")


def option_violations(df: DataFrame, table: Table, references: dict[str, DataFrame]) -> DataFrame:
    """(tbl, field, severity, message) of the columns with a value that isn't in their reference list.

    references: one-column tables by column. Each column's distinct values are joined against its list, so neither
    has to be small. Null and empty values are no options and not judged here.
    """
    out = None
    for c, known in references.items():
        values = df.select(F.col(c).cast("string").alias("value")).filter("value <> ''").distinct()
        unknown = values.join(known.select(F.col(known.columns[0]).cast("string").alias("value")), "value", "left_anti")
        title = table.rules[c].title or c if c in table.rules else c
        part = unknown.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(table.name).alias("tbl"), F.lit(title).alias("field"), F.lit("warning").alias("severity"), F.lit("Invalid options").alias("message"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("option_violations: no reference lists")
    return out


def dataset_problems(ds: DataFrame, markers: tuple[str, ...] = ("[ADD INFO",)) -> DataFrame:
    """(field, message) of a dataset row: name, description, and the embargo date that restricted access needs."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    restricted, dated = text("ds_access") == "restricted", text("embargoed_until") != ""
    unfinished = F.lit(False)
    for m in markers:
        unfinished = unfinished | text("description").contains(m)
    rows = [
        ("ds_name", text("ds_name") == "", "Required"),
        ("ds_name", F.length(text("ds_name")) > 64, "Invalid lengths"),
        ("description", text("description") == "", "Required"),
        ("description", unfinished, "Unfinished template"),
        ("embargoed_until", restricted & ~dated, "Required"),
        ("embargoed_until", ~restricted & dated, "Must be empty"),
        ("embargoed_until", dated & F.expr("try_cast(embargoed_until as date)").isNull(), "Invalid date formats"),
    ]
    found = F.filter(F.array(*(F.when(cond, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, cond, m in rows)), lambda x: x.isNotNull())
    return ds.select(F.inline(found))


def count_mismatches(parent: DataFrame, child: DataFrame, key: str, declared: str) -> DataFrame:
    """(key, declared, found) of the parents whose declared number of children isn't the number there is."""
    found = child.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    return parent.select(key, F.col(declared).alias("declared")).join(found, key, "left").select(key, "declared", F.coalesce("found", F.lit(0)).alias("found")).filter("NOT declared <=> found")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Values of key in child that parent lacks."""
    return child.filter(F.col(key).isNotNull()).join(parent, key, "left_anti").select(key).distinct()


#: Fixed: the child table of each table, and the label that both have.
CHILDREN = {"site_data": ("tree_data", "site_label"), "tree_data": ("woodpiece_data", "tree_label"), "woodpiece_data": ("slide_data", "woodpiece_label"), "slide_data": ("roxas_data", "slide_label")}
PARENTS = {child: (parent, key) for parent, (child, key) in CHILDREN.items()}
#: Form of a DOI, with or without its resolver.
DOI = r"^(https?://(dx\.)?doi\.org/|doi:)?10\.[0-9]{4,9}/\S+$"


def sequence_gaps(df: DataFrame, column: str) -> DataFrame:
    """(n): how many of the numbers 1 to the number of rows don't occur in the column."""
    counted = df.groupBy(F.col(column).try_cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    there = counted.crossJoin(F.broadcast(total)).filter((F.col("x") == F.floor("x")) & F.col("x").between(1, F.col("total")))  # one row
    return total.crossJoin(there.agg(F.count(F.lit(1)).alias("found"))).select((F.coalesce("total", F.lit(0)) - F.col("found")).alias("n"))


def declared_problems(
    tables: dict[str, DataFrame], known: dict[str, Table], species: DataFrame | None = None, polygons: DataFrame | None = None, datasets: DataFrame | None = None
) -> DataFrame:
    """(tbl, field, message, n) of the checks that schemas name and that rows break; n rows each.

    valid_seq: the numbers 1 to the number of rows, each once. check_counts: as many rows of the child table have the row's
    label. valid_label: the parent table has the label. check_speciescode: the value is that of the species list (species) for the
    row's species_code. check_coords: the site lies in the country (polygons; its code, or a text that ends with the code in
    brackets). check_doi: the form of a DOI. check_dsid: a label that is known (datasets). Nulls and empty texts break none
    but check_counts, where a declared number is compared. Checks whose other table or list isn't given are left out.
    """
    out: list[DataFrame] = []
    told = lambda df, name, c, message: df.select(F.lit(name).alias("tbl"), F.lit(known[name].rules[c].title or c).alias("field"), F.lit(message).alias("message"), F.col("n").cast("long").alias("n")).filter("n > 0")
    rows = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    for name, df in tables.items():
        asked = [(c, other) for c, rule in known[name].rules.items() if c in df.columns for other in rule.others]
        of_species = [c for c, other in asked if other == "check_speciescode"]
        for c, other in asked:
            given = df.filter(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
            child, parent = CHILDREN.get(name), PARENTS.get(name)
            if other == "valid_seq":
                out.append(told(sequence_gaps(df, c), name, c, "Invalid sequence"))
            elif other == "check_counts" and child and child[0] in tables:
                out.append(told(rows(count_mismatches(given, tables[child[0]], child[1], c)), name, c, "Wrong counts"))
            elif other == "valid_label" and parent and parent[0] in tables:
                out.append(told(rows(given.join(tables[parent[0]].select(F.col(parent[1]).alias(c)).distinct(), c, "left_anti")), name, c, "Unknown labels"))
            elif other == "check_doi":
                out.append(told(rows(given.filter(~F.rlike(F.trim(F.col(c)), F.lit(DOI)))), name, c, "Invalid DOI"))
            elif other == "check_dsid" and datasets is not None:
                out.append(told(rows(given.join(datasets.select(F.col(datasets.columns[0]).alias(c)).distinct(), c, "left_anti")), name, c, "Unknown labels"))
            elif other == "check_coords" and polygons is not None:
                placed = given.select(F.monotonically_increasing_id().cast("string").alias("site_label"), F.col("longitude").try_cast("double").alias("longitude"), F.col("latitude").try_cast("double").alias("latitude"), F.col(c).alias("claimed"))
                placed = kept(placed.dropna(subset=["longitude", "latitude"]), "placed")
                found = site_countries(placed, polygons).join(placed.select("site_label", "claimed"), "site_label")
                code = F.coalesce(F.nullif(F.regexp_extract("claimed", r"\((\w+)\)\s*$", 1), F.lit("")), F.col("claimed"))
                out.append(told(rows(found.filter(F.col("country_code") != code)), name, c, "Outside the country"))
        if of_species and species is not None:
            # one join and one aggregation for all columns that the list knows
            side = species.select(F.col("itrdb_species_code").alias("species_code"), *(F.col(c).alias(f"listed_{c}") for c in of_species))
            both = df.filter("species_code <> ''").join(side, "species_code", "left")
            wrong = both.agg(*(F.count_if((F.coalesce(F.col(c), F.lit("")) != "") & ~F.col(c).eqNullSafe(F.col(f"listed_{c}"))).alias(c) for c in of_species))
            each = wrong.select(F.inline(F.array(*(F.struct(F.lit(known[name].rules[c].title or c).alias("field"), F.col(c).alias("n")) for c in of_species))))
            out.append(each.select(F.lit(name).alias("tbl"), "field", F.lit("Not the species' value").alias("message"), F.col("n").cast("long").alias("n")).filter("n > 0"))
    if not out:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "tbl string, field string, message string, n long")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
