"""Label hierarchy from file names, metadata assembly and hierarchy summaries."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.functions import expr as X
from cambium.sources.scratch import kept

#: Fixed: parts of an image's name, from the site down.
PARTS = ["site", "species", "tree", "woodpiece", "slide", "image"]
#: Fixed: the default pattern of image names.
DEFAULT_PATTERN = "(?<site>[:alnum:]+)_(?<species>[:alnum:]+)_(?<tree>[:alnum:][:alnum:])(?<woodpiece>[:alnum:]*)_(?<slide>[:alnum:]+)_(?<image>[:alnum:]+)"
LABELS = ["tree_label", "woodpiece_label", "slide_label", "image_label"]
DATE_FORMATS = ("d.M.yyyy H:mm:ss", "d/M/yyyy H:mm")


def java_pattern(pattern: str) -> str:
    """POSIX classes outside brackets, as some dialects allow, in the form that Java has."""
    return re.sub(r"(?<!\[)\[:(\w+):\](?!\])", lambda m: {"alnum": r"[\p{IsAlphabetic}\p{IsDigit}]", "alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}"}[m[1]], pattern)


def group_names(pattern: str) -> list[str]:
    return re.findall(r"\(\?<([a-zA-Z]\w*)>", pattern)


def readable(pattern: str) -> str:
    """The pattern with each group as {name}."""
    return re.sub(r"\(\?<([a-zA-Z]\w*)>[^()]*\)", r"{\1}", pattern)


def structure_from_names(names: DataFrame, pattern: str = DEFAULT_PATTERN, site: str | None = None, species: str | None = None, column: str = "name") -> DataFrame:
    """Adds the parts and labels that the names spell: site_label, species_code and LABELS.

    The first match anywhere in a name counts; names that don't match have null in `matched` and
    in all parts and labels. Labels join the parts above them by `_`, leaving out absent ones.
    """
    groups = group_names(pattern)
    if site is None and "site" not in pattern:
        raise ValueError("the pattern has no site and none is given")
    for given, name in ((site, "site"), (species, "species")):
        if given is not None and name in groups:
            raise ValueError(f"{name} is given and also in the pattern")
    regex = java_pattern(pattern)
    matched = F.nullif(F.regexp_extract(column, regex, 0), F.lit(""))
    df = names.withColumn("matched", matched)
    constant = {"site": site, "species": species}
    for part in PARTS:
        value = F.nullif(F.regexp_extract(column, regex, groups.index(part) + 1), F.lit("")) if part in groups else F.lit(constant.get(part)).cast("string")
        df = df.withColumn(f"part_{part}", F.when(F.col("matched").isNotNull(), value))
    above = [F.col("part_site"), F.col("part_species"), F.col("part_tree")]
    df = df.withColumn("tree_label", F.when(F.col("matched").isNotNull(), F.concat_ws("_", *above)))
    for upper, part in (("tree", "woodpiece"), ("woodpiece", "slide"), ("slide", "image")):
        df = df.withColumn(f"{part}_label", F.when(F.col("matched").isNotNull(), F.concat_ws("_", f"{upper}_label", f"part_{part}")))
    return df.select(*names.columns, "matched", F.col("part_site").alias("site_label"), F.col("part_species").alias("species_code"), *LABELS)


def structure_problems(structure: DataFrame, column: str = "name") -> DataFrame:
    """(name, problem): names that don't match, and names that spell the same."""
    unmatched = structure.filter("matched IS NULL").select(F.col(column).alias("name"), F.lit("no match").alias("problem"))
    twice = structure.filter("matched IS NOT NULL").groupBy("matched").agg(F.collect_list(column).alias("names")).filter(F.size("names") > 1)
    return unmatched.unionByName(twice.select(F.explode("names").alias("name"), F.lit("duplicate").alias("problem")))


def parsed_dates(df: DataFrame, column: str, now: dt.datetime, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """`column` as a timestamp, and date_problem: `unparsed`, `future` or null."""
    parsed = F.coalesce(*(F.try_to_timestamp(F.col(column), F.lit(f)) for f in formats))
    problem = F.when(parsed.isNull(), "unparsed").when(parsed > F.lit(now), "future")
    return df.withColumn("date_problem", problem).withColumn(column, parsed)


def combine_metadata(structure: DataFrame, images: DataFrame, settings: DataFrame) -> DataFrame:
    """Structure with image information and settings; the file names come last."""
    out = structure.join(images, "fname_image", "left").join(settings, "fname_settings", "left")
    files = [c for c in out.columns if c.startswith("fname")]
    return out.select(*(c for c in out.columns if c not in files), *files)


#: Tables of the hierarchy: keys, the level below and the name of its count.
LEVELS = {
    "site": (["site_label"], "tree_label", "n_trees"),
    "tree": (["site_label", "species_code", "tree_label"], "woodpiece_label", "n_woodpieces"),
    "woodpiece": (["tree_label", "woodpiece_label"], "slide_label", "n_slides"),
    "slide": (["woodpiece_label", "slide_label"], "image_label", "n_images"),
}


def hierarchy_levels(meta: DataFrame) -> DataFrame:
    """level, the labels that are its keys, and n, for all levels at once; null counts as one value.

    Grouping sets give the distinct keys with their children for every level in one pass over the images; counting
    those by their keys is a second grouping, of what is left.
    """
    columns = ["site_label", "species_code", *LABELS]
    sets = [[*keys, below] for keys, below, _ in LEVELS.values()]
    bits = lambda cols: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cols)
    pairs = meta.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().alias("set"))
    level = F.lit(None).cast("string")
    for name, s in zip(LEVELS, sets, strict=True):
        level = F.when(F.col("set") == bits(s), name).otherwise(level)
    keys = [F.when(F.col("level").isin([n for n, (k, _, _) in LEVELS.items() if c in k]), F.col(c)).alias(c) for c in columns[:-1]]
    return pairs.withColumn("level", level).groupBy("level", *keys).agg(F.count(F.lit(1)).alias("n"))


def hierarchy_counts(meta: DataFrame) -> dict[str, DataFrame]:
    """Tables of trees per site, woodpieces per tree, slides per woodpiece and images per slide; null counts as one.

    All are cut from one table that is written once.
    """
    counted = kept(hierarchy_levels(meta), "levels")
    return {k: counted.filter(F.col("level") == k).select(*keys, F.col("n").alias(n)) for k, (keys, _, n) in LEVELS.items()}


def padded(df: DataFrame, columns: dict[str, T.DataType]) -> DataFrame:
    """df with exactly the columns of a table's schema, typed; absent ones are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def hierarchy_tables(meta: DataFrame, schemas: dict[str, dict[str, T.DataType]], species: DataFrame) -> dict[str, DataFrame]:
    """The hierarchy counts as tables of their schemas (site, tree, woodpiece and slide); trees with their species' traits."""
    out = {name: padded(df, schemas[name]) for name, df in hierarchy_counts(meta).items()}
    out["tree"] = enrich_species(out["tree"], species).select(*schemas["tree"])
    return out


def description_template(meta: DataFrame) -> DataFrame:
    """One row, `description`: which trees were collected where."""
    per_species = meta.groupBy("site_label", "species_code").agg(X.distinct_with_null(F.col("tree_label")).alias("n"))
    words = F.concat(F.col("n").cast("string"), F.lit(" "), F.coalesce("species_code", F.lit("NA")), F.lit(" tree"), F.when(F.col("n") > 1, "s").otherwise(""))
    per_site = per_species.withColumn("words", words).groupBy("site_label").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("species_code", F.lit("NA")).alias("s"), "words"))), lambda x: x["words"]).alias("words"))
    sites = per_site.withColumn("words", F.concat(X.listed(F.col("words")), F.lit(" collected at site "), F.coalesce("site_label", F.lit("NA"))))
    every = sites.agg(F.transform(F.array_sort(F.collect_list(F.struct("site_label", "words"))), lambda x: x["words"]).alias("words"))  # one text per site
    return every.select(X.listed(F.col("words"), oxford=True).alias("description"))


def structure_paths(meta: DataFrame, dataset: str) -> DataFrame:
    """image_label and its path dataset/site/tree/woodpiece/slide/image, each part without its parent's label."""
    short = lambda c, up: F.when(F.col(c).startswith(F.concat(F.col(up), F.lit("_"))), F.expr(f"substr({c}, length({up}) + 2)")).otherwise(F.when(F.col(c) == F.col(up), F.lit("")).otherwise(F.col(c)))
    named = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("(n.a.)")).otherwise(c)
    parts = [named(F.col("site_label")), *(named(short(c, up)) for c, up in (("tree_label", "site_label"), ("woodpiece_label", "tree_label"), ("slide_label", "woodpiece_label"), ("image_label", "slide_label")))]
    return meta.select("image_label", F.concat_ws("/", F.lit(dataset), *parts).alias("path"))


def enrich_species(trees: DataFrame, species: DataFrame) -> DataFrame:
    """Fills species columns of trees from the reference list by its code."""
    extra = ["species_name", "phylogenetic_group", "leaf_habit", "tree_ring_structure"]
    side = species.select(F.col("itrdb_species_code").alias("species_code"), *(F.col(c).alias(f"new_{c}") for c in extra))
    out = trees.join(side, "species_code", "left")
    keep = [c for c in trees.columns if c not in extra]
    return out.select(*keep, *(F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in trees.columns else F.col(f"new_{c}").alias(c) for c in extra))


def site_coordinates(sites: DataFrame) -> DataFrame:
    """Distinct valid (longitude, latitude) pairs."""
    number = lambda c, most: F.when(F.abs(X.clean_double(F.expr(f"try_cast({c} as double)"))) <= most, F.expr(f"try_cast({c} as double)"))
    return sites.select(number("longitude", 180).alias("longitude"), number("latitude", 90).alias("latitude")).dropna().distinct()


#: Where in a cell its reference point is: off any line that coordinates are likely to be on.
_AT_X, _AT_Y = 0.3819660112501051, 0.7236067977499790
_SLACK = 1e-9


def polygon_index(polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """A grid index of polygons: code, part, cell_x, cell_y, inside, edges.

    polygons: code and ring, an array of (lon, lat) structs, a row for each ring. Rings with the same code and `part` are one
    polygon by the even-odd rule: outer rings, holes, islands in holes. Without a column `part` each ring is a polygon. A cell
    has an entry for each polygon that meets it: the edges that run through the cell, and whether the cell's reference
    point is inside. The reference points of a row of cells lie on a line, so that is a running count of the edges that the
    line crosses. No entry has more than its cell's edges, however long the coastline.
    """
    named = polygons if "part" in polygons.columns else polygons.withColumn("part", F.xxhash64("code", "ring"))
    size = F.size("ring")
    around = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", (i + 1) % size).alias("b")))
    rings = named.filter(size > 2).select("code", "part", "ring").distinct()
    edges = rings.select("code", "part", F.explode(around).alias("e")).select("code", "part", *(F.col(f"e.{p}.{c}").alias(f"{p}{c[1]}") for p in "ab" for c in ("lon", "lat")))
    edges = edges.toDF("code", "part", "ax", "ay", "bx", "by").filter("ax <> bx OR ay <> by")
    at = lambda c: F.floor(c / F.lit(cell)).cast("int")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.withColumn("cell_y", F.explode(F.sequence(at(low - _SLACK), at(high + _SLACK))))

    y = (F.col("cell_y") + _AT_Y) * cell
    crossing = rows.filter((F.col("ay") > y) != (F.col("by") > y)).withColumn("x", F.expr("ax") + (y - F.col("ay")) * F.expr("(bx - ax) / (by - ay)"))
    starts = crossing.groupBy("code", "part", "cell_y", (F.floor(F.col("x") / cell - _AT_X) + 1).cast("int").alias("start")).agg(F.count("*").alias("n"))
    row = Window.partitionBy("code", "part", "cell_y").orderBy("start")
    runs = starts.withColumn("n", F.sum("n").over(row)).withColumn("end", F.lead("start").over(row) - 1).filter("n % 2 = 1 AND end >= start")
    within = runs.select("code", "part", F.explode(F.sequence("start", "end")).alias("cell_x"), "cell_y", F.lit(1).alias("inside"), F.lit(None).cast("struct<ax:double,ay:double,bx:double,by:double>").alias("edge"))

    def reach(bound):  # x of an edge where it enters or leaves a row of cells
        part = F.least(high, F.greatest(low, bound))
        return F.when(F.col("ay") == F.col("by"), F.col("ax")).otherwise(F.expr("ax") + (part - F.col("ay")) * F.try_divide(F.expr("bx - ax"), F.expr("by - ay")))

    ends = [reach(F.col("cell_y") * cell - _SLACK), reach((F.col("cell_y") + 1) * cell + _SLACK)]
    flat = F.col("ay") == F.col("by")
    ends = [F.when(flat, F.least("ax", "bx")).otherwise(F.least(*ends)), F.when(flat, F.greatest("ax", "bx")).otherwise(F.greatest(*ends))]
    cut = rows.withColumn("cell_x", F.explode(F.sequence(at(ends[0] - _SLACK), at(ends[1] + _SLACK))))
    clipped = cut.select("code", "part", "cell_x", "cell_y", F.lit(0).alias("inside"), F.struct("ax", "ay", "bx", "by").alias("edge"))
    return within.unionByName(clipped).groupBy("code", "part", "cell_x", "cell_y").agg(F.max("inside").alias("inside"), F.collect_list("edge").alias("edges"))


def site_countries(sites: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """Country code of each site by point in polygon: site_label, country_code ("" where none or unknown).

    Points meet the entries of polygon_index for their own cell by an equal key, so no side has to be small. From the cell's
    reference point a segment runs to the site; each edge that it crosses turns inside to outside. A site in a hole isn't
    in the polygon, and one on an edge or corner is in none (it isn't within). Of several countries the first code
    counts. Null or odd coordinates: no country. All of it is array work in the JVM.
    """
    index = polygon_index(polygons, cell)
    place = lambda c: F.when(F.abs(F.col(c)) <= 1e6, F.floor(F.col(c) / cell)).cast("int")
    near = sites.select("site_label", "longitude", "latitude", place("longitude").alias("cell_x"), place("latitude").alias("cell_y")).join(index, ["cell_x", "cell_y"], "left")
    site, start = (F.col("longitude"), F.col("latitude")), ((F.col("cell_x") + _AT_X) * cell, (F.col("cell_y") + _AT_Y) * cell)
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def crossed(e):
        a, b = (e["ax"], e["ay"]), (e["bx"], e["by"])
        return ((turn(start, site, a) > 0) != (turn(start, site, b) > 0)) & ((turn(a, b, start) > 0) != (turn(a, b, site) > 0))

    def on(e):
        return (turn((e["ax"], e["ay"]), (e["bx"], e["by"]), site) == 0) & site[0].between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & site[1].between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    inside = ((F.col("inside") + F.size(F.filter("edges", crossed))) % 2 == 1) & ~F.exists("edges", on)
    found = near.withColumn("within", F.coalesce(inside, F.lit(False))).groupBy("site_label").agg(F.min(F.when(F.col("within") & (F.col("code") != "-99"), F.col("code"))).alias("code"))
    return found.select("site_label", F.coalesce("code", F.lit("")).alias("country_code"))


def with_country_names(sites: DataFrame, polygons: DataFrame, countries: DataFrame) -> DataFrame:
    """sites with country_code set to the combined name and code of the country that each one's coordinates lie in.

    The distinct valid coordinates are looked up once and joined back by longitude and latitude; codes become names
    by the reference list, "" where there is none. Sites without valid coordinates have null.
    """
    coords = site_coordinates(sites).withColumn("site_label", F.concat_ws(" ", F.col("longitude").cast("string"), F.col("latitude").cast("string")))
    coded = site_countries(coords, polygons).join(coords, "site_label").join(countries.select(F.col("country_iso_code").alias("country_code"), "combined"), "country_code", "left")
    named = coded.select("longitude", "latitude", F.coalesce("combined", F.lit("")).alias("country_code"))
    double = lambda c: F.col(c).try_cast("double")
    return sites.drop("country_code").withColumns({c: double(c) for c in ("longitude", "latitude")}).join(named, ["longitude", "latitude"], "left").select(*[c for c in sites.columns if c != "country_code"], "country_code")


def file_name_of(dataset: str, longest: int = 32, fallback: str = "dataset") -> str:
    """A data set's name as part of a file name."""
    name = re.sub(r"[^A-Za-z0-9_-]", "_", dataset.strip().replace(" ", "_")).lstrip("-_")
    return (name or fallback)[:longest]


def file_name_column(name: Column, longest: int = 32, fallback: str = "dataset") -> Column:
    """file_name_of for a column of names."""
    tidy = F.regexp_replace(F.regexp_replace(F.trim(name), "[^A-Za-z0-9_-]", "_"), "^[-_]+", "")
    return F.substring(F.coalesce(F.nullif(tidy, F.lit("")), F.lit(fallback)), 1, longest)
