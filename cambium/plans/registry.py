"""Names of the wood-anatomy queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.functions import expr as X
from cambium.operators import clean, flags, profiles, structure, validate
from cambium.operators.model import CELL_MEASURES, RING_KEY, RING_MEASURES, Measurements
from cambium.sources import measurements as files
from cambium.sources.scratch import kept

from . import adapters, oracles

PARAMS = ["la", "cwttan", "drad"]
PROBS = [0.25, 0.5, 0.75]
SECTORS = 5
YEAR = 2001  # the current year of the dating check, fixed so that results are


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to their significant digits, since their last ones depend on the order of summing."""
    return df.select(*(X.significant(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


def _raw(spark: SparkSession, d: str) -> Measurements:
    return adapters.measurements(spark, d)


def _clean(spark: SparkSession, d: str) -> Measurements:
    return clean.remove_outliers(_raw(spark, d))


def _numbered(spark: SparkSession, d: str) -> Measurements:
    """The clean measurements, the cells with their places in the table, for what hangs on the order of summing."""
    return clean.remove_outliers(adapters.measurements(spark, d, numbered=True))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return clean.complete_rings_log(_clean(spark, d))


def _rings(spark: SparkSession, d: str, verbose: bool = False) -> DataFrame:
    return clean.validated_rings(_clean(spark, d), adapters.meta(spark, d), verbose)


def _kept_rings(spark: SparkSession, d: str) -> DataFrame:
    """The validated rings, written once, for what uses them several times."""
    return kept(_rings(spark, d), "rings")


def outlier_counts(spark, d):
    raw = _raw(spark, d)
    cells = clean.negative_counts(raw.cells, CELL_MEASURES).withColumn("tbl", F.lit("cells"))
    return cells.unionByName(clean.negative_counts(raw.rings, RING_MEASURES).withColumn("tbl", F.lit("rings")))


def remove_outliers(spark, d):
    return tidy(_clean(spark, d).cells.select(*RING_KEY, "xpix", "ypix", *CELL_MEASURES))


def cell_measures(spark, d):
    data = _clean(spark, d)
    made = ["tca", "rwd2", "dcwt", "raddistr_st", "cwtall_adj", "cdrad", "cdtan", "cdratio", "sector100"]
    return tidy(clean.cell_measures(data.cells, data.rings).select(*RING_KEY, "xpix", "ypix", *made))


def ewlw_boundary(spark, d):
    data = _numbered(spark, d)
    return tidy(clean.wood_boundary(clean.cell_measures(data.cells, data.rings)))


def ewlw_rings(spark, d):
    return tidy(clean.complete_cell_measures(_numbered(spark, d)).rings)


def ewlw_cells_summary(spark, d):
    cells = clean.complete_cell_measures(_numbered(spark, d)).cells
    return tidy(cells.groupBy(*RING_KEY, "ew_lw").agg(F.count(F.lit(1)).alias("n"), F.avg("tca").alias("mean_tca")))


def rings_log(spark, d):
    return tidy(_log(spark, d).select("woodpiece_label", "slide_label", *RING_KEY, "cno", "mean_cwttan", "mrw", "ra"))


def complete_years(spark, d):
    return clean.complete_years(_log(spark, d)).select("woodpiece_label", "slide_label", *RING_KEY, "cno", "missing_year")


def innermost_stats(spark, d):
    return tidy(clean.innermost_stats(_log(spark, d), _clean(spark, d).cells, adapters.meta(spark, d)))


def incomplete_rings(spark, d):
    flagged = clean.flag_incomplete_rings(_log(spark, d), _clean(spark, d).cells, adapters.meta(spark, d))
    return flagged.select(*RING_KEY, "innermost_ring", "outermost_ring", "incomplete_ring", "incomplete_fct_check")


def issue_counts(spark, d):
    return clean.issue_counts(_rings(spark, d), ["incomplete_ring", "missing_ring", "duplicate_ring", "exclude_dupl", "exclude_issues"])


def profiles_mean(spark, d):
    return tidy(profiles.calculate_profiles(_clean(spark, d).cells, 7, PARAMS))


def profiles_quantiles(spark, d):
    return tidy(profiles.calculate_profiles(_clean(spark, d).cells, SECTORS, PARAMS, PROBS))


def _series(spark, d, param: str = "la_mean", shown: bool = False):
    prf = profiles.calculate_profiles(_clean(spark, d).cells, SECTORS, PARAMS)
    return profiles.chronology_series(_rings(spark, d), param, prf, 2, shown)


def chronology(method: str) -> Callable:
    return lambda spark, d: tidy(profiles.chronology_mean(_series(spark, d), "la_mean", method=method))


def _edits(rings: DataFrame) -> DataFrame:
    """Fixed edits: some exclusions turned round, twice for some rings, and a comment."""
    picked = rings.filter((F.col("year") % 4 == 0) & F.col("image_label").endswith("3"))
    first = picked.select(*RING_KEY, F.lit(1).alias("edit_nr"), (~F.col("exclude_issues")).alias("exclude_issues"), F.lit("checked").alias("comment"))
    second = picked.filter("year = 2000").select(*RING_KEY, F.lit(2).alias("edit_nr"), F.lit(None).cast("boolean").alias("exclude_issues"), F.lit("twice").alias("comment"))
    return first.unionByName(second)


def edited_rings(spark, d):
    rings = flags.init_flags(_kept_rings(spark, d))
    return flags.apply_edits(rings, _edits(rings)).select("woodpiece_label", *RING_KEY, "exclude_issues", "comment", "blue_ring")


def changed_exclusions(spark, d):
    rings = flags.init_flags(_kept_rings(spark, d))
    edited = flags.apply_edits(rings, _edits(rings))
    series = profiles.chronology_series(edited, "mrw", show_excluded=True)
    return tidy(profiles.changed_exclusions(rings, edited, series, "mrw", [f"W{i}" for i in range(12)]))


def hierarchy_counts(spark, d):
    out = None
    for name, df in structure.hierarchy_counts(adapters.meta(spark, d)).items():
        n = df.columns[-1]
        part = df.select(F.lit(name).alias("level"), F.concat_ws("/", *(F.coalesce(c, F.lit("-")) for c in df.columns[:-1])).alias("entity"), F.col(n).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def flag_validation(spark, d):
    chosen = flags.duplicate_selection(_kept_rings(spark, d))
    other = chosen.withColumns({"other_issues": F.col("year") % 5 == 0, "other_reason": F.when(F.col("year") == 1996, "late frost")})
    return flags.flag_checks(other)


def ring_table_issues(spark, d):
    return flags.ring_table_issues(flags.duplicate_selection(_kept_rings(spark, d)).withColumn("slide_label", F.when(F.col("year") != 1999, F.col("slide_label"))))


def inconsistent_exclusions(spark, d):
    rings = flags.init_flags(_kept_rings(spark, d))
    return flags.inconsistent_exclusions(flags.apply_edits(rings, _edits(rings)))


def _names(spark, d) -> DataFrame:
    parts = spark.read.parquet(f"{d}/part.parquet")
    return parts.select(
        F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("scan "), "p_partkey"))
        .when(F.col("p_partkey") % 3 == 0, F.format_string("dir/SITE%d_PISY_%02d_%d_%d.jpg", F.col("p_partkey") % 5, F.col("p_partkey") % 90, F.col("p_partkey") % 7, F.col("p_partkey")))
        .otherwise(F.format_string("SITE%d_PCAB_%02d%s_%d_%d.jpg", F.col("p_partkey") % 5, F.col("p_partkey") % 90, F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("AB"), F.col("p_partkey") % 7, F.col("p_partkey")))
        .alias("name")
    )


def structure_from_names(spark, d):
    return structure.structure_from_names(_names(spark, d))


def structure_paths(spark, d):
    return structure.structure_paths(adapters.meta(spark, d), "demo")


def settings_pivot(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    rnum = F.element_at(F.array(*map(F.lit, [8, 10, 12, 13, 17, 18, 20, 31, 999])), (F.col("o_orderkey") % 9 + 1).cast("int"))
    value = F.when(rnum == 13, F.concat(F.col("o_custkey"), F.lit(" / "), F.col("o_custkey") + 1)).when(rnum == 17, (F.col("o_custkey") % 2).cast("string")).when(rnum == 31, F.concat(F.col("o_custkey") % 50, F.lit(".7"))).otherwise((F.col("o_custkey") % 100).cast("string"))
    rows = orders.select((F.col("o_orderkey") - F.col("o_orderkey") % 9).alias("file"), rnum.alias("rnum"), value.alias("setting"))
    one = rows.groupBy("file", "rnum").agg(F.min("setting").alias("setting"))  # order keys repeat
    kept = ["configuration_file", "sw_version", "spatial_resolution", "origin_calibrated_x", "origin_calibrated_y", "meas_geometry", "circ_lower_limit", "outmost_year", "min_cell_area"]
    return files.pivot_settings(one.select(F.concat(F.lit("f"), "file").alias("path"), "rnum", "setting")).select("fname_settings", *kept)


CUSTOMERS = validate.Table(
    "customers",
    {"c_custkey": T.IntegerType(), "c_name": T.StringType(), "c_acctbal": T.DoubleType(), "c_mktsegment": T.IntegerType(), "region": T.StringType()},
    {
        "c_custkey": validate.Rule("numeric", required=True, minimum=1, maximum=1000),
        "c_name": validate.Rule("character", required=True, unique=True, max_length=10, pattern="^Customer"),
        "c_acctbal": validate.Rule("numeric", minimum=0),
        "c_mktsegment": validate.Rule("dropdown", options=("BUILDING", "MACHINERY")),
        "c_nationkey": validate.Rule("checkbox", max_checks=1),
    },
    ("c_custkey",),
)


def align_schema(spark, d):
    raw = spark.read.parquet(f"{d}/customer.parquet").withColumn("c_custkey", F.concat("c_custkey", F.lit(".9")))
    return tidy(validate.align_to_schema(raw, CUSTOMERS)[0])


def column_violations(spark, d):
    return validate.violations(spark.read.parquet(f"{d}/customer.parquet"), CUSTOMERS)


def fill_downup(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 1, F.col("event_type")).alias("mark"))
    return events.withColumn("mark", X.fill_both_ways(F.col("mark"), "user_id", ["event_id"]))


def name_stem_mismatch(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("gap")) for k, n in zip(files.ENDINGS, (7, 11, 13, 17), strict=True)))
    every = parts.select("p_partkey", F.inline(kinds)).filter(F.col("p_partkey") % F.col("gap") != 0)
    return files.incomplete_sets(every.select(F.concat(F.lit("stem_"), "p_partkey").alias("stem"), "kind", F.concat("p_partkey", "kind").alias("path")))


def squares(spark) -> DataFrame:
    """Countries of ten degrees square; one has an enclave, which is a country with a lake, and a lake of its own."""
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    rings = [(chr(65 + i) + chr(65 + j), 0, box(i * 10.0, j * 10.0, i * 10.0 + 10, j * 10.0 + 10)) for i in range(5) for j in range(3)]
    rings += [("BB", 0, box(11.0, 11.0, 16.0, 16.5)), ("ZZ", 1, box(11.0, 11.0, 16.0, 16.5)), ("ZZ", 1, box(12.5, 12.5, 14.0, 15.0)), ("BB", 0, box(17.0, 11.5, 19.5, 18.0))]
    return spark.createDataFrame(rings, "code string, part int, ring array<struct<lon:double,lat:double>>")


def site_countries(spark, d):
    sites = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("C"), "c_custkey").alias("site_label"), (F.col("c_custkey") % 59 + 0.25).cast("double").alias("longitude"), (F.col("c_custkey") % 37 + 0.75).cast("double").alias("latitude"))
    return structure.site_countries(sites, squares(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "outlier_counts": outlier_counts,
    "remove_outliers": remove_outliers,
    "cell_measures": cell_measures,
    "ewlw_boundary": ewlw_boundary,
    "ewlw_rings": ewlw_rings,
    "ewlw_cells_summary": ewlw_cells_summary,
    "rings_log": rings_log,
    "cwt_check": lambda spark, d: clean.cwt_estimates(_log(spark, d)),
    "complete_years": complete_years,
    "dating_issues": lambda spark, d: clean.dating_issues(_log(spark, d), adapters.meta(spark, d), YEAR),
    "innermost_stats": innermost_stats,
    "incomplete_rings": incomplete_rings,
    "validated_rings": lambda spark, d: tidy(_rings(spark, d)),
    "issue_counts": issue_counts,
    "profiles_mean": profiles_mean,
    "profiles_quantiles": profiles_quantiles,
    "chronology_series": lambda spark, d: tidy(_series(spark, d)),
    "chronology_mean": chronology("mean"),
    "chronology_tbrm": chronology("tbrm"),
    "edited_rings": edited_rings,
    "changed_exclusions": changed_exclusions,
    "inconsistent_exclusions": inconsistent_exclusions,
    "flag_validation": flag_validation,
    "ring_table_issues": ring_table_issues,
    "duplicate_selection": lambda spark, d: flags.duplicate_selection(_rings(spark, d)).select("woodpiece_label", *RING_KEY, "duplicate_ring", "duplicate_rank", "duplicate_sel"),
    "coverage_table": lambda spark, d: flags.coverage_table(flags.duplicate_selection(_rings(spark, d))),
    "coverage_limits": lambda spark, d: flags.coverage_limits(_rings(spark, d)),
    "hierarchy_counts": hierarchy_counts,
    "desc_template": lambda spark, d: structure.description_template(adapters.meta(spark, d)),
    "structure_from_names": structure_from_names,
    "structure_paths": structure_paths,
    "settings_pivot": settings_pivot,
    "name_stem_mismatch": name_stem_mismatch,
    "align_schema": align_schema,
    "column_violations": column_violations,
    "fill_downup": fill_downup,
    "site_countries": site_countries,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import file_queries

    return QUERIES | file_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import file_queries

    return oracles.oracle_sql() | file_queries.oracle_sql()
