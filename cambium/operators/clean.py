"""Cleaning and checking of measurements: outliers, derived measures, dating, incomplete and duplicate rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions import expr as X
from cambium.sources.scratch import kept

from .model import CELL_MEASURES, CELL_NR, RING_KEY, RING_MEASURES, Measurements, require
from .tables import head_lines

#: Fixed: ratio of wall to lumen above which a cell counts as latewood.
MORK = 1.0
ROLLING = 9
#: Fixed: fewest cells and least width (micrometres) of a ring that isn't missing.
LEAST_CELLS = 5
LEAST_WIDTH = 10.0
#: Fixed: helper columns that only a verbose result keeps.
HELPER_COLUMNS = [
    "innermost_ring", "outermost_ring", "mae", "medYleft", "medYright", "mindist",
    "incomplete_inner", "incomplete_innerv2", "incomplete_fct_check", "no_MRW_other",
]


# -- outliers ---------------------------------------------------------------------------------


def negative_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value) for the columns that have negative values; one pass, one row in the shuffle per task."""
    require(df, columns, "negative_counts")
    counts = df.agg(*(F.count_if(F.col(c) < 0).alias(c) for c in columns))
    return counts.unpivot([], columns, "name", "value").filter("value > 0")


def without_negatives(df: DataFrame, columns: list[str]) -> DataFrame:
    require(df, columns, "without_negatives")
    return df.withColumns({c: F.when(F.col(c) < 0, None).otherwise(F.col(c)) for c in columns})


def remove_outliers(data: Measurements) -> Measurements:
    """Negative measures become null; everything else stays."""
    return Measurements(without_negatives(data.cells, CELL_MEASURES), without_negatives(data.rings, RING_MEASURES))


# -- cell measures ----------------------------------------------------------------------------


def cell_measures(cells: DataFrame, rings: DataFrame) -> DataFrame:
    """Adds tca, rwd2, dcwt, raddistr_st, cwtall_adj, cdrad, cdtan, cdratio, sector100 and mrw.

    Ratios with a zero denominator are null.
    """
    return _measured(cells.join(rings.select(*RING_KEY, "mrw"), RING_KEY, "left"))


def _measured(cells: DataFrame) -> DataFrame:
    """cell_measures of cells with their ring's mrw."""
    col = F.col
    radius = F.sqrt(X.clean_double(col("la")) / math.pi)
    wide = X.if_else(col("rtsr") < 1, radius + col("cwttan"), radius + col("cwtall"))
    wall = wide * wide * math.pi - col("la")
    df = cells.withColumns(
        {
            "tca": col("la") + col("cwa"),
            "rwd2": F.try_divide(col("cwtrad"), col("drad")),
            "dcwt": F.try_divide(X.clean_double(wall), X.clean_double(col("la") + wall)),
            "raddistr_st": col("rraddistr") * col("mrw") / 100,
            "cwtall_adj": X.if_else(col("rtsr") < 1, col("cwttan"), col("cwtall")),
            "cdrad": col("drad") + col("cwttan") * 2,
            "cdtan": col("dtan") + col("cwtrad") * 2,
            "sector100": X.right_closed_bin(col("rraddistr"), 100),
        }
    )
    return df.withColumn("cdratio", F.try_divide(col("cdrad"), col("cdtan")))


def wood_boundary(measured: DataFrame) -> DataFrame:
    """Per ring: max_ew_sector, eww, lww, from cells with sector100, rtsr and mrw.

    The last sector whose rolling mean of wall ratios is at most MORK ends the earlywood; a ring
    without one has minus infinity and no earlywood. Cells without rtsr or mrw don't count, and
    rings without any such cell have no row. A null sector is a sector of its own, the last.

    A mean may be MORK itself but for its last bit, which depends on the order of summing. So a sector's wall ratios are
    summed in the order of CELL_NR, where cells have it, else from the least on, however the cells are partitioned.
    """
    numbered = [F.col(c) for c in (CELL_NR,) if c in measured.columns]
    usable = measured.filter("rtsr IS NOT NULL AND mrw IS NOT NULL").select(*RING_KEY, "sector100", "rtsr", "mrw", *numbered)
    sector = Window.partitionBy(*RING_KEY, "sector100").orderBy(*numbered, "rtsr")
    summed = usable.withColumns({"nr": F.row_number().over(sector), "total": F.sum("rtsr").over(sector.rowsBetween(Window.unboundedPreceding, 0))})
    last = F.max(F.struct("nr", "total"))["total"]
    sectors = summed.groupBy(*RING_KEY, "sector100").agg((last / F.count(F.lit(1))).alias("rtsr"), F.avg("mrw").alias("mrw"))
    order = [F.col("sector100").asc_nulls_last()]
    rolled = sectors.withColumn("rolled", X.centred_mean(F.col("rtsr"), RING_KEY, order, ROLLING, 10.0))
    limits = rolled.groupBy(*RING_KEY).agg(X.max_or_minus_infinity(F.col("sector100"), F.col("rolled") <= MORK).alias("max_ew_sector"), F.avg("mrw").alias("mrw"))
    eww = F.when(F.col("max_ew_sector") >= 0, F.col("max_ew_sector") * F.col("mrw") / 100).otherwise(0.0)
    return limits.select(*RING_KEY, "max_ew_sector", eww.alias("eww"), (F.col("mrw") - eww).alias("lww"))


def complete_cell_measures(data: Measurements) -> Measurements:
    """Derived measures and ew_lw ("EW", "LW" or null) on the cells, eww and lww on the rings.

    The rings, and the rings with their boundaries, are written once to the shared folder: the windows over the cells run
    once, whatever reads the result and however often a sort of it does, and the cells meet widths and boundaries in one join.
    """
    rings = kept(data.rings, "rings")
    boundary = wood_boundary(cell_measures(data.cells, rings)).select(*RING_KEY, "max_ew_sector", "eww", "lww")
    bounded = kept(rings.join(boundary, RING_KEY, "left"), "bounded")
    label = X.if_else(F.col("sector100") <= F.col("max_ew_sector"), F.lit("EW"), F.lit("LW"))
    measured = _measured(data.cells.drop(CELL_NR).join(bounded.select(*RING_KEY, "mrw", "max_ew_sector"), RING_KEY, "left"))
    return Measurements(measured.withColumn("ew_lw", label).drop("max_ew_sector", "mrw"), bounded.drop("max_ew_sector"))


# -- rings log and dating ---------------------------------------------------------------------


def complete_rings_log(data: Measurements) -> DataFrame:
    """Union of the rings that have cells and those that are listed, with cno and mean_cwttan.

    woodpiece_label and slide_label are filled within an image; a ring without cells has cno 0.
    """
    counts = data.cells.groupBy(*RING_KEY).agg(F.count(F.lit(1)).cast("int").alias("cno"), F.avg("cwttan").alias("mean_cwttan"))
    log = counts.join(data.rings, RING_KEY, "full")
    # rings with cells come first in an image, as they do when the listed ones are appended
    order = [F.col("cno").isNull().asc(), F.col("year").asc_nulls_last()]
    filled = {c: X.fill_both_ways(F.col(c), "image_label", order) for c in ("woodpiece_label", "slide_label")}
    return log.withColumns(filled).withColumn("cno", F.coalesce("cno", F.lit(0)))


def cwt_estimates(log: DataFrame) -> DataFrame:
    """Images (image_label) without any wall thickness; empty if all have one."""
    return log.groupBy("image_label").agg(F.count("mean_cwttan").alias("n")).filter("n = 0").select("image_label")


#: Gaps of more years are told as one row by dating_issues.
LONG_GAP = 1000
#: Years of a gap that are laid out at a time.
_STRETCH = 4096


def year_gaps(log: DataFrame) -> DataFrame:
    """(image_label, first, last) of each run of years that is missing between an image's first and last."""
    if log.schema["year"].dataType.simpleString() not in ("int", "bigint", "smallint"):
        raise ValueError("year must be a whole number")
    year = F.col("year").cast("long")
    after = F.lead(year).over(Window.partitionBy("image_label").orderBy("year"))
    return log.filter("year IS NOT NULL").select("image_label", (year + 1).alias("first"), (after - 1).alias("last")).filter("last >= first")


def gap_years(gaps: DataFrame) -> DataFrame:
    """(image_label, year) of the years of gaps; a long one is laid out in stretches, so no row holds all its years."""
    stretch = gaps.withColumn("start", F.explode(F.expr(f"sequence(first, last, {_STRETCH})")))
    each = F.explode(F.sequence("start", F.least(F.col("start") + (_STRETCH - 1), "last")))
    return stretch.select("image_label", each.alias("year")).withColumn("year", F.col("year").cast("int"))


def complete_years(log: DataFrame) -> DataFrame:
    """The log plus a row for each year that is missing between an image's first and last.

    Added rows have missing_year true and cno 0, others false; labels are filled per image.
    """
    gaps = gap_years(year_gaps(log)).withColumns({"missing_year": F.lit(True), "cno": F.lit(0)})
    whole = log.withColumn("missing_year", F.lit(False)).unionByName(gaps, allowMissingColumns=True)
    order = [F.col("year").asc_nulls_last()]
    return whole.withColumns({c: X.fill_both_ways(F.col(c), "image_label", order) for c in ("woodpiece_label", "slide_label")})


def dating_issues(log: DataFrame, meta: DataFrame, current_year: int) -> DataFrame:
    """(image_label, year, issues) of rings with doubtful dates; issues are comma-joined.

    Of several rings with one image and year all but one are duplicates. A gap of more than LONG_GAP years, such as a mistyped year
    makes, is one row: its first year, and "missing until" its last, which is what the other checks look at.
    """
    nr = F.row_number().over(Window.partitionBy(*RING_KEY).orderBy("cno"))
    gaps = year_gaps(log)
    long = F.col("last") - F.col("first") >= LONG_GAP
    none = F.lit(False)
    rows = log.select(*RING_KEY, F.col("year").alias("until"), none.alias("missing"), (F.col("year").isNotNull() & (nr > 1)).alias("dupl_year"))
    rows = rows.unionByName(gap_years(gaps.filter(~long)).select(*RING_KEY, F.col("year").alias("until"), F.lit(True).alias("missing"), none.alias("dupl_year")))
    rows = rows.unionByName(gaps.filter(long).select("image_label", F.col("first").cast("int").alias("year"), F.col("last").cast("int").alias("until"), F.lit(True).alias("missing"), none.alias("dupl_year")))
    dated = rows.join(meta.select("image_label", "outmost_year"), "image_label", "left")
    named = [
        (F.col("missing") & (F.col("until") > F.col("year")), F.concat(F.lit("missing until "), F.col("until").cast("string"))),
        (F.col("missing") & (F.col("until") == F.col("year")), F.lit("missing")),
        (F.col("dupl_year"), F.lit("duplicate")),
        (F.col("year").isNull(), F.lit("undated")),
        (F.col("until") > current_year, F.lit("in future")),
        (F.col("until") > F.col("outmost_year"), F.lit("after outmost")),
    ]
    issues = F.concat_ws(", ", *(F.when(cond, name) for cond, name in named))
    return dated.select(*RING_KEY, issues.alias("issues")).filter("issues <> ''")


def dating_lines(issues: DataFrame, shown: int = 9) -> list[str]:
    """The first issues as text, and "..." if there are more."""
    return head_lines(issues, F.concat("image_label", F.lit(", "), F.coalesce(F.col("year").cast("string"), F.lit("None")), F.lit(": "), "issues"), ["image_label", "year"], shown)


class DatingError(ValueError):
    """Raised for rings with doubtful dates."""


def assert_dated(log: DataFrame, meta: DataFrame, current_year: int, shown: int = 9) -> None:
    lines = dating_lines(dating_issues(log, meta, current_year), shown)
    if lines:
        raise DatingError("rings with dating issues:\n" + "\n".join(lines))


# -- incomplete innermost rings -----------------------------------------------------------------


def ring_ends(log: DataFrame) -> DataFrame:
    """Adds innermost_ring and outermost_ring; null in an image with an undated ring."""
    w = Window.partitionBy("image_label")
    year = F.col("year")
    return log.withColumns({"innermost_ring": year == X.strict_min_over(year, w), "outermost_ring": year == X.strict_max_over(year, w)})


def innermost_stats(log: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Statistics of each image's innermost ring: mae, medYleft, medYright, rp, rp10, rp90, mindist,
    incomplete_inner and incomplete_innerv2.

    Positions follow xpix (nulls last, then ypix and raddistr). The outer tenths are rounded half
    to even and have one cell at least. A ring without cells or xpix has no statistics and counts
    as incomplete by either rule.
    """
    inner = ring_ends(log).filter("innermost_ring").select(*RING_KEY).distinct()
    df = inner.join(cells.select(*RING_KEY, "xpix", "ypix", "raddistr"), RING_KEY, "left").join(meta.select("image_label", F.col("spatial_resolution").alias("res")), "image_label", "left")
    whole = Window.partitionBy(*RING_KEY)
    order = whole.orderBy(F.col("xpix").asc_nulls_last(), F.col("ypix").asc_nulls_last(), F.col("raddistr").asc_nulls_last())
    df = df.withColumns(
        {
            "pos": F.row_number().over(order),
            "n": F.count(F.lit(1)).over(whole),
            "n_x": F.count("xpix").over(whole),
            "rank_x": F.when(F.col("xpix").isNotNull(), F.row_number().over(order)),
            "scal": F.avg(F.try_divide("raddistr", "ypix")).over(whole),
            "border": F.col("ypix") - F.col("raddistr") * F.col("res"),
        }
    )
    tiles = F.greatest(F.bround(F.col("n") / 50), F.lit(5))
    df = df.withColumns(
        {
            "tile": F.when(F.col("rank_x").isNotNull(), X.tile(F.col("rank_x"), F.col("n_x"), tiles)),
            "border2": F.col("ypix") - F.try_divide("raddistr", "scal"),
            "left_end": F.greatest(F.bround(F.col("n") / 10), F.lit(1)),
            "right_start": F.bround(F.col("n") / 10 * 9),
        }
    )
    lowest = df.withColumn("lowest", F.min("ypix").over(Window.partitionBy(*RING_KEY, "tile")))
    median = lambda c, cond: F.percentile(F.when(cond, F.col(c)), F.lit(0.5))
    left, right, every = F.col("pos") <= F.col("left_end"), F.col("pos") >= F.col("right_start"), F.lit(True)
    stats = lowest.groupBy(*RING_KEY).agg(
        F.avg(F.abs(F.col("border") / F.col("res"))).alias("mae"),
        (median("border", left) / F.first("res")).alias("medYleft"),
        (median("border", right) / F.first("res")).alias("medYright"),
        (median("border2", every) * F.first("scal")).alias("rp"),
        (median("border2", left) * F.first("scal")).alias("rp10"),
        (median("border2", right) * F.first("scal")).alias("rp90"),
        (F.min(F.when(F.col("ypix") == F.col("lowest"), F.col("border"))) / F.first("res")).alias("mindist"),
        F.max("n_x").alias("n_x"),
    )
    measured = F.col("n_x") > 0
    values = ["mae", "medYleft", "medYright", "rp", "rp10", "rp90", "mindist"]
    stats = stats.withColumns({c: F.when(measured, F.col(c)) for c in values})
    near = (F.col("mae") < 20) & (F.abs(F.col("medYleft") - F.col("medYright")) < 15)
    cut_off = (F.col("mae") > 20) & (F.col("mae") < 75) & (F.col("mindist") > 100)
    near2 = (F.col("rp") <= 10) & (F.abs(F.col("rp90") - F.col("rp10")) <= 10)
    return stats.select(
        *RING_KEY,
        *values,
        F.when(measured, near2).otherwise(True).alias("incomplete_inner"),
        F.when(measured, F.when(F.coalesce(cut_off, F.lit(False)), True).otherwise(near)).otherwise(True).alias("incomplete_innerv2"),
    )


def flag_incomplete_rings(log: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds the innermost statistics, incomplete_ring and incomplete_fct_check."""
    stats = innermost_stats(log, cells, meta).drop("rp", "rp10", "rp90")
    out = ring_ends(log).join(stats, RING_KEY, "left")
    incomplete = (F.col("outermost_ring") & F.col("mrw").isNull()) | F.col("incomplete_inner")
    return out.withColumns(
        {"incomplete_ring": F.coalesce(incomplete, F.lit(False)), "incomplete_fct_check": F.col("incomplete_inner") != F.col("incomplete_innerv2")}
    )


def flag_missing_rings(log: DataFrame) -> DataFrame:
    """Adds missing_ring (few cells or hardly any width) and no_MRW_other (no width though not an end ring)."""
    return log.withColumns(
        {
            "missing_ring": F.col("cno").isNull() | (F.col("cno") < LEAST_CELLS) | F.coalesce(F.col("mrw") < LEAST_WIDTH, F.lit(False)),
            "no_MRW_other": F.col("mrw").isNull() & ~(F.col("outermost_ring") | F.col("innermost_ring")),
        }
    )


def flag_duplicate_rings(log: DataFrame) -> DataFrame:
    """Adds duplicate_ring and exclude_dupl: of a woodpiece's rings of one year the one with the most cells stays.

    A missing or incomplete ring ranks 100 places later for each; ties go to the first image_label.
    """
    group = Window.partitionBy("woodpiece_label", "year")
    place = F.row_number().over(group.orderBy(F.col("cno").desc_nulls_last(), F.col("image_label").asc_nulls_last()))
    late = F.when(F.col("missing_ring"), 100).otherwise(0) + F.when(F.col("incomplete_ring"), 100).otherwise(0)
    ranked = log.withColumns({"duplicate_ring": F.count(F.lit(1)).over(group) > 1, "rank_": place + late})
    stays = ~F.col("duplicate_ring") | (F.col("rank_") == F.min("rank_").over(group))
    return ranked.withColumn("exclude_dupl", ~stays).drop("rank_")


def validated_rings(data: Measurements, meta: DataFrame, verbose: bool = False) -> DataFrame:
    """All flags in order, without the fatal dating check.

    The rings log, a row a ring, is written to the shared folder once, so that the cells are read for it and
    for the innermost rings only, however often the log is used.
    """
    log = kept(complete_rings_log(data), "log")
    return _flagged(log, data.cells, meta, verbose)


def _flagged(log: DataFrame, cells: DataFrame, meta: DataFrame, verbose: bool) -> DataFrame:
    flagged = flag_duplicate_rings(flag_missing_rings(flag_incomplete_rings(log, cells, meta)))
    flagged = flagged.withColumn("exclude_issues", F.col("incomplete_ring") | F.col("missing_ring")).drop("mean_cwttan")
    return flagged if verbose else flagged.drop(*HELPER_COLUMNS)


def validate_measurements(data: Measurements, meta: DataFrame, current_year: int, verbose: bool = False) -> Measurements:
    """Raises DatingError for doubtful dates; else the cells as they are and the flagged rings."""
    log = kept(complete_rings_log(data), "log")
    assert_dated(log, meta, current_year)
    return Measurements(data.cells, _flagged(log, data.cells, meta, verbose))


def issue_counts(rings: DataFrame, flags: list[str]) -> DataFrame:
    return rings.agg(*(F.count_if(F.col(c)).alias(c) for c in flags)).unpivot([], flags, "flag", "n")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)
