"""Column builders for the semantics that the built-in functions don't have by themselves."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Names = str | list[str]


def clean_double(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(F.isnan(c), None).otherwise(c)


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    """Like when/otherwise, but a null condition gives null."""
    return F.when(cond.isNull(), None).when(cond, yes).otherwise(no)


def is_in(c: Column, values: list) -> Column:
    """Membership that is never null; a null is in the list only if the list has one."""
    known = [v for v in values if v is not None]
    inside = F.coalesce(c.isin(known), F.lit(False)) if known else F.lit(False)
    return inside | c.isNull() if len(known) < len(values) else inside


def right_closed_bin(c: Column, bins: int, upper: float = 100.0, slack: float = 1.0) -> Column:
    """1 .. bins for equal right-closed bins of [0, upper]; 0 is in the first, (upper, upper + slack] in the last.

    Outside and null: null. Where the width isn't a whole number the bin is counted off the
    edges, so that values at an edge fall as the edges are written.
    """
    width = upper / bins
    if width == int(width):
        inner = F.greatest(F.ceil(c / F.lit(width)).cast("int"), F.lit(1))
    else:
        edges = F.array(*(F.lit(k * width) for k in range(1, bins)))
        inner = (F.size(F.filter(edges, lambda b: c > b)) + 1).cast("int")
    return F.when((c > upper) & (c <= upper + slack), F.lit(bins)).when((c >= 0) & (c <= upper), inner)


def strict_min(c: Column) -> Column:
    """Least value, or null if any is null."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.min(c))


def strict_max(c: Column) -> Column:
    """Greatest value, or null if any is null."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.max(c))


def strict_min_over(c: Column, w: WindowSpec) -> Column:
    return F.when(F.count(F.lit(1)).over(w) == F.count(c).over(w), F.min(c).over(w))


def strict_max_over(c: Column, w: WindowSpec) -> Column:
    return F.when(F.count(F.lit(1)).over(w) == F.count(c).over(w), F.max(c).over(w))


def max_or_minus_infinity(value: Column, cond: Column) -> Column:
    """Greatest value where cond holds; minus infinity if there is none."""
    return F.coalesce(F.max(F.when(cond, value)).cast("double"), F.lit(-math.inf))


def distinct_with_null(c: Column) -> Column:
    """Number of distinct values, null being one."""
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def tile(row: Column, rows: Column, tiles: Column) -> Column:
    """ntile for a number of tiles that depends on the group: 1 .. tiles for row 1 .. rows."""
    size, more = F.floor(rows / tiles), rows % tiles
    early = F.floor((row - 1) / (size + 1)) + 1
    late = F.floor((row - more * (size + 1) - 1) / F.greatest(size, F.lit(1))) + more + 1
    return F.when(row <= more * (size + 1), early).otherwise(late).cast("int")


def fill_both_ways(c: Column, partition: Names, order: list) -> Column:
    """Nulls take the value before them, and where there is none the value after."""
    w = Window.partitionBy(partition).orderBy(*order)
    down = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    up = F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(down, up)


def centred_mean(c: Column, partition: Names, order: list, width: int, right: float) -> Column:
    """Rolling mean over `width` rows around each; null for the first width // 2 rows, `right` for the last."""
    half = width // 2
    w = Window.partitionBy(partition).orderBy(*order)
    rn, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(partition))
    return F.when(rn <= half, None).when(n - rn < half, F.lit(right)).otherwise(F.avg(c).over(w.rowsBetween(-half, half)))


def listed(c: Column, oxford: bool = False) -> Column:
    """Text of a sorted array: "a", "a and b", "a, b and c"."""
    n = F.size(c)
    before = F.array_join(F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.when(n > 2, F.lit(", and ")).otherwise(F.lit(" and ")) if oxford else F.lit(" and ")
    return F.when(n == 0, F.lit("")).when(n == 1, F.element_at(c, 1)).otherwise(F.concat(before, last, F.element_at(c, -1)))


#: Moves values off ties, in proportion to their size.
OFF_TIES = 1.000000001


def significant(c: Column) -> Column:
    """To the 24 bits of a float, some seven significant digits, with -0.0 as 0.0: one instruction, where rounding to decimals
    costs more than what is rounded."""
    return (c * OFF_TIES).cast("float").cast("double") + F.lit(0.0)
