"""Radial sector profiles and chronologies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.functions import expr as X
from cambium.sources.scratch import kept

from .model import RING_KEY, require
from .selection import medians


def quantile_name(param: str, prob: float) -> str:
    """{param}_q{percent}, with the decimal point as an underscore."""
    return f"{param}_q{f'{prob * 100:g}'.replace('.', '_')}"


def calculate_profiles(cells: DataFrame, sectors: int, params: list[str], probs: list[float] | None = None) -> DataFrame:
    """Per image, year and sector: the mean and the quantiles (linear interpolation) of each parameter.

    One grouping makes both. Cells outside the sectors are left out; without probs there are
    only means.
    """
    require(cells, [*RING_KEY, "rraddistr", *params], "calculate_profiles")
    binned = cells.select(*RING_KEY, X.right_closed_bin(F.col("rraddistr"), sectors).alias("sector_n"), *params).filter("sector_n IS NOT NULL")
    aggs = [F.avg(p).alias(f"{p}_mean") for p in params]
    probs = list(probs or [])
    if probs:
        aggs += [F.percentile(p, F.array(*map(F.lit, probs))).alias(f"{p}_q") for p in params]
    out = binned.groupBy(*RING_KEY, "sector_n").agg(*aggs)
    quantiles = [F.col(f"{p}_q")[k].alias(quantile_name(p, q)) for p in params for k, q in enumerate(probs)]
    return out.select(*RING_KEY, "sector_n", *(f"{p}_mean" for p in params), *quantiles)


def chronology_series(rings: DataFrame, param: str, profiles: DataFrame | None = None, sector: int | None = None, show_excluded: bool = False) -> DataFrame:
    """One value per kept ring: woodpiece_label, image_label, year, exclude_issues and the parameter.

    A parameter of the profiles is taken from one sector. Excluded duplicates are left out;
    rings with issues have no value unless show_excluded.
    """
    ids = ["woodpiece_label", *RING_KEY, "exclude_dupl", "exclude_issues"]
    if profiles is not None and param in profiles.columns:
        one = profiles.filter(F.col("sector_n") == sector).select(*RING_KEY, param)
        base = rings.select(*ids).join(one, RING_KEY, "left")
    else:
        base = rings.select(*ids, param)
    kept = base.filter(~F.col("exclude_dupl"))
    value = F.col(param) if show_excluded else F.when(F.col("exclude_issues"), None).otherwise(F.col(param))
    return kept.select("woodpiece_label", *RING_KEY, "exclude_issues", value.alias(param))


def biweight(values: DataFrame, keys: list[str], param: str, c: float = 9.0, tiny: float = 1e-6) -> DataFrame:
    """Tukey's biweight robust mean of each group, nulls left out: keys and `value`.

    Two medians (exact, by narrowing where a group is large) and the weighted mean are groupings over values that are
    written once; their small results are joined back, so no group's rows have to meet in one task.
    """
    known = kept(values.dropna(subset=keys).filter(F.col(param).isNotNull() & ~F.isnan(param)).select(*keys, F.col(param).cast("double").alias("x")), "values")
    centred = known.join(medians(known, keys).withColumnRenamed("median", "m"), keys)
    away = kept(centred.select(*keys, "m", F.col("x").alias("value"), F.abs(F.col("x") - F.col("m")).alias("x")), "deviations")
    spread = away.join(medians(away.select(*keys, "x"), keys).withColumnRenamed("median", "s"), keys).drop("x").withColumnRenamed("value", "x")
    u = (F.col("x") - F.col("m")) / (F.col("s") * c + tiny)
    weight = F.when(F.abs(u) <= 1, F.pow(1 - u * u, F.lit(2))).otherwise(0.0)
    weighed = spread.withColumn("w", weight)
    return weighed.groupBy(*keys).agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("value"))


def chronology_mean(series: DataFrame, param: str, woodpieces: list[str] | None = None, method: str = "mean") -> DataFrame:
    """Per year: the mean or the biweight mean (`value`) over the chosen woodpieces' rings without issues."""
    chosen = series.filter(~F.col("exclude_issues"))
    if woodpieces is not None:
        chosen = chosen.filter(X.is_in(F.col("woodpiece_label"), woodpieces))
    if method == "mean":
        return chosen.groupBy("year").agg(F.avg(param).alias("value"))
    if method == "tbrm":
        return biweight(chosen, ["year"], param)
    raise ValueError(f"unknown method {method}")


def changed_exclusions(original: DataFrame, edited: DataFrame, series: DataFrame, param: str, woodpieces: list[str]) -> DataFrame:
    """(year, y, woodpiece_label) of the plotted rings whose exclusion was changed by edits."""
    chosen = edited.filter(X.is_in(F.col("woodpiece_label"), woodpieces)).select(*RING_KEY, "exclude_issues")
    o = original.select(*(F.col(c).alias(f"o_{c}") for c in [*RING_KEY, "exclude_issues"]))
    same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in [*RING_KEY, "exclude_issues"]]
    new = chosen.join(o, same, "left_anti").select(*RING_KEY)
    return series.join(new, RING_KEY).select("year", F.col(param).alias("y"), "woodpiece_label")
