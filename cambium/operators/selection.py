"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.sources.scratch import kept

#: Values of a group that may meet in one task.
MOST = 100_000
#: Quantiles that a round's sketch is asked for, and its accuracy.
_STEPS, _ACCURACY = 200, 4000
#: Groups whose state is broadcast.
_BROADCAST_ROWS = 1_000_000


def _joined(values: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return values.join(F.broadcast(groups) if groups.count() <= _BROADCAST_ROWS else groups, keys)


def medians(values: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """keys and `median` of the column x (no nulls, no NaN) of a stored table.

    Groups of up to `most` values are sorted in one task. Of a larger one no more than that ever meets: a sketch with
    map-side combining names two values around the middle, the values below, at and between them are counted exactly,
    and the round after goes on with those between. Values equal to one of the two are counted, not carried, so a value that
    very many rows share ends the search. A round leaves about one in fifty.
    """
    most = MOST if most is None else most
    sizes = kept(values.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    median = F.percentile("x", F.lit(0.5)).alias("median")
    large = sizes.filter(F.col("n") > most)
    if large.isEmpty():
        return values.groupBy(*keys).agg(median)
    rest = kept(_joined(values, large, keys).select(*keys, "x"), "narrowed")
    # ranks of the two middle values among what is left, and those that have been found
    state = kept(large.select(*keys, "n", F.expr("(n - 1) div 2").alias("r1"), F.expr("n div 2").alias("r2"), *(F.lit(None).cast("double").alias(v) for v in ("v1", "v2"))), "middle")
    found = []
    while not state.isEmpty():
        state, rest, done = _round(state, rest, keys, most)
        found.append(done)
    out = _joined(values, sizes.filter(F.col("n") <= most), keys).groupBy(*keys).agg(median)
    for done in found:
        out = out.unionByName(done.select(*keys, (0.5 * F.col("v1") + 0.5 * F.col("v2")).alias("median")))
    return out


def _round(state: DataFrame, rest: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The open groups after a round, the values that they go on with, and the groups that are done."""
    grid = [k / _STEPS for k in range(1, _STEPS)]
    sketch = rest.groupBy(*keys).agg(F.percentile_approx("x", grid, _ACCURACY).alias("q"))
    # one step below the first middle rank and one above the second, where the grid goes so far
    near = lambda r, add: F.floor(F.col(r) / F.col("n") * _STEPS).cast("int") - 1 + add
    at = lambda i: F.get("q", F.greatest(F.lit(0), F.least(F.lit(_STEPS - 2), i)))
    bounds = kept(state.join(sketch, keys).select(*state.columns, at(near("r1", -1)).alias("a"), at(near("r2", 2)).alias("b")), "bounds")
    zone = F.when(F.col("x") < F.col("a"), 0).when(F.col("x") == F.col("a"), 1).when(F.col("x") < F.col("b"), 2).when(F.col("x") == F.col("b"), 3).otherwise(4)
    counted = _joined(rest, bounds.select(*keys, "a", "b"), keys).groupBy(*keys).agg(*(F.count(F.when(zone == z, 1)).alias(f"n{z}") for z in range(5)))
    # in which zone each rank lies: below a, at a, between, at b, above b; the counts are exact, so this holds whatever the sketch said
    below = [sum((F.col(f"n{k}") for k in range(z)), F.lit(0)) for z in range(5)]
    placed = bounds.join(counted, keys)
    for v, r in (("v1", "r1"), ("v2", "r2")):
        in_zone = F.when(F.col(v).isNotNull(), F.lit(None))
        for z in range(4, -1, -1):
            in_zone = in_zone.when(F.col(r) >= below[z], F.lit(z))
        placed = placed.withColumn(f"z_{v}", in_zone).withColumn(v, F.coalesce(v, F.when(F.col(f"z_{v}") == 1, F.col("a")).when(F.col(f"z_{v}") == 3, F.col("b"))))
    # the zones at a and b lie between the open ones, so the ranks that are still sought are in one of those
    open_zone = F.coalesce(*(F.when(F.col(v).isNull(), F.col(f"z_{v}")) for v in ("v1", "v2")))
    placed = kept(placed.withColumn("z", open_zone), "placed")
    of_zone = lambda items: F.element_at(F.array(*items), F.col("z") + 1)
    going = placed.filter("z IS NOT NULL").select(
        *keys, of_zone([F.col(f"n{k}") for k in range(5)]).alias("n"), (F.col("r1") - of_zone(below)).alias("r1"), (F.col("r2") - of_zone(below)).alias("r2"), "v1", "v2", "a", "b", "z"
    )
    going = kept(going, "going")
    rest = kept(_joined(rest, going.select(*keys, "a", "b", "z"), keys).filter(zone == F.col("z")).select(*keys, "x"), "narrowed")
    small = going.filter(F.col("n") <= most)
    lists = _joined(rest, small.select(*keys), keys).groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("xs"))  # `most` values at most
    ended = small.join(lists, keys).select(*keys, *(F.coalesce(v, F.get("xs", F.col(r).cast("int"))).alias(v) for v, r in (("v1", "r1"), ("v2", "r2"))))
    done = kept(placed.filter("z IS NULL").select(*keys, "v1", "v2").unionByName(ended), "medians")
    return kept(going.filter(F.col("n") > most).select(*keys, "n", "r1", "r2", "v1", "v2"), "middle"), rest, done
