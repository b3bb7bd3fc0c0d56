"""Connected components by repeated contraction of the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the smallest node reachable.

    Each round ranks the nodes, every node takes the first of itself and its neighbours as its
    label, and the edges are carried over to the labels, without loops and repeats. Rounds by id, which
    contract stars around small ids at once, take turns with rounds by a new hash of the ids; in such a random
    order a third of the nodes at least are expected to go whatever the graph looks like, so a path of n nodes with
    rising ids takes about 2 log n rounds. What is left at the end is one node a component, and the
    smallest of its members is looked up.

    All joins are by shuffle: labels grow with the edges, and a broadcast of each round's would stay on the driver.

    Null ends and loops are no edges; repeated edges count once. Empty input: no rows.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct())
    steps = []
    while not edges.isEmpty():
        ranked = lambda c, nr=len(steps): F.struct((F.xxhash64(F.lit(nr), c) if nr % 2 else F.lit(0)).alias("rank"), F.col(c).alias("node"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(F.min(ranked("b")), ranked("a"))["node"]
        label = stored(both.groupBy("a").agg(first.alias("label")).withColumnRenamed("a", "node"))
        steps.append(label)
        of = lambda end: label.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")).hint("merge")  # noqa: B023, E731
        edges = stored(
            edges.join(of("a"), "a")
            .join(of("b"), "b")
            .select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
            .filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = steps[-1]
    for nr, label in enumerate(reversed(steps[:-1])):  # a label that isn't a node of the next round is final
        nxt = out.select(F.col("node").alias("label"), F.col("label").alias("next")).hint("merge")
        out = label.join(nxt, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        out = stored(out) if nr % 4 == 3 else out  # so that no plan grows with the rounds
    out = stored(out)
    least = out.groupBy("label").agg(F.min("node").alias("component"))
    return out.join(least.hint("merge"), "label").select("node", "component")
