"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step replaces a node's edges by edges to its smallest neighbour, so the number of
steps grows with the logarithm of a component's size and no task ever holds a component:
the minimum of a node's neighbours is a partial aggregate, and joins on hub nodes are
sort-merge joins, which AQE splits when a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over ``(a, b)``, each undirected edge once. ``small``: only neighbours that are smaller count."""
    if small:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    joined = seen.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; the component is its smallest node.

    Self-edges and repeated edges change nothing; no edges give no rows.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").distinct())
    mark = None
    while True:
        large = materialize(_star(now, small=False))
        after = materialize(_star(large, small=True))
        release(now)
        release(large)
        now = after
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if got == mark:
            break
        mark = got
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
