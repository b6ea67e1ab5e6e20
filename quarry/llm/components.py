"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node (partially aggregated) joined back to the edges,
so a hub with a third of all edges is a skewed join key, not one task's group.
Every round is written to the shared folder; no edge or label reaches the driver
but whether a node is left that is no leaf of a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge (u, v); the label is the component's least node."""
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = _both(now)
        least = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("down"), F.count_if(F.col("v") > F.col("u")).alias("up"))
        least = cut(least, "least")
        # stars: every node has one edge down and none up, or none down
        if least.where("down > 1 or (down > 0 and up > 0)").isEmpty():
            break
        roots = least.select("k", F.least("k", "m").alias("m"))
        large = both.where("v > u").join(roots, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = cut(_small_star(large), "edges")
    return least.select(F.col("k").alias("node"), F.least("k", "m").alias("label"))
