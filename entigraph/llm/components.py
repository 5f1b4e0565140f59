"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, materialize_observed


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a table, with their number and the sum of their hashes: equal sets have equal ones."""
    return materialize_observed(edges, "edges", F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))


def connected_components(edges: DataFrame, one: str, two: str) -> DataFrame:
    """The least node of each node's component, for all nodes with an edge to another one.

    Each round links every node's larger neighbours, then its smaller ones, to the least of them; a stable edge set is
    one star for each component. Rounds grow with the logarithm of the longest path. Edges with a null end or to
    themselves are ignored. No edges: no rows.

    Returns node, root.
    """
    u, v = F.greatest(F.col(one), F.col(two)), F.least(F.col(one), F.col(two))
    edges, state = _written(edges.where(F.col(one) != F.col(two)).select(u.alias("u"), v.alias("v")).distinct())
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are a table of their own, so that the join is a plain one and a hub's edges can be dealt to many tasks.
        least = materialize(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = _written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
