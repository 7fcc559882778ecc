"""Connected components by alternating large and small stars, on DataFrames alone.

Each round replaces the edges of a node by edges to the smallest neighbour; the
neighbours of a node are never gathered, only joined with their minimum, so a
node with very many neighbours is a skewed join that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation; edges are (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("least", "a"))
        joined = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        joined = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return joined.where(F.col("a") > F.col("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node of its component.

    Links may repeat and stand in either order; those from a node to itself and
    those with nulls are left out. Values must be numbers. An empty input gives
    no rows. Each round is written to the checkpoint folder.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = cut(edges), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = cut(_star(_star(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
