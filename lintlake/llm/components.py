"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """rep, component for every node of the edges (a, b); the component is its smallest node.

    Each round links the larger neighbours of every node to its smallest neighbour, then the smaller ones; edges only move
    towards smaller nodes and their number never grows. Rounds are logarithmic in the size. Neighbours are never gathered:
    minima are aggregates, and a node with very many edges is a skewed join that Spark splits. Raises if it doesn't settle.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, "stars")
    for _ in range(most_rounds):
        # Settled: every node has one edge, to a node that has none.
        roles = pairs.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            pairs.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count():
            return pairs.select(F.col("u").alias("rep"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("rep"), F.col("v").alias("component")).distinct())
        # Large star: of every node, the larger neighbours go to the smallest of the neighbourhood.
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: of every node, it and its smaller neighbours go to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = stored(small.where("u <> v").distinct(), "stars")
    raise RuntimeError("components did not settle")
