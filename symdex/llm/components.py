"""Connected components by alternating stars, with written tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symdex.llm.common import shared_folder


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, root), the least node of each component; nodes without an edge do not appear.

    Each round points the neighbours of a node to its least neighbour, first the
    larger ones, then the smaller ones, until nothing changes; the rounds grow with
    the logarithm of the longest chain.  A hub's neighbours are reduced by a
    partial minimum and joined, never gathered.
    """
    shared_folder(edges.sparkSession)
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    last = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        pairs = small.select("e.a", "e.b").where("a <> b").distinct().checkpoint()
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
