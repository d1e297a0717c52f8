"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylight.workspace import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of ``edges`` (a, b: longs).

    Each round points every node's larger neighbours, then all its smaller ones, at the
    smallest node it knows. A round moves at most two rows per edge; paths shrink by more
    than half in each, so few rounds are needed. Every round is written, so nothing is redone if
    an executor goes. A node with very many neighbours is reduced to one row where it is
    grouped, and its edges meet that row in a join that Spark splits.
    """
    # Edges point from the larger node to the smaller.
    down = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        seen = down.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written before they are joined: the join then gets both sides freshly dealt and can split a hot node.
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # Large star: larger neighbours of u point at the smallest.
        large = written(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        # Small star: u and its smaller neighbours point at the smallest of them.
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        down = written(small, "stars")
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
