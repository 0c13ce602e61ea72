"""Connected components of a large edge list by alternating star contraction.

Every round is a handful of joins and aggregations written to the shared folder; nothing is collected. A node with
very many edges costs no task more than a pre-aggregated minimum and a streamed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.session import freeze


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node it is connected with) for every node of ``edges``; loops and repeated
    edges are allowed, null ends are not connected with anything."""
    # edges point from the larger node to the smaller
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u <> v").distinct()
    pairs = freeze(pairs, "edges")
    while True:
        # large star: each node's larger neighbours point to the smallest node around it
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = freeze(large.distinct(), "large")
        # small star: each node and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = freeze(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        # done once every node points at a node that points nowhere, that is: nothing changes any more
        done = after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        pairs = after
        if done:
            break
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
