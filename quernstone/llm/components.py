"""Connected components of links that lie in a table: alternating large stars and small stars, a few narrow shuffles a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v: long); root is the component's smallest node. Loops and nulls are no links; repeated links don't matter.

    Each round points a node's larger neighbours, then its smaller ones, at the smallest of its neighbours, until nothing changes.
    Rounds grow with the logarithm of the longest path. A node's smallest neighbour is found by partial aggregation and stored, so
    that it meets the node's links in a join of two plain exchanges, which can be split where a node has very many links. What a round
    leaves is removed after the next; the last one's rows, a row a node, stay in the shared folder.
    """
    spark = links.sparkSession
    edges, path = stored(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u", F.lit(1))).alias("y")).first()
        if now == before or not now.n:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large, large_path = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small_least, small_path = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(small_least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, (edges, path) = path, stored(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        removed(spark, old, least_path, large_path, small_path)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
