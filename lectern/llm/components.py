"""Connected components by alternating large and small stars, each round cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node it reaches, for each node of an edge. edges: u long, v long.

    A round first links the larger neighbours of each node to its smallest one, then each node and its smaller
    neighbours to the smallest of those. It ends when every component is a star around its smallest node, after
    a number of rounds that grows with the logarithm of the nodes. Without edges there are none. No neighbourhood is gathered in one place:
    minima are aggregated before the shuffle, and a frequent node's edges are spread.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = written(lookup(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = lookup(large, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        small = written(small, "edges")
        counts = [x.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first() for x in (edges, small)]
        edges = small
        if counts[0] == counts[1]:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
