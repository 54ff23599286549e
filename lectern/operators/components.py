"""Connected components of pairs, in rounds whose number grows with the logarithm of the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.session import cut


def components(pairs: DataFrame) -> DataFrame:
    """group, node and part, the smallest node that it reaches. pairs: group, i, j (longs).

    Alternately every larger neighbour of a node is linked to its smallest one, and every smaller one to the smallest
    of those, until no link changes; minima are aggregated before their shuffle. Each round ends in a checkpoint.
    """
    keys = ["group", "u"]
    edges = cut(pairs.where("i <> j").select("group", F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).distinct())
    while not edges.isEmpty():
        before = _state(edges)
        both = edges.unionByName(edges.select("group", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.where("v > u").join(least, keys).select("group", F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy(*keys).agg(F.min("v").alias("m"))
        small = large.join(least, keys).where("v <> m").select("group", F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        if _state(edges) == before:
            break
    stars = edges.select("group", F.col("u").alias("node"), F.col("v").alias("part"))
    return stars.unionByName(edges.select("group", F.col("v").alias("node"), F.col("v").alias("part")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("group", "u", "v"))).first())
