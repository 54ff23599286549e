"""The concept graph of a lecture: nodes, edges, pruning, centrality.

All of it is grouped by medium; co-occurrence joins on the frame, so its pairs stay within one frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import title, words


def frequency(mentions: DataFrame) -> DataFrame:
    """media_id, concept, freq and first, the place of the first mention (A16). mentions: media_id, frame_id, pos, concept."""
    return mentions.groupBy("media_id", "concept").agg(F.count("*").alias("freq"), F.min(F.struct("frame_id", "pos", "concept")).alias("first"))


def with_topics(mentions: DataFrame, topics: DataFrame, definitions: DataFrame | None = None, most_words: int = 5) -> DataFrame:
    """Mentions, defined terms and short topics, which all count as concepts.

    topics: media_id, pos, topic; definitions: media_id, term, definition. Both come after all frames, so that they
    don't come first and, each in a frame of its own, make no pairs.
    """
    after = lambda kind: F.xxhash64("concept", F.lit(kind)) % (1 << 20) + F.lit((2 * kind + 2) << 40)
    out = mentions.select("media_id", "frame_id", "pos", "concept")
    short = topics.where((words(F.col("topic")) <= most_words) & (F.trim("topic") != "")).select("media_id", F.col("pos").cast("int").alias("pos"), F.lower(F.trim("topic")).alias("concept"))
    out = out.unionByName(short.withColumn("frame_id", after(1)).select(*out.columns))
    if definitions is not None:
        d = definitions.where((F.trim("term") != "") & (F.trim("definition") != "")).select("media_id", F.lit(0).alias("pos"), F.lower(F.trim("term")).alias("concept"))
        out = out.unionByName(d.withColumn("frame_id", after(0)).select(*out.columns))
    return out


def cooccurrence(mentions: DataFrame, min_weight: int = 1) -> DataFrame:
    """Pairs a < b and the number of frames that hold both."""
    one = mentions.select("media_id", "frame_id", "concept").distinct()
    a, b = one.withColumnRenamed("concept", "a"), one.withColumnRenamed("concept", "b")
    pairs = a.join(b, ["media_id", "frame_id"]).where("a < b")
    return pairs.groupBy("media_id", "a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)


def nodes(mentions: DataFrame, definitions: DataFrame | None = None, lectures: DataFrame | None = None) -> DataFrame:
    """media_id, node, label, type, freq (G1). definitions: media_id, term, definition; lectures: media_id, title."""
    kinds = frequency(mentions).select("media_id", F.col("concept").alias("node"), title(F.col("concept")).alias("label"), F.lit("concept").alias("type"), F.col("freq"))
    if definitions is not None:
        d = definitions.groupBy("media_id", "term").agg(F.max("definition").alias("d"), F.count("*").alias("freq"))
        kinds = kinds.unionByName(d.select("media_id", F.concat(F.lit("def:"), "term").alias("node"), F.substring("d", 1, 80).alias("label"), F.lit("definition").alias("type"), "freq"))
    if lectures is not None:
        kinds = kinds.unionByName(lectures.select("media_id", F.lit("__lecture__").alias("node"), F.col("title").alias("label"), F.lit("lecture").alias("type"), F.lit(1).cast("long").alias("freq")))
    return kinds


def defines(definitions: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Edges from a term's node to its definition's."""
    there = nodes_.where("type = 'concept'").select("media_id", F.col("node").alias("term"))
    return definitions.select("media_id", "term").distinct().join(there, ["media_id", "term"], "left_semi").select("media_id", F.col("term").alias("a"), F.concat(F.lit("def:"), "term").alias("b"), F.lit(1).cast("long").alias("weight"))


def covers(topics: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Edges from the lecture to topics that are nodes."""
    there = nodes_.where("type = 'concept'").select("media_id", F.col("node").alias("b"))
    return topics.select("media_id", F.lower("topic").alias("b")).distinct().join(there, ["media_id", "b"], "left_semi").select("media_id", F.lit("__lecture__").alias("a"), "b", F.lit(1).cast("long").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node."""
    ends = edges.select("media_id", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("media_id", "node").agg(F.count("*").alias("degree"))


def pruned(mentions: DataFrame, edges: DataFrame, most: int = 80) -> DataFrame:
    """The nodes of highest degree of each medium, ties by first mention."""
    f = frequency(mentions).withColumnRenamed("concept", "node")
    d = f.join(degrees(edges), ["media_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy("media_id").orderBy(F.desc("degree"), "first")
    return d.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select("media_id", "node", "freq", "degree", "position")


def among(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends kept."""
    for end in ("a", "b"):
        edges = edges.join(kept.select("media_id", F.col("node").alias(end)), ["media_id", end], "left_semi")
    return edges


def central(mentions: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The n concepts of highest degree centrality, degree / (nodes - 1)."""
    f = frequency(mentions).withColumnRenamed("concept", "node")
    d = f.join(degrees(edges), ["media_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    d = d.withColumn("centrality", F.round(F.col("degree") / F.greatest(F.count("*").over(Window.partitionBy("media_id")) - 1, F.lit(1)), 6))
    order = Window.partitionBy("media_id").orderBy(F.desc("centrality"), F.desc("freq"), "node")
    return d.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n).select("media_id", "position", "node", "freq", "centrality")


def exported(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """Links by dense index, as a force layout takes them."""
    index = kept.select("media_id", "node", (F.col("position") - 1).alias("at"))
    out = edges.join(index.withColumnsRenamed({"node": "a", "at": "source"}), ["media_id", "a"]).join(index.withColumnsRenamed({"node": "b", "at": "target"}), ["media_id", "b"])
    return out.select("media_id", "source", "target", F.lit("co_occurs").alias("relation"), "weight")
