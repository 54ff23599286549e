"""What to study next.

Three kinds of candidates are made by joins over all users at once; a medium keeps its first kind, and each user
the most urgent ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def urgency(score: Column) -> Column:
    """critical below 40, high below 60, else medium."""
    return F.when(score < 40, "critical").when(score < 60, "high").otherwise("medium")


def lowest(sessions: DataFrame, least: float = 70.0, limit: int | None = None) -> DataFrame:
    """Each medium's lowest score where it is below the mark, with limit each user's lowest ones (A5)."""
    worst = sessions.groupBy("user_id", "media_id").agg(F.min("accuracy_score").alias("worst_score")).where(F.col("worst_score") < least)
    if limit is not None:
        order = Window.partitionBy("user_id").orderBy("worst_score", "media_id")
        worst = worst.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit).drop("_rn")
    return worst


def worst_quizzes(sessions: DataFrame, titles: DataFrame, least: float = 70.0, limit: int | None = None) -> DataFrame:
    """Each medium's lowest score where it is below the mark, with title and urgency."""
    return lowest(sessions, least, limit).join(titles, ["user_id", "media_id"]).select("user_id", "media_id", "title", "worst_score", urgency(F.col("worst_score")).alias("urgency"))


def material(media: DataFrame, cards: DataFrame, questions: DataFrame) -> DataFrame:
    """user_id, media_id and the counts of cards and questions, for media that have any."""
    c = cards.groupBy("media_id").agg(F.count("*").alias("cards"))
    q = questions.groupBy("media_id").agg(F.count("*").alias("questions"))
    both = c.join(q, "media_id", "full").select("media_id", F.coalesce("cards", F.lit(0)).alias("cards"), F.coalesce("questions", F.lit(0)).alias("questions"))
    return media.select("user_id", F.col("id").alias("media_id")).join(both, "media_id")


def untested(material_: DataFrame, sessions: DataFrame) -> DataFrame:
    """Media with material but without a quiz session of their user."""
    return material_.join(sessions.select("user_id", "media_id").distinct(), ["user_id", "media_id"], "left_anti")


def unreviewed(material_: DataFrame, progress: DataFrame) -> DataFrame:
    """Media with flashcards that their user never reviewed."""
    seen = progress.where("item_type = 'flashcard'").select("user_id", "media_id").distinct()
    return material_.where("cards > 0").join(seen, ["user_id", "media_id"], "left_anti")


def recommendations(media: DataFrame, titles: DataFrame, sessions: DataFrame, cards: DataFrame, questions: DataFrame, progress: DataFrame, limit: int = 5) -> DataFrame:
    """Each user's recommendations in order."""
    have = material(media, cards, questions)
    there = media.select("user_id", F.col("id").alias("media_id"))  # titles are built once, for the few that stay
    worst = lowest(sessions, limit=limit).join(there, ["user_id", "media_id"], "left_semi").withColumn("urgency", urgency(F.col("worst_score")))
    worst = worst.select("user_id", "media_id", F.lit(1).alias("pass"), "urgency", F.lit("low_score").alias("type"), F.col("worst_score").alias("score"), F.concat(F.lit("Scored "), F.round("worst_score").cast("int"), F.lit("% — needs revision")).alias("reason"))
    second = untested(have, sessions).select("user_id", "media_id", F.lit(2).alias("pass"), F.lit("medium").alias("urgency"), F.lit("untested").alias("type"), F.lit(0.0).alias("score"), F.concat("questions", F.lit(" quiz questions — never attempted")).alias("reason"))
    third = unreviewed(have, progress).select("user_id", "media_id", F.lit(3).alias("pass"), F.lit("low").alias("urgency"), F.lit("unreviewed").alias("type"), F.lit(0.0).alias("score"), F.concat("cards", F.lit(" flashcards — never reviewed")).alias("reason"))
    first = Window.partitionBy("user_id", "media_id").orderBy("pass")
    one = worst.unionByName(second).unionByName(third).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    rank = F.when(F.col("urgency") == "critical", 0).when(F.col("urgency") == "high", 1).when(F.col("urgency") == "medium", 2).otherwise(3)
    order = Window.partitionBy("user_id").orderBy(rank, "score", "pass", "media_id")
    top = one.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return top.join(titles.select("user_id", "media_id", "title"), ["user_id", "media_id"]).select("user_id", "position", "media_id", "title", "reason", "urgency", "type", "score")
