"""A user's engagement: reviews, confidence, quiz history and accuracy, card summaries.

The progress table is read once for all its counts, by conditional aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(correct: Column, total: Column) -> Column:
    """Percentage, 0 for no questions."""
    return F.when(total > 0, correct / total * 100).otherwise(0.0)


def progress_summary(progress: DataFrame) -> DataFrame:
    """For each user the counts of reviews and the average confidence (A2, A3)."""
    p = progress.groupBy("user_id").agg(
        F.count("*").alias("total_reviews"), F.count_if("correct").alias("correct_count"), F.count_if(F.col("item_type") == "flashcard").alias("flashcard_reviews"), F.count_if(F.col("item_type") == "quiz_question").alias("quiz_reviews"),
        F.round(F.avg("confidence"), 2).alias("avg_confidence"),
    )
    return p.withColumn("avg_confidence_pct", F.when(F.col("avg_confidence") > 0, F.round(F.col("avg_confidence") / 5.0 * 100, 1)).otherwise(0.0))


def derived_sessions(progress: DataFrame) -> DataFrame:
    """Accuracy of answered questions by medium and session (A4); null if no answer is marked."""
    q = progress.where("item_type = 'quiz_question'").groupBy("user_id", "media_id", "session_id")
    q = q.agg(F.max("reviewed_at").alias("completed_at"), F.count("*").alias("total"), F.sum(F.col("correct").cast("int")).alias("correct_count"))
    return q.withColumn("accuracy_score", F.col("correct_count") / F.col("total") * 100)


def quiz_history(sessions: DataFrame, progress: DataFrame, titles: DataFrame) -> DataFrame:
    """Real and derived sessions, one a user and moment; real ones win, and of those the last."""
    real = sessions.select("user_id", "media_id", "completed_at", F.col("accuracy_score").alias("score"), F.lit(0).alias("source"))
    derived = derived_sessions(progress).where("accuracy_score is not null").select("user_id", "media_id", "completed_at", F.col("accuracy_score").alias("score"), F.lit(1).alias("source"))
    order = Window.partitionBy("user_id", "completed_at").orderBy("source", F.desc("media_id"), F.desc("score"))
    one = real.unionByName(derived).withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    t = titles.select("media_id", "title")
    return one.join(t, "media_id", "left").select("user_id", "completed_at", F.round("score", 1).alias("score"), F.coalesce("title", F.lit("Unknown")).alias("title"))


def quiz_accuracy(history: DataFrame) -> DataFrame:
    """The average of the rounded scores, rounded."""
    return history.groupBy("user_id").agg(F.count("*").alias("total_quizzes"), F.round(F.avg("score"), 1).alias("quiz_accuracy_pct"))


def card_reviews(progress: DataFrame) -> DataFrame:
    """Review summary of each card (A7); needs_review compares the average before it is rounded."""
    cards = progress.where("item_type = 'flashcard'").groupBy("user_id", "media_id", "card_index")
    cards = cards.agg(F.count("*").alias("reviews"), F.avg("confidence").alias("_avg"), F.count_if("correct").alias("correct_count"), F.max("reviewed_at").alias("last_reviewed"))
    return cards.select("user_id", "media_id", "card_index", "reviews", F.round("_avg", 2).alias("avg_confidence"), "correct_count", "last_reviewed", F.coalesce(F.col("_avg") <= 3, F.lit(True)).alias("needs_review"))


def due_cards(cards: DataFrame, media: DataFrame, reviews: DataFrame, limit: int = 20) -> DataFrame:
    """Each user's cards to review: never reviewed ones first, then the longest ago."""
    owned = cards.join(media.select(F.col("id").alias("media_id"), "user_id"), "media_id").select("user_id", "media_id", "card_index", "question")
    due = owned.join(reviews.select("user_id", "media_id", "card_index", "needs_review", "last_reviewed"), ["user_id", "media_id", "card_index"], "left")
    due = due.where("needs_review is null or needs_review").withColumn("priority", F.when(F.col("needs_review").isNull(), 0).otherwise(1))
    order = Window.partitionBy("user_id").orderBy("priority", "last_reviewed", "media_id", "card_index")
    return due.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("user_id", "position", "media_id", "card_index", "question", "priority", "last_reviewed")


def latest_scores(sessions: DataFrame, n: int = 5) -> DataFrame:
    """The last n scores of each user and medium."""
    order = Window.partitionBy("user_id", "media_id").orderBy(F.desc("completed_at"), F.desc("accuracy_score"))
    return sessions.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n).select("user_id", "media_id", "position", "accuracy_score", "completed_at")


def plan_context(sessions: DataFrame, cards: DataFrame, progress: DataFrame) -> DataFrame:
    """What a study plan is asked for with, by user and medium (A18): reviewed counts rows, not cards."""
    scores = latest_scores(sessions).groupBy("user_id", "media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "accuracy_score"))), lambda x: x["accuracy_score"].cast("int").cast("string")), ",").alias("scores"))
    total = cards.groupBy("media_id").agg(F.count("*").alias("total_cards"))
    seen = progress.where("item_type = 'flashcard'").groupBy("user_id", "media_id").agg(F.count("*").alias("reviewed"), F.round(F.avg(F.coalesce("confidence", F.lit(0))), 4).alias("avg_confidence"))
    out = scores.join(total, "media_id", "left").join(seen, ["user_id", "media_id"], "left")
    return out.select("user_id", "media_id", "scores", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_cards", "reviewed")), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"))
