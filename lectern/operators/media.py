"""The media catalogue: titles, material counts, readiness, newest media.

Counts are aggregated by medium before they are joined, so each join is one row to one row. Orders that would
leave ties open name a last column that decides: batch_index for images, id for media of one moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import path_stem


def counts(children: DataFrame, name: str) -> DataFrame:
    """Rows of each medium (A1)."""
    return children.groupBy("media_id").agg(F.count("*").alias(name))


def first_image(details: DataFrame) -> DataFrame:
    """Of several detail rows of one medium and kind the one with the smallest batch_index."""
    order = Window.partitionBy("media_id", "kind").orderBy("batch_index")
    return details.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def input_type(media_type: Column) -> Column:
    """Media type as the interface names it."""
    return F.when(media_type == "image", "images").otherwise(media_type)


def _kind(media_type: Column) -> Column:
    return F.when(media_type == "live", "video").otherwise(media_type)


def titled(media: DataFrame, details: DataFrame) -> DataFrame:
    """media with lecture_title, subject_area and pdf_report_path from the details of its own kind."""
    d = first_image(details).withColumnRenamed("media_id", "_m").drop("batch_index")
    return media.join(d, (media["id"] == d["_m"]) & (_kind(media["media_type"]) == d["kind"]), "left").drop("_m", "kind")


def titles(media: DataFrame, details: DataFrame) -> DataFrame:
    """media_id, user_id and title: the lecture title, else the stem, else Unknown."""
    title = F.coalesce(F.when(F.col("lecture_title") != "", F.col("lecture_title")), F.when(F.col("batch_stem") != "", F.col("batch_stem")), F.lit("Unknown"))
    return titled(media, details).select(F.col("id").alias("media_id"), "user_id", "batch_stem", title.alias("title"))


def newest_per_stem(media: DataFrame) -> DataFrame:
    """The newest medium of each user and stem."""
    order = Window.partitionBy("user_id", "batch_stem").orderBy(F.desc("uploaded_at"), F.desc("id"))
    return media.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def states(media: DataFrame, details: DataFrame, flashcards: DataFrame, questions: DataFrame, notes: DataFrame) -> DataFrame:
    """What is ready for the newest medium of each user and stem."""
    m = titled(newest_per_stem(media), details)
    for children, name in ((flashcards, "flashcard_count"), (questions, "quiz_count")):
        c = counts(children, name).withColumnRenamed("media_id", "_m")
        m = m.join(c, m["id"] == c["_m"], "left").drop("_m").withColumn(name, F.coalesce(name, F.lit(0)))
    n = notes.select(F.col("media_id").alias("_m"), F.lit(True).alias("_notes")).distinct()
    m = m.join(n, m["id"] == n["_m"], "left")
    return m.select(
        "id", "user_id", "batch_stem", input_type(F.col("media_type")).alias("input_type"), "lecture_title", "subject_area", "uploaded_at", "flashcard_count", "quiz_count",
        (F.coalesce("_notes", F.lit(False)) | F.col("pdf_report_path").isNotNull()).alias("summary_ready"), (F.col("flashcard_count") > 0).alias("flashcards_ready"), (F.col("quiz_count") > 0).alias("quiz_ready"), (F.col("media_type") == "video").alias("audio_ready"),
    )


def stem_lookup(media: DataFrame, stem: str) -> DataFrame:
    """Each user's newest medium whose stem, or else whose path's stem, is the given one."""
    own = F.coalesce(F.col("batch_stem") == stem, F.lit(False))
    hits = media.withColumn("_own", own).where(own | (path_stem(F.col("storage_path")) == stem))
    order = Window.partitionBy("user_id").orderBy(F.desc("_own"), F.desc("uploaded_at"), F.desc("id"))
    return hits.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_own")


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of first and those of second whose key first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti").select(*first.columns))


def status_totals(states_: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """One row of totals by input type (A20), with frames (media_id) also those collected of the media."""
    kinds = ["video", "audio", "images", "document", "live"]
    if frames is not None:
        n = frames.groupBy(F.col("media_id").alias("id")).agg(F.count("*").alias("_frames"))
        states_ = states_.join(n, "id", "left")
    collected = [F.coalesce(F.sum("_frames"), F.lit(0)).alias("frames_collected")] if frames is not None else []
    return states_.agg(F.count("*").alias("total"), *(F.count_if(F.col("input_type") == k).alias(f"total_{k}") for k in kinds), F.coalesce(F.sum("flashcard_count"), F.lit(0)).alias("flashcards"), *collected)
