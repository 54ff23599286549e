"""Catalogue and transcript reads: search, transcripts, last entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import words


def contains(text: Column, wanted: str) -> Column:
    """Whether the text holds the words in any case; false for null."""
    return F.coalesce(F.contains(F.lower(text), F.lit(wanted.lower())), F.lit(False))


def search(states: DataFrame, wanted: str, only: str | None = None) -> DataFrame:
    """Media whose title, or without one whose stem, holds the words; processed or pending ones."""
    hits = states.where(contains(F.coalesce("lecture_title", "batch_stem"), wanted))
    if only:
        hits = hits.where(F.col("summary_ready") == (only == "processed"))
    return hits.select("id", "user_id", "batch_stem", "lecture_title", "input_type", "uploaded_at", "summary_ready")


def segment_search(segments: DataFrame, wanted: str) -> DataFrame:
    return segments.where(contains(F.col("text"), wanted)).select("media_id", "segment_index", "start_time", "text")


def note_lines(notes: DataFrame, wanted: str) -> DataFrame:
    """The lines of notes that hold the words."""
    kept = F.filter(F.split("content", "\n"), lambda x: contains(x, wanted))
    return notes.select("media_id", F.array_join(kept, "\n").alias("content"))


def transcripts(segments: DataFrame) -> DataFrame:
    """Whole transcript of each medium, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("segment_index", "text")))
    return segments.groupBy("media_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("full_text"))


def transcript_stats(segments: DataFrame) -> DataFrame:
    """Words, segments, as duration the end of the last segment, and the first segment's language if there is one."""
    language = [F.min_by("language", "segment_index").alias("language")] if "language" in segments.columns else []
    return segments.groupBy("media_id").agg(F.sum(words(F.col("text"))).alias("word_count"), F.count("*").alias("segment_count"), F.max_by("end_time", "segment_index").alias("duration_sec"), *language)


def transcript_view(media: DataFrame, segments: DataFrame) -> DataFrame:
    """Video and audio media with transcript and statistics."""
    m = media.where(F.col("media_type").isin("video", "audio")).select(F.col("id").alias("media_id"), "user_id", "batch_stem")
    return m.join(transcript_stats(segments), "media_id").join(transcripts(segments), "media_id")


def last(rows: DataFrame, group: list[str], order: str, n: int, tie: list[str] | None = None) -> DataFrame:
    """The last n rows of each group with their position from the end (W6, W7); all rows for n = 0."""
    by = Window.partitionBy(*group).orderBy(F.desc(order), *(tie or []))
    out = rows.withColumn("from_end", F.row_number().over(by))
    return out.where(F.col("from_end") <= n) if n else out


def of_users(rows: DataFrame, users: list[int]) -> DataFrame:
    """Rows of some users (P1); the filter reaches the scan."""
    return rows.where(F.col("user_id").isin(users))


def of_media(rows: DataFrame, media: DataFrame) -> DataFrame:
    """Rows of the given media, by a semi-join instead of a list."""
    return rows.join(media.select(F.col("id").alias("media_id")), "media_id", "left_semi")


def merged_status(memory: DataFrame, stored: DataFrame) -> DataFrame:
    """Each user's states: those in memory first, then the stored ones of other stems by stem (W14). Both: user_id, batch_stem."""
    rest = stored.join(memory.select("user_id", "batch_stem").distinct(), ["user_id", "batch_stem"], "left_anti")
    both = memory.select("user_id", "batch_stem", F.lit(0).alias("stored")).unionByName(rest.select("user_id", "batch_stem", F.lit(1).alias("stored")))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("stored", "batch_stem")))
