"""Frames, cards and segments of a lecture: selection, sampling, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import paragraphs, strip


def _filled(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def notable(frames: DataFrame, most: int = 35) -> DataFrame:
    """The first frames of each medium that matter and have a title or concepts."""
    hits = frames.where(F.col("importance").isin("high", "medium") & (_filled(F.col("slide_title")) | (F.size("key_concepts") > 0)))
    order = Window.partitionBy("media_id").orderBy("frame_id")
    return hits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def meaningful(frames: DataFrame, filtered: bool = False) -> DataFrame:
    """All frames, or with filtered those that matter or have text (P10)."""
    return frames.where((F.col("importance") != "low") | _filled(F.col("ocr_text"))) if filtered else frames


def confident(parts: Column, least: float = 0.4) -> Column:
    """Recognised parts that are sure enough and not blank (P12). parts: array of text and confidence."""
    return F.filter(parts, lambda p: (p["confidence"] >= least) & _filled(p["text"]))


def timeline(frames: DataFrame, sample: int = 5, each: int = 2, most: int = 6) -> DataFrame:
    """Concepts along a lecture (P20): every step-th frame, its first concepts, equal ones in any case once."""
    by = Window.partitionBy("media_id")
    rows = frames.withColumns({"_at": F.row_number().over(by.orderBy("frame_id")) - 1, "_of": F.count("*").over(by)})
    step = F.greatest(F.lit(1), F.floor(F.col("_of") / F.least(F.lit(sample), F.col("_of"))))
    rows = rows.where(F.col("_at") % step == 0).withColumn("_k", F.row_number().over(by.orderBy("frame_id"))).where(F.col("_k") <= sample)
    found = rows.select("media_id", "_k", F.posexplode(F.slice("key_concepts", 1, each)).alias("_pos", "concept"))
    first = found.withColumn("_rn", F.row_number().over(Window.partitionBy("media_id", F.lower("concept")).orderBy("_k", "_pos"))).where("_rn = 1")
    return first.withColumn("position", F.row_number().over(by.orderBy("_k", "_pos"))).where(F.col("position") <= most).select("media_id", "position", "concept")


def shuffled(cards: DataFrame, seed: str) -> DataFrame:
    """Cards of each medium in an order that the seed decides."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("media_id").cast("string"), F.col("card_index").cast("string")).cast("binary"))
    return cards.withColumn("position", F.row_number().over(Window.partitionBy("media_id").orderBy(key, "card_index")))


def deck_progress(position: Column, total: Column) -> Column:
    """Percentage of the deck up to a card."""
    return F.when(total > 0, F.floor(position * 100 / total + 0.5)).otherwise(0).cast("int")


def normalised_segments(segments: DataFrame) -> DataFrame:
    """Times rounded to milliseconds, text trimmed, blank segments dropped."""
    return segments.withColumns({"start_time": F.round("start_time", 3), "end_time": F.round("end_time", 3), "text": strip(F.col("text"))}).where("text <> ''")


def report(media: DataFrame, frames: DataFrame, transcripts: DataFrame) -> DataFrame:
    """What a report of each medium holds (S13): title, subject, notable slides and transcript; rendering is outside."""
    slides = notable(frames).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("position", "slide_title", "key_concepts"))).alias("slides"))
    base = media.select(F.col("id").alias("media_id"), F.coalesce("lecture_title", "batch_stem").alias("title"), "subject_area")
    return base.join(slides, "media_id", "left").join(transcripts, "media_id", "left")


def definitions(frames: DataFrame) -> DataFrame:
    """media_id, position, term and definition: the first of terms equal in any case, in order of frames (T12). frames: with definitions."""
    rows = frames.select("media_id", "frame_id", F.posexplode("definitions").alias("pos", "d"))
    rows = rows.select("media_id", F.struct("frame_id", "pos").alias("at"), strip(F.col("d.term")).alias("term"), strip(F.coalesce("d.definition", F.lit(""))).alias("definition"))
    first = rows.where("term <> ''").groupBy("media_id", F.lower("term").alias("k")).agg(F.min_by(F.struct("at", "term", "definition"), "at").alias("f"))
    return first.select("media_id", F.row_number().over(Window.partitionBy("media_id").orderBy("f.at")).alias("position"), "f.term", "f.definition")


def formulas(frames: DataFrame) -> DataFrame:
    """media_id, position and formula: each once, in order of frames (T13). frames: with formulas."""
    rows = frames.select("media_id", "frame_id", F.posexplode("formulas").alias("pos", "f")).select("media_id", F.struct("frame_id", "pos").alias("at"), strip(F.col("f")).alias("formula"))
    first = rows.where("formula <> ''").groupBy("media_id", "formula").agg(F.min("at").alias("at"))
    return first.select("media_id", F.row_number().over(Window.partitionBy("media_id").orderBy("at")).alias("position"), "formula")


#: A transcript longer than this is said to go on.
EXCERPT = 10_000


def report_lines(summaries: DataFrame, frames: DataFrame, transcripts: DataFrame, cards: DataFrame) -> DataFrame:
    """The contents of each medium's report, a row a line: media_id, section, part, position, head and body.

    Sections: 1 overview, 2 definitions, 3 formulas if there are any, then slides, transcript, cards and suggested reading, each with
    the next number. summaries: media_id, summary, main_topics, learning_outcomes, suggested_reading; one row a medium that has a
    report. frames: with definitions and formulas; transcripts: full_text; cards: card_index, question, answer, topic, difficulty.
    """
    has = formulas(frames).select("media_id").distinct().withColumn("_f", F.lit(1))
    base = summaries.select("media_id").join(has, "media_id", "left").select("media_id", F.coalesce("_f", F.lit(0)).alias("_f"))
    none = F.lit(None).cast("string")

    def lines(rows: DataFrame, number: Column, part: str, position: Column, head: Column, body: Column) -> DataFrame:
        rows = rows.join(base, "media_id")
        return rows.select("media_id", number.cast("int").alias("section"), F.lit(part).alias("part"), position.cast("long").alias("position"), head.cast("string").alias("head"), body.cast("string").alias("body"))

    def listed(column: str) -> DataFrame:
        return summaries.select("media_id", F.posexplode(column).alias("pos", "item"))

    shift, at, item = 3 + F.col("_f"), F.col("pos") + 1, F.col("item")
    slides = notable(frames).withColumn("_title", F.when(_filled(F.col("slide_title")), F.col("slide_title")).otherwise(F.concat(F.lit("Frame "), F.col("frame_id"))))
    told = transcripts.where(_filled(F.col("full_text")))
    order = Window.partitionBy("media_id").orderBy("card_index")
    asked = cards.withColumn("_n", F.row_number().over(order))
    meta = F.array_join(F.filter(F.array("topic", "difficulty"), _filled), " | ")
    return (
        lines(summaries.where(_filled(F.col("summary"))), F.lit(1), "overview", F.lit(1), none, F.col("summary"))
        .unionByName(lines(listed("main_topics"), F.lit(1), "topics", at, none, item))
        .unionByName(lines(listed("learning_outcomes"), F.lit(1), "outcomes", at, none, item))
        .unionByName(lines(definitions(frames), F.lit(2), "definitions", F.col("position"), F.col("term"), F.col("definition")))
        .unionByName(lines(formulas(frames), F.lit(3), "formulas", F.col("position"), none, F.col("formula")))
        .unionByName(lines(slides, shift, "slides", F.col("position"), F.col("_title"), F.array_join("key_concepts", ", ")))
        .unionByName(lines(told.select("media_id", F.posexplode(paragraphs(F.col("full_text"))).alias("pos", "item")), shift + 1, "transcript", at, none, item))
        .unionByName(lines(told.where(F.length("full_text") > EXCERPT), shift + 1, "continues", F.lit(1), none, none))
        .unionByName(lines(asked, shift + 2, "cards", F.col("_n"), meta, F.concat(F.lit("Q"), "_n", F.lit(": "), "question", F.lit("\nA: "), "answer")))
        .unionByName(lines(listed("suggested_reading"), shift + 3, "reading", at, none, item))
    )


def image_notes(summaries: DataFrame, images: DataFrame) -> DataFrame:
    """media_id and Markdown notes of a batch of images without a model's notes.

    summaries: media_id, lecture_title, summary, main_topics, key_concepts; images: media_id, batch_index, image_title, filename,
    description, bullet_points, importance. Images of low importance are left out; a batch is one document, so its images meet.
    """

    def listed(items: Column) -> Column:
        return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x))

    def part(head: str, body: Column) -> Column:
        return F.when(F.size(body) > 0, F.concat(F.array(F.lit(f"## {head}"), F.lit("")), body, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))

    title = F.concat(F.lit("### "), F.coalesce("image_title", "filename", F.lit("Image")))
    described = F.when(_filled(F.col("description")), F.array("description")).otherwise(F.array().cast("array<string>"))
    shown = images.where(~F.col("importance").eqNullSafe("low")).select("media_id", "batch_index", F.concat(F.array(title), described, listed(F.col("bullet_points")), F.array(F.lit(""))).alias("lines"))
    shown = shown.groupBy("media_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch_index", "lines"))), lambda x: x["lines"])).alias("_images"))
    rows = summaries.join(shown, "media_id", "left")
    summary = F.when(_filled(F.col("summary")), F.array("summary")).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("# Study Notes: "), F.coalesce("lecture_title", F.lit(""))), F.lit(""))
    body = [part("Overview", summary), part("Topics", listed(F.col("main_topics"))), part("Key Concepts", listed(F.col("key_concepts"))), F.array(F.lit("## Image Analyses"), F.lit("")), F.coalesce("_images", F.array().cast("array<string>"))]
    return rows.select("media_id", F.array_join(F.concat(head, *body), "\n").alias("content"))
