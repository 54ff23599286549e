"""Prompts for the language model as column expressions (T24): what it is told and the keys that it is asked for.

Lists are arrays of strings, null or empty where there is nothing; texts that are null or empty are named by a word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip

#: Keys of the replies, which json_recovery and the catalogue read.
METADATA = '{"lecture_title": "...", "subject_area": "...", "difficulty": "beginner | intermediate | advanced", "topics": [], "key_concepts": [], "learning_outcomes": [], "summary": "..."}'
CARDS = '{"flashcards": [{"question": "...", "answer": "...", "topic": "...", "difficulty": "easy | medium | hard"}], "quiz": [{"question": "...", "options": {"A": "...", "B": "...", "C": "...", "D": "..."}, "correct_answer": "A", "explanation": "...", "topic": "..."}]}'
IMAGE = '{"image_title": "...", "content_type": "diagram | chart | equation | slide | table | photo | other", "importance": "high | medium | low", "description": "...", "key_concepts": [], "formulas": [], "bullet_points": [], "content_summary": "..."}'
ONLY_JSON = "Answer with this JSON object alone, without Markdown:\n"


def _or(text: Column, other: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", other).otherwise(text)


def _list(items: Column, most: int, separator: str, other: str) -> Column:
    return _or(F.array_join(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, most), separator), other)


def _json(items: Column, most: int) -> Column:
    return F.to_json(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, most))


def _cut(text: Column, most: int) -> Column:
    """The first characters, with a mark on a cut text."""
    plain = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit(" [truncated]"))).otherwise(plain)


def _lines(*parts: str | Column) -> Column:
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def metadata(transcript: Column, slides: Column, concepts: Column, most_concepts: int = 6) -> Column:
    """Title, subject and outline of a lecture, from 800 characters of transcript and sampled slides."""
    told = [_line("TRANSCRIPT", _cut(transcript, 800)), _line("SLIDES", _list(slides, 5, " | ", "none")), _line("CONCEPTS", _json(concepts, most_concepts))]
    return _lines("Describe this lecture.", *told, F.lit(ONLY_JSON + METADATA))


def study_notes(title: Column, subject: Column, difficulty: Column, topics: Column, concepts: Column, outcomes: Column, summary: Column, formulas: Column) -> Column:
    """Notes in Markdown from a lecture's outline."""
    told = [
        _line("LECTURE", _or(title, "Lecture")), _line("SUBJECT", _or(subject, "General")), _line("LEVEL", _or(difficulty, "unknown")), _line("TOPICS", _list(topics, 4, ", ", "see summary")),
        _line("SUMMARY", _or(summary, "none")), _line("CONCEPTS", _list(concepts, 6, ", ", "none")), _line("OUTCOMES", _list(outcomes, 3, "; ", "none")),
        F.when(F.size(F.coalesce(formulas, F.array().cast("array<string>"))) > 0, _line("FORMULAS", _list(formulas, 4, " | ", ""))),
    ]
    return _lines("Write short study notes in Markdown, with the sections Overview, Key Concepts, Topics Covered, Learning Outcomes and Summary, in at most 400 words.", *told, _line("# Study Notes", _or(title, "Lecture")))


def cards(notes: Column, title: Column, subject: Column, topics: Column, concepts: Column, outcomes: Column, formulas: Column, transcript: Column) -> Column:
    """4 flashcards and 3 questions from 600 characters of notes and 300 of transcript."""
    told = [
        _line("NOTES", _cut(notes, 600)), _line("LECTURE", _or(title, "Lecture")), _line("SUBJECT", _or(subject, "General")), _line("TOPICS", _list(topics, 3, ", ", "see notes")), _line("CONCEPTS", _json(concepts, 5)), _line("OUTCOMES", _json(outcomes, 2)),
        F.when(F.size(F.coalesce(formulas, F.array().cast("array<string>"))) > 0, _line("FORMULAS", _list(formulas, 3, " | ", ""))), F.when(strip(F.coalesce(transcript, F.lit(""))) != "", _line("TRANSCRIPT", _cut(transcript, 300))),
    ]
    return _lines("Make 4 flashcards and 3 quiz questions of these notes, each with one right option and no question twice.", *told, F.lit(ONLY_JSON + CARDS))


def image(text: Column, index: Column, name: Column) -> Column:
    """What an image or a page shows, from the text read from it."""
    return _lines(F.concat(F.lit("Explain image "), index.cast("string"), F.lit(" ("), name, F.lit(").")), _line("TEXT", _or(text, "no text found")), F.lit(ONLY_JSON + IMAGE))


def image_batch(stem: Column, count: Column, descriptions: Column) -> Column:
    """Title, subject and outline of a set of images, from its first 5 descriptions."""
    return _lines(F.concat(F.lit("Describe this set of "), count.cast("string"), F.lit(" images.")), _line("SET", stem), _line("IMAGES", _list(descriptions, 5, " | ", "none")), F.lit(ONLY_JSON + METADATA))


def image_notes(title: Column, subject: Column, difficulty: Column, topics: Column, concepts: Column, outcomes: Column, summary: Column, images: Column) -> Column:
    """Notes in Markdown of a set of images. images: array of title, importance and description; those of low importance are left out."""
    kept = F.transform(F.filter(images, lambda i: ~i["importance"].eqNullSafe(F.lit("low"))), lambda i: F.concat(_or(i["title"], "Image"), F.lit(": "), F.coalesce(i["description"], F.lit(""))))
    told = [_line("SET", _or(title, "Images")), _line("SUBJECT", _or(subject, "General")), _line("LEVEL", _or(difficulty, "unknown")), _line("SUMMARY", _or(summary, "none")), _line("TOPICS", _list(topics, 99, ", ", "none")), _line("CONCEPTS", _list(concepts, 99, ", ", "none")), _line("OUTCOMES", _list(outcomes, 99, ", ", "none"))]
    return _lines("Write full study notes in Markdown, with the sections Overview, Key Concepts, Detailed Notes and Summary.", *told, _line("IMAGES", _or(F.array_join(kept, "\n"), "none")))
