"""Text functions as column expressions; chunks() and title_of_text() leave the JVM, all others don't."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the oracle's regular expressions know it.
SPACE = "[ \\t\\r\\n]"


def strip(text: Column) -> Column:
    """Without white space at both ends, tabs and line ends too."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Number of words between white space (T14); null for null."""
    return F.when(text.isNotNull(), F.size(F.filter(F.split(text, f"{SPACE}+"), lambda x: x != ""))).cast("long")


#: Letters that have a case; between others a new run begins.
CASED = "[\\p{IsLowercase}\\p{IsUppercase}\\p{Lt}]"


def title(text: Column) -> Column:
    """Each run of letters with a case capitalised, after an apostrophe too (T9), as str.title() does but for a sigma before a combining mark."""
    runs = F.regexp_extract_all(text, F.lit(f"({CASED}+|{CASED.replace('[', '[^')}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def title_of_text(text: Column) -> Column:
    """The same of long texts (T9). It leaves the JVM in Arrow batches, as the expression's list of runs costs more."""

    @F.pandas_udf("string")
    def titled(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.title())

    return titled(text)


#: Separators in the order in which they are tried.
SEPARATORS = [" - ", ":", " > ", "-", "/", "|"]


def subject(text: Column) -> Column:
    """The part before the first separator that occurs, in title case."""
    plain = strip(text)
    part = plain
    for s in reversed(SEPARATORS):
        part = F.when(F.contains(plain, F.lit(s)), F.substring_index(plain, s, 1)).otherwise(part)
    return title(strip(part))


def path_stem(path: Column) -> Column:
    """Last component without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")


def filename_title(path: Column) -> Column:
    """Stem with spaces for underscores and hyphens, in title case."""
    return title(F.translate(path_stem(path), "_-", "  "))


def chunk(text: str, size: int = 1500, overlap: int = 200, strict_size: bool = False) -> list[str]:
    """What chunks() makes of a text."""
    plain, step = text.strip(" \t\r\n"), max(1, size - overlap)
    cut = lambda p: [p[at : at + size] for at in range(0, len(p), step)]
    if len(plain) <= size:
        return [plain] if plain else []
    done, held = [], ""
    for p in filter(None, (x.strip(" \t\r\n") for x in re.split("\n[ \t\r\n]*\n", plain))):
        if len(held) + len(p) + 2 <= size:
            held = f"{held}\n\n{p}" if held else p
        elif held:
            done.append(held)
            held = f"{held[-overlap:]}\n\n{p}" if overlap else p
        else:
            done += cut(p)
    done += [held] * bool(held)
    return [x for c in done for x in (cut(c) if len(c) > size else [c])] if strict_size else done


def chunks(text: Column, size: int = 1500, overlap: int = 200, strict_size: bool = False) -> Column:
    """Paragraphs packed into chunks of at most `size`, each beginning with the end of the one before.

    A paragraph longer than that is cut only when no chunk is open, in steps of size - overlap; with strict_size
    an oversized chunk is cut too. An empty text has no chunks, null has none to tell of. This one leaves the JVM, in
    Arrow batches: as an expression it would be a fold that copies its list at each chunk.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunk(t, size, overlap, strict_size))

    return cut(text)


def headings(text: Column, limit: int = 20) -> Column:
    """Lines that begin with #, and short lines in capitals."""
    lines = F.transform(F.split(text, "\n"), strip)
    marked = lambda x: x.startswith("#")
    capitals = lambda x: (F.length(x) > 4) & (F.upper(x) == x) & (F.lower(x) != x) & (words(x) <= 8)
    found = F.filter(lines, lambda x: marked(x) | capitals(x))
    return F.slice(F.transform(found, lambda x: F.when(marked(x), F.regexp_replace(x, "^#+[ \\t]*", "")).otherwise(x)), 1, limit)


def ocr_text(parts: Column) -> Column:
    return strip(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " "))


def paragraphs(text: Column, limit: int = 700, most: int = 15) -> Column:
    """Sentences packed while their lengths stay below the limit; spaces between them don't count."""
    sentences = F.filter(F.split(strip(text), "(?<=[.!?])[ \\t\\r\\n]+"), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(s) < limit
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), s.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), s).alias("open")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), s.alias("open")))
        )

    packed = F.aggregate(sentences, start, add, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    return F.slice(packed, 1, most)


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clock(seconds: Column) -> Column:
    """HH:MM:SS (T16)."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def minutes_label(seconds: Column) -> Column:
    """Xm Ys, or Ys below a minute."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def seconds_label(seconds: Column) -> Column:
    """mm:ss.s (T17)."""
    m = F.floor(seconds / 60).cast("long")
    return F.format_string("%02d:%04.1f", m, seconds.cast("double") - m * 60)


def middle_cut(text: Column, most: int = 40) -> Column:
    """First and last part with an ellipsis between, when longer."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, half), F.lit("…"), F.substring(text, -half, half))).otherwise(text)


def display_name(stem: Column) -> Column:
    """After the first underscore, without _img and _doc."""
    bare = F.regexp_replace(stem, "_(img|doc)$", "")
    return F.regexp_replace(bare, "^[^_]*_", "")


def stem_type(stem: Column) -> Column:
    return F.when(stem.endswith("_img"), "images").when(stem.endswith("_doc"), "document").otherwise("video")


def importance(text: Column) -> Column:
    """low below 30 ASCII letters and digits, medium below 50, else high."""
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", ""))
    return F.when(n < 30, "low").when(n < 50, "medium").otherwise("high")


def sampling_rate(seconds: Column) -> Column:
    """Frames a second by duration."""
    return F.when(seconds > 2400, 0.1).when(seconds > 1200, 0.2).otherwise(0.5)


def sample_points(seconds: Column) -> Column:
    """Five fixed moments of a recording."""
    return F.transform(F.array(*map(F.lit, (0.10, 0.25, 0.60, 0.85, 0.95))), lambda p: F.round(p * seconds, 3))


def grade(percent: Column) -> Column:
    p = F.floor(percent + 0.5)
    return F.when(p >= 90, "A").when(p >= 80, "B").when(p >= 70, "C").when(p >= 60, "D").otherwise("F")


def answer(options: Column, given: Column) -> Column:
    """The key of an answer given as option key, label, index from 0 or else as it is (P16). options: map of key to label."""
    given = strip(given)
    keys, entries = F.map_keys(options), F.map_entries(options)
    by_key = F.when(F.array_contains(keys, given), given)
    by_label = F.get(F.filter(entries, lambda e: strip(e["value"]) == given), F.lit(0))["key"]
    index = F.regexp_extract(given, "^([0-9]{1,9})", 1).try_cast("int")
    return F.coalesce(by_key, by_label, F.get(keys, index), given)


def truncated(text: Column, most: int = 800) -> Column:
    """With a marker when cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" [truncated]"))).otherwise(text)


def token_budget(prompt: Column, desired: Column, context: int = 4096) -> Column:
    """Answer tokens that the context leaves, 64 at least."""
    return F.greatest(F.lit(64), F.least(desired, context - F.floor(F.length(prompt) / 4) - 64)).cast("int")


def page_text(pdf: Column, ocr: Column) -> Column:
    """A page's own text where it has 40 characters, and below it what was read from the image if that has more than 40."""
    p, o = F.coalesce(pdf, F.lit("")), strip(F.coalesce(ocr, F.lit("")))
    return strip(F.when(F.length(p) >= 40, F.concat(p, F.when(F.length(o) > 40, F.concat(F.lit("\n\n"), o)).otherwise(""))).when(o != "", o).otherwise(p))


def mermaid(text: Column) -> Column:
    """A diagram without end marks and fences, from its mindmap on if it has one."""
    plain = strip(F.replace(F.replace(text, F.lit("<|end|>"), F.lit("")), F.lit("<|endoftext|>"), F.lit("")))
    named = F.get(F.split(F.get(F.split(plain, "```mermaid"), F.lit(1)), "```"), F.lit(0))
    parts = F.split(plain, "```")
    inner = F.when(F.contains(plain, F.lit("```mermaid")), named).when(F.size(parts) >= 3, F.get(parts, F.lit(1))).when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(plain)
    inner = strip(inner)
    cut = F.concat(F.lit("mindmap"), F.get(F.split(inner, "mindmap"), F.lit(1)))
    return F.when(~F.startswith(inner, F.lit("mindmap")) & F.contains(inner, F.lit("mindmap")), cut).otherwise(inner)


#: Language code, name, languages to read images in, whether it is written from right to left.
LANGUAGES = [
    ("en", "English", ["en"], False),
    ("hi", "Hindi", ["hi", "en"], False),
    ("zh", "Chinese (Simp.)", ["ch_sim", "en"], False),
    ("zh-tw", "Chinese (Trad.)", ["ch_tra", "en"], False),
    ("ar", "Arabic", ["ar", "en"], True),
    ("fr", "French", ["fr", "en"], False),
    ("de", "German", ["de", "en"], False),
    ("es", "Spanish", ["es", "en"], False),
    ("pt", "Portuguese", ["pt", "en"], False),
    ("ru", "Russian", ["ru", "en"], False),
    ("ja", "Japanese", ["ja", "en"], False),
    ("ko", "Korean", ["ko", "en"], False),
    ("ur", "Urdu", ["ur", "en"], True),
    ("fa", "Persian", ["fa", "en"], True),
    ("tr", "Turkish", ["tr", "en"], False),
    ("it", "Italian", ["it", "en"], False),
    ("nl", "Dutch", ["nl", "en"], False),
    ("pl", "Polish", ["pl", "en"], False),
    ("uk", "Ukrainian", ["uk", "en"], False),
    ("vi", "Vietnamese", ["vi", "en"], False),
    ("th", "Thai", ["th", "en"], False),
    ("bn", "Bengali", ["bn", "en"], False),
    ("ta", "Tamil", ["ta", "en"], False),
    ("te", "Telugu", ["te", "en"], False),
    ("mr", "Marathi", ["mr", "en"], False),
    ("gu", "Gujarati", ["gu", "en"], False),
    ("kn", "Kannada", ["kn", "en"], False),
    ("ml", "Malayalam", ["en"], False),
    ("pa", "Punjabi", ["en"], False),
    ("id", "Indonesian", ["id", "en"], False),
    ("ms", "Malay", ["ms", "en"], False),
    ("he", "Hebrew", ["he", "en"], True),
    ("sv", "Swedish", ["sv", "en"], False),
    ("no", "Norwegian", ["no", "en"], False),
    ("da", "Danish", ["da", "en"], False),
    ("fi", "Finnish", ["fi", "en"], False),
    ("el", "Greek", ["el", "en"], False),
]


def _of_language(code: Column, values: dict) -> Column:
    """By code, English for others. A literal map: no join."""
    found = F.create_map(*(x for c, v in values.items() for x in (F.lit(c), v)))
    return F.coalesce(F.try_element_at(found, F.lower(strip(code))), values["en"])


def language(code: Column) -> Column:
    """Name of a language by code."""
    return _of_language(code, {c: F.lit(name) for c, name, _, _ in LANGUAGES})


def ocr_langs(code: Column) -> Column:
    """Languages to read images in, by code."""
    return _of_language(code, {c: F.array(*map(F.lit, langs)) for c, _, langs, _ in LANGUAGES})


def right_to_left(code: Column) -> Column:
    """Whether a language is written from right to left, by code."""
    return _of_language(code, {c: F.lit(mark) for c, _, _, mark in LANGUAGES})


def in_language(prompt: Column, code: Column) -> Column:
    """Asks for the answer in the language unless it is English."""
    name = language(code)
    return F.when(name != "English", F.concat(F.lit("Answer in "), name, F.lit(".\n\n"), prompt)).otherwise(prompt)
