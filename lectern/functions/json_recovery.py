"""Study cards from what a language model wrote as JSON, well-formed or not.

Fences and misspelt keys are put right by expressions. Replies that are then well-formed, with strings where strings
belong, are read as variants, in expressions too. Only the others go to a Python function over batches: objects nest and
strings escape, and no expression tells where a broken one can be taken up again.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.plans.session import cut

CARDS = "struct<question:string,answer:string,topic:string,difficulty:string>"
QUESTIONS = "struct<question:string,options:map<string,string>,correct_answer:string,explanation:string,topic:string>"
REPLY = f"struct<flashcards:array<{CARDS}>,quiz:array<{QUESTIONS}>>"

#: Keys that models misspell.
TYPOS = {
    "questionimoine": "question",
    "questin": "question",
    "questoin": "question",
    "answr": "answer",
    "answeer": "answer",
    "optons": "options",
    "correctanswer": "correct_answer",
    "correct_answeer": "correct_answer",
    "explnation": "explanation",
    "explantion": "explanation",
}


def unfenced(text: Column) -> Column:
    """Without a code fence (T4)."""
    fenced = F.regexp_replace(F.regexp_replace(text, "(?is)^\\s*```[a-z]*\\s*", ""), "(?s)\\s*```\\s*$", "")
    return F.when(text.contains("```"), fenced).otherwise(text)


def repaired(text: Column) -> Column:
    """Misspelt keys, missing commas between lines, and trailing commas put right (T5)."""
    for right in dict.fromkeys(TYPOS.values()):
        wrong = "|".join(k for k, v in TYPOS.items() if v == right)
        text = F.regexp_replace(text, f'(?i)"(?:{wrong})"(\\s*:)', f'"{right}"$1')
    text = F.regexp_replace(text, '(["}\\]])[ \\t]*\\n(\\s*)(["{])', "$1,\n$2$3")
    return F.regexp_replace(text, ",(\\s*[\\}\\]])", "$1")


_SPACE = re.compile(r"\s*")
_DECODER = json.JSONDecoder(strict=False)


def _objects(text: str, at: int = 0) -> list[dict]:
    """Complete objects from a place on, nested ones only where the outer one is cut off."""
    out = []
    while (at := text.find("{", at)) >= 0:
        try:
            found, at = _DECODER.raw_decode(text, at)
            out.append(found)
        except ValueError:
            at += 1
    return out


def _array(text: str, key: str) -> list[dict]:
    """The complete objects of the array under a key, which may be cut off."""
    m = re.search(rf'"{key}"\s*:\s*\[', text)
    if not m:
        return []
    at, out = m.end(), []
    while True:
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] == ",":
            at += 1
            continue
        if text[at : at + 1] != "{":
            return out
        try:
            found, at = _DECODER.raw_decode(text, at)
        except ValueError:
            return out
        out.append(found)


def recover(text: str | None, strict_compat: bool = False) -> dict[str, list[dict]]:
    """flashcards and quiz of a reply.

    Tried in order: the whole text; the first complete object; all objects; the arrays by key, even cut off. A
    bare list of cards is a list of flashcards; with strict_compat it yields none, and neither does a cut array.
    """
    text = text or ""
    empty: dict[str, list[dict]] = {"flashcards": [], "quiz": []}

    def of(x) -> dict[str, list[dict]] | None:
        if isinstance(x, dict) and ("flashcards" in x or "quiz" in x):
            return {k: [c for c in x[k] if isinstance(c, dict)] if isinstance(x.get(k), list) else [] for k in empty}
        return None

    try:
        whole = _DECODER.decode(text)
        if isinstance(whole, list) and not strict_compat:
            return empty | {"flashcards": [c for c in whole if isinstance(c, dict)]}
        if (found := of(whole)) is not None:
            return found
    except ValueError:
        pass
    found = _objects(text)
    if found and strict_compat and of(found[0]) is None:
        return empty
    for x in found:
        if (told := of(x)) is not None:
            return told
    arrays = {k: _array(text, k) for k in empty}
    if any(arrays.values()):
        return arrays
    cards = [x for x in found if "question" in x and "options" not in x]
    return empty if strict_compat else empty | {"flashcards": cards, "quiz": [x for x in found if "options" in x]}


def options_map(raw: dict) -> dict[str, str] | None:
    """Options given as keys A to D beside the question, as a map, or as a list of four, as a map (T19). A null key is no option."""
    if own := {k: str(raw[k]) for k in "ABCD" if raw.get(k) is not None}:
        return own
    given = raw.get("options")
    if isinstance(given, dict):
        return {str(k): str(v) for k, v in given.items()}
    if isinstance(given, list) and len(given) >= 4:
        return {k: str(v) for k, v in zip("ABCD", given, strict=False)}
    return None


def card(raw: dict) -> dict | None:
    """A card with defaults, none without a question."""
    question = str(raw.get("question") or "").strip()
    return {"question": question, "answer": str(raw.get("answer") or ""), "topic": str(raw.get("topic") or ""), "difficulty": str(raw.get("difficulty") or "medium")} if question else None


def question(raw: dict) -> dict | None:
    text = str(raw.get("question") or "").strip()
    options = options_map(raw)
    return {"question": text, "options": options, "correct_answer": str(raw.get("correct_answer") or raw.get("answer") or ""), "explanation": str(raw.get("explanation") or ""), "topic": str(raw.get("topic") or "")} if text else None


def normalised(text: str | None, strict_compat: bool = False) -> dict:
    found = recover(text, strict_compat)
    return {"flashcards": [c for x in found["flashcards"] if (c := card(x))], "quiz": [q for x in found["quiz"] if (q := question(x))]}


_NAME = r"(?:`[^`<>]+`|\w+)"


def _object(*fields: str) -> str:
    one = f"(?:{'|'.join(fields)})"
    return f"OBJECT<{one}(?:, {one})*>"


_TEXTS = f"{_NAME}: STRING"
_OPTIONS = f"options: (?:ARRAY<STRING>|{_object(_TEXTS)})"
_ITEMS = f"(?:flashcards|quiz): ARRAY<(?:VOID|{_object(_TEXTS, _OPTIONS)})>"
#: Schema of a variant that expressions read just as recover() does: strings only, and options as strings by key or in a list.
WELL_FORMED = f"^(?=OBJECT<(?:.*, )?(?:flashcards|quiz): ARRAY<){_object(_ITEMS, '(?!(?:flashcards|quiz):)' + _TEXTS)}$"
_FIELDS = "question:string,answer:string,topic:string"


def well_formed(reply: Column) -> Column:
    """Whether a reply is an object of cards or questions with nothing to recover."""
    return F.coalesce(F.schema_of_variant(reply).rlike(WELL_FORMED), F.lit(False))


def _or(*values: Column | str) -> Column:
    """The first that is neither null nor empty; the last one is a literal."""
    *found, default = values
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in found), F.lit(default))


def _card(x: Column) -> Column:
    return F.struct(strip(_or(x["question"], "")).alias("question"), _or(x["answer"], "").alias("answer"), _or(x["topic"], "").alias("topic"), _or(x["difficulty"], "medium").alias("difficulty"))


def _question(x: Column) -> Column:
    own = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), x[k].alias("value")) for k in "ABCD")), lambda e: e["value"].isNotNull())
    by_key, listed = F.try_variant_get(x["options"], "$", "map<string,string>"), F.try_variant_get(x["options"], "$", "array<string>")
    four = F.map_from_arrays(F.array(*map(F.lit, "ABCD")), F.slice(listed, 1, 4))
    options = F.when(F.size(own) > 0, F.map_from_entries(own)).when(by_key.isNotNull(), by_key).when(F.size(listed) >= 4, four)
    return F.struct(strip(_or(x["question"], "")).alias("question"), options.alias("options"), _or(x["correct_answer"], x["answer"], "").alias("correct_answer"), _or(x["explanation"], "").alias("explanation"), _or(x["topic"], "").alias("topic"))


def _read(reply: Column) -> Column:
    """The cards of a well-formed reply."""

    def all_of(path: str, given: str, one, kind: str) -> Column:
        items = F.coalesce(F.variant_get(reply, path, given), F.array().cast(given))
        return F.filter(F.transform(items, one), lambda c: c["question"] != "").cast(f"array<{kind}>")

    card_, question_ = (f"array<struct<{_FIELDS},{more}>>" for more in ("difficulty:string", "correct_answer:string,explanation:string,options:variant,A:string,B:string,C:string,D:string"))
    return F.struct(all_of("$.flashcards", card_, _card, CARDS).alias("flashcards"), all_of("$.quiz", question_, _question, QUESTIONS).alias("quiz"))


def replies(rows: DataFrame, column: str = "reply", strict_compat: bool = False, keep: bool = True) -> DataFrame:
    """rows with cards: the flashcards and quiz questions of each reply, normalised; without keep, the reply itself goes.

    The rows are checkpointed with what they were parsed to or else their repaired texts, as they are read twice and a model may have made them.
    """
    names = [c for c in rows.columns if keep or c != column]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), f"cards {REPLY}"])

    def run(batches):
        for pdf in batches:
            out = pdf.drop(columns="_text")
            out["cards"] = [normalised(t, strict_compat) for t in pdf["_text"]]
            yield out

    texts = rows.withColumn("_text", repaired(unfenced(F.col(column)))).withColumn("_v", F.try_parse_json("_text"))
    texts = texts.withColumn("_good", well_formed(F.col("_v")))
    texts = cut(texts.select(*names, "_good", F.when(F.col("_good"), F.col("_v")).alias("_v"), F.when(~F.col("_good"), F.col("_text")).alias("_text")))
    good = texts.where("_good").select(*names, _read(F.col("_v")).alias("cards"))
    broken = texts.where(~F.col("_good")).select(*names, "_text").mapInPandas(run, schema)
    return good.unionByName(broken)
