"""Boundaries where models plug in: language, characters, speech, embeddings.

A model is made on the executor by a factory, once a task, and called on batches. A row whose call fails keeps
its place with its error; nothing is dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Factory = Callable[[], Callable[[list], list]]


def applied(rows: DataFrame, column: str, made: Factory, result: str, result_type: str, batch: int = 8) -> DataFrame:
    """rows with result, what the model says of the column, and <result>_error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{result}` {result_type}, `{result}_error` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made()
        for pdf in batches:
            told: list[Any] = []
            errors: list[str | None] = []
            values = pdf[column].tolist()
            for at in range(0, len(values), batch):
                some = values[at : at + batch]
                try:
                    found = model(some)
                    if len(found) != len(some):
                        raise ValueError(f"{len(found)} results for {len(some)} rows")
                    told, errors = told + list(found), errors + [None] * len(some)
                except Exception:  # noqa: BLE001  then one by one, to tell which rows fail
                    for v in some:
                        try:
                            told.append(model([v])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            told.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{result: pd.Series(told, dtype=object, index=pdf.index), f"{result}_error": pd.Series(errors, dtype=object, index=pdf.index)})

    return rows.mapInPandas(run, schema)


def reasoned(rows: DataFrame, model: Factory, prompt: str = "prompt") -> DataFrame:
    """reply to each prompt."""
    return applied(rows, prompt, model, "reply", "string")


def read_characters(rows: DataFrame, model: Factory, image: str = "content") -> DataFrame:
    """parts of each image: text and confidence."""
    return applied(rows, image, model, "parts", "array<struct<text:string,confidence:double>>")


def transcribed(rows: DataFrame, model: Factory, audio: str = "content") -> DataFrame:
    """segments of each recording."""
    return applied(rows, audio, model, "segments", "array<struct<id:int,start:double,end:double,text:string>>", batch=1)


def embedded(rows: DataFrame, model: Factory, text: str = "text") -> DataFrame:
    """vector of each text."""
    return applied(rows, text, model, "vector", "array<float>", batch=64)


def converted(files: DataFrame, converter: Factory, content: str = "content") -> DataFrame:
    """audio of each file: mono at 16 kHz as the converter makes it, by a program outside."""
    return applied(files, content, converter, "audio", "binary", batch=1)


def sliced(chunks: DataFrame, decoder: Factory, least: float = 0.3) -> DataFrame:
    """What is new in each decoded recording (L2). chunks: session_id, chunk_index, content (the recording so far).

    The decoder tells the recording's duration; a chunk that adds less than `least` seconds to the last one that
    counted is dropped. A row is told from to: the seconds that it adds.
    """
    told = applied(chunks, "content", decoder, "duration", "double", batch=1)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], 0.0
        for r in rows.sort_values("chunk_index").itertuples(index=False):
            if r.duration is not None and r.duration - last >= least:
                kept.append((r.session_id, r.chunk_index, last, r.duration))
                last = r.duration
        return pd.DataFrame(kept, columns=["session_id", "chunk_index", "start", "end"])

    kind = chunks.schema["session_id"].dataType.simpleString()
    return told.drop("content").groupBy("session_id").applyInPandas(fold, f"session_id {kind}, chunk_index int, start double, end double")


def timely(segments: Iterable, each: float = 300.0, total: float = 600.0, clock: Callable[[], float] = time.monotonic) -> list:
    """What a transcriber gives until one segment takes too long or all do: then a part of the transcript."""
    begun = last = clock()
    out = []
    for s in segments:
        now = clock()
        if now - begun > total or now - last > each:
            break
        out.append(s)
        last = now
    return out


def analysed_pages(pages: DataFrame, model: Factory) -> DataFrame:
    """What the model says of each page, with a placeholder where it fails (X5). pages: path, page_num, text.

    title, importance, description and summary of each page, in the order of page_num; nothing is dropped.
    """
    told = applied(pages, "text", model, "analysis", "struct<title:string,importance:string,description:string,summary:string>")
    text, label = F.coalesce("text", F.lit("")), F.concat(F.lit("Page "), F.col("page_num"))
    empty = text == ""
    return told.select(
        "path", "page_num", F.coalesce("analysis.title", label).alias("title"), F.coalesce("analysis.importance", F.when(empty, "low").otherwise("medium")).alias("importance"),
        F.coalesce("analysis.description", F.when(empty, "No content detected.").otherwise(F.substring(text, 1, 300))).alias("description"), F.coalesce("analysis.summary", F.substring(text, 1, 200)).alias("summary"), F.col("analysis_error").alias("error"),
    )


def echo() -> Callable[[list], list]:
    """A stand-in for a language model: says the prompt's first line."""
    return lambda prompts: [(p or "").split("\n", 1)[0] for p in prompts]
