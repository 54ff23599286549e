from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text


def values(spark, inputs: list, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_chunks(spark):
    inputs = ["aaaa\n\nbbbb\n\ncccc", "abcdefghijklmno", "aaaa\n\nabcdefghijklmnop", "   ", None]
    assert values(spark, inputs, lambda x: text.chunks(x, 10, 3)) == [["aaaa\n\nbbbb", "bbb\n\ncccc"], ["abcdefghij", "hijklmno", "o"], ["aaaa", "aaa\n\nabcdefghijklmnop"], [], None]
    assert all(len(c) <= 10 for c in values(spark, inputs[2:3], lambda x: text.chunks(x, 10, 3, strict_size=True))[0])


def plain_chunks(t: str, size: int, overlap: int) -> list[str]:
    ws = " \t\r\n"
    t = t.strip(ws)
    if not t:
        return []
    if len(t) <= size:
        return [t]
    out, open_ = [], ""
    for p in (p.strip(ws) for p in re.split(r"\n[ \t\r\n]*\n", t)):
        if not p:
            continue
        if len(open_) + len(p) + 2 <= size:
            open_ = f"{open_}\n\n{p}" if open_ else p
        elif open_:
            out.append(open_)
            open_ = open_[-overlap:] + "\n\n" + p
        else:
            out += [p[i : i + size] for i in range(0, len(p), size - overlap)]
    return out + [open_] if open_ else out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=80), min_size=1, max_size=40))
def test_chunks_like_a_loop(spark, inputs):
    assert values(spark, inputs, lambda x: text.chunks(x, 12, 4)) == [plain_chunks(t, 12, 4) for t in inputs]


def test_headings(spark):
    assert values(spark, ["# Intro\nABCD\nNEWTON LAWS\nnope\n## \n1234567\nA B C D E F G H I"], text.headings) == [["Intro", "NEWTON LAWS", ""]]


def test_subject_and_title(spark):
    inputs = ["Physics - Kinematics", "physics", "bio-chem/organic", "CS > AI", "math:algebra - linear", "newton's laws", "  ", "- x", None]
    assert values(spark, inputs, text.subject) == ["Physics", "Physics", "Bio", "Cs", "Math:Algebra", "Newton'S Laws", "", "", None]


def test_paragraphs(spark):
    assert values(spark, ["Aa bb. Cc dd! Ee ff? Gg"], lambda x: text.paragraphs(x, 12)) == [["Aa bb.", "Cc dd!", "Ee ff? Gg"]]


@pytest.mark.parametrize(("desired", "length", "told"), [(300, 800, 300), (2048, 9000, 1782), (700, 16000, 64), (300, 0, 300)])
def test_token_budget(spark, desired, length, told):
    assert values(spark, ["x" * length], lambda x: text.token_budget(x, F.lit(desired))) == [told]


def test_small_ones(spark):
    assert values(spark, ["a" * n for n in (29, 30, 49, 50)] + [None], text.importance) == ["low", "medium", "medium", "high", "low"]
    assert values(spark, ["a/c.tar.gz", ".profile", "dir.x/name", "My_great-file.PDF"], text.path_stem) == ["c.tar", ".profile", "name", "My_great-file"]
    assert values(spark, ["a/my_great-file.pdf"], text.filename_title) == ["My Great File"]
    assert values(spark, ["3661", "59", "61"], lambda x: text.clock(x.cast("int"))) == ["01:01:01", "00:00:59", "00:01:01"]
    assert values(spark, ["1200", "1201", "2400", "2401", None], lambda x: text.sampling_rate(x.cast("double"))) == [0.5, 0.2, 0.2, 0.1, 0.5]
    assert values(spark, ["89.5", "79.4", "59"], lambda x: text.grade(x.cast("double"))) == ["A", "C", "F"]
    assert values(spark, ["a", " b  c\n"], text.words) == [1, 2]
    assert values(spark, ["```mermaid\nmindmap\n  a\n```"], text.mermaid) == ["mindmap\n  a"]
    assert values(spark, ["FR ", "xx"], text.language) == ["French", "English"]
    options = F.create_map(F.lit("A"), F.lit("one"), F.lit("B"), F.lit("two"))
    assert values(spark, ["B", " two ", "1", "three", "b"], lambda x: text.answer(options, x)) == ["B", "B", "B", "three", "b"]
    assert values(spark, ["x" * 45], text.middle_cut) == ["x" * 20 + "…" + "x" * 20]


def test_one_title_case(spark):
    """The expression and the Arrow function are str.title()."""
    rng = random.Random(1)
    letters = list("aAzZ'é ÉßﬁŉǆǄςΑα中日1_-İıªºⅷⓐ𝒜𐐀𐐨")
    rows = ["中abc", "ΑΣ", "ΑΣ Α", "ﬁne", "newton's LAWS", "", None] + ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for r in df.select("t", text.title(F.col("t")).alias("a"), text.title_of_text(F.col("t")).alias("b")).collect():
        assert r["a"] == r["b"] == (None if r["t"] is None else r["t"].title()), r["t"]
