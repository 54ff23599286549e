"""Replies that are well-formed are read in expressions, and as the Python function reads them."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from lectern.functions import json_recovery


def made(rng):
    def value():
        return rng.choice(["x", " y ", "", 'é"q', None, 5, True, ["l"], {"k": "v"}, 1.5] if rng.random() < 0.1 else ["x", " y ", "", 'é"q', "1"])

    def item(quiz):
        out = {k: value() for k in rng.sample(["question", "answer", "topic", "difficulty", "correct_answer", "explanation", "other"], rng.randint(1, 6))}
        if quiz and rng.random() < 0.8:
            out["options"] = rng.choice([{"A": "1", "B": "2"}, list("abcd"), ["a"], list("abcde"), "text", {}, [], {"A": 1}])
        if quiz and rng.random() < 0.3:
            out |= {k: value() for k in rng.sample("ABCD", 2)}
        return out

    reply = {"flashcards": [item(False) for _ in range(rng.randint(0, 3))]} if rng.random() < 0.9 else {"note": value()}
    if rng.random() < 0.7:
        reply["quiz"] = [item(True) for _ in range(rng.randint(0, 3))] if rng.random() < 0.95 else value()
    text = json.dumps(reply, ensure_ascii=rng.random() < 0.5)
    text = text[:-3] if rng.random() < 0.1 else text
    return f"```json\n{text}\n```" if rng.random() < 0.1 else text


def test_like_the_python_function(spark):
    rng = random.Random(6)
    rows = [(i, made(rng)) for i in range(800)] + [(9000, None), (9001, ""), (9002, "[]"), (9003, '{"a": "b"}'), (9004, '{"quiz": "x", "flashcards": 1.5}')]
    df = spark.createDataFrame(rows, "id long, reply string")
    texts = df.withColumn("text", json_recovery.repaired(json_recovery.unfenced(F.col("reply"))))
    told = {r["id"]: json_recovery.normalised(r["text"]) for r in texts.collect()}
    found = json_recovery.replies(df)
    assert {r["id"]: r["cards"].asDict(True) for r in found.collect()} == told
    good = texts.where(json_recovery.well_formed(F.try_parse_json("text"))).count()
    assert 250 < good < 700
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "variant_get" in plan and plan.index("MapInPandas") < plan.rindex("Filter NOT")  # only the others leave the JVM


def test_texts_are_repaired_and_parsed_once(spark):
    df = spark.createDataFrame([(1, '```json\n{"flashcards": [{"QUESTIN": "q", "answr": "a",}],}\n```'), (2, 'So: {"quiz": [{"questoin": "z", "optons": {"A": "1"}}]} Bye'), (3, None)], "id long, reply string")
    found = json_recovery.replies(df)
    assert {r["id"]: (len(r["cards"]["flashcards"]), len(r["cards"]["quiz"])) for r in found.collect()} == {1: (1, 0), 2: (0, 1), 3: (0, 0)}
    assert sorted(json_recovery.replies(df, keep=False).collect()) == sorted(found.drop("reply").collect())
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "questoin" not in plan and "parse_json" not in plan  # they were in both branches, in their filters too


def test_every_way_of_a_fence_and_a_comma(spark):
    texts = ["```json\n{}\n```", " ```\n{}", "{} ``` ", "{}", "", None, '"a" \t\n "b"', '}\n\n{', ']\n"x"', ")\n{", '{"a": [1, ] , }']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", json_recovery.repaired(json_recovery.unfenced(F.col("t"))).alias("t")).orderBy("id")
    assert [r["t"] for r in rows.collect()] == ["{}", "{}", "{}", "{}", "", None, '"a",\n "b"', "},\n\n{", '],\n"x"', ")\n{", '{"a": [1 ]  }']
