from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import json_recovery
from lectern.operators import dashboard, dedup, engagement, graph, recommendations, writes


def leaders(spark, n: int, pairs: list[tuple[int, int]]) -> list[int]:
    items = spark.createDataFrame([(0, i) for i in range(n)], "group long, id long")
    near = spark.createDataFrame([(0, i, j) for i, j in pairs], "group long, i long, j long")
    return sorted(r[0] for r in dedup.clusters(items, near).select("leader").distinct().collect())


def scan(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for j in range(n):
        if not any((i, j) in pairs for i in out):
            out.append(j)
    return out


def test_greedy_scan(spark):
    assert leaders(spark, 3, [(0, 1), (1, 2)]) == [0, 2]  # a chain isn't one cluster
    random.seed(3)
    for _ in range(3):
        pairs = [(i, j) for i in range(12) for j in range(i + 1, 12) if random.random() < 0.25]
        assert leaders(spark, 12, pairs) == scan(12, pairs)


def test_longest_shown(spark):
    items = spark.createDataFrame([(0, 0, "aa"), (0, 1, "bbb"), (0, 2, "ccc")], "group long, id long, text string")
    near = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "group long, i long, j long")
    assert [r["text"] for r in dedup.deduplicate(items, near).collect()] == ["bbb"]


def test_tfidf(spark):
    items = spark.createDataFrame([(0, i, t) for i, t in enumerate(["Kinetic energy", "kinetic energy", "potential energy", "F = ma"])], "group long, id long, text string")
    sims = {(r["i"], r["j"]): r["sim"] for r in dedup.text_pairs(items, 0.01).collect()}
    assert sims[0, 1] == pytest.approx(1.0) and sims[0, 2] == pytest.approx(0.204379, abs=1e-6) and len(sims) == 3
    assert [r["text"] for r in dedup.concepts(items).orderBy("id").collect()] == ["Kinetic energy", "potential energy", "F = ma"]


def test_graph(spark):
    mentions = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 1, 2, "a"), (1, 2, 0, "b"), (1, 2, 1, "a"), (1, 3, 0, "a")], "media_id long, frame_id long, pos int, concept string")
    assert [tuple(r) for r in graph.cooccurrence(mentions).collect()] == [(1, "a", "b", 2)]
    assert {r["node"]: r["freq"] for r in graph.central(mentions, graph.cooccurrence(mentions)).collect()} == {"a": 4, "b": 2}


def test_urgency_and_accuracy(spark):
    df = spark.createDataFrame([(x,) for x in (39.9, 40.0, 59.9, 60.0, 69.9)], "s double")
    assert [r[0] for r in df.select(recommendations.urgency(F.col("s"))).collect()] == ["critical", "high", "high", "medium", "medium"]
    assert spark.range(1).select(engagement.accuracy(F.lit(0), F.lit(0))).first()[0] == 0.0


def test_needs_review(spark):
    p = spark.createDataFrame([(1, 1, 0, "flashcard", 3, True, "2024-01-01"), (1, 1, 0, "flashcard", 3, True, "2024-01-02"), (1, 1, 1, "flashcard", 3, True, "2024-01-01"), (1, 1, 1, "flashcard", 4, False, "2024-01-02")], "user_id long, media_id long, card_index int, item_type string, confidence int, correct boolean, reviewed_at string")
    assert {r["card_index"]: r["needs_review"] for r in engagement.card_reviews(p).collect()} == {0: True, 1: False}


def test_live_counted_twice_unless_told(spark):
    media = spark.createDataFrame([(1, 7, "live", "2024-01-01")], "id long, user_id long, media_type string, uploaded_at string")
    live = spark.createDataFrame([(7, "s1", "2024-01-01")], "user_id long, session_id string, started_at string")
    assert [dashboard.with_live(media, live, d).count() for d in (False, True)] == [2, 1]


CARDS = '{"flashcards":[{"question":"q1","answer":"a"},{"question":"q2"}],"quiz":[{"question":"z","options":["1","2","3","4"]}]}'


@pytest.mark.parametrize(
    ("reply", "cards", "quiz"),
    [
        (CARDS, 2, 1),
        (f"```json\n{CARDS}\n```", 2, 1),
        (CARDS.replace("}]}", "}],}"), 2, 1),
        (f"Sure! {CARDS} Enjoy", 2, 1),
        (CARDS[:-1] + " oops }", 2, 1),
        (CARDS[:-20], 2, 0),
        (CARDS[:60], 1, 0),
        ('[{"question":"x"}]', 1, 0),
        ("nothing", 0, 0),
        (None, 0, 0),
    ],
)
def test_json_replies(spark, reply, cards, quiz):
    r = json_recovery.replies(spark.createDataFrame([(1, reply)], "id int, reply string")).first()["cards"]
    assert (len(r["flashcards"]), len(r["quiz"])) == (cards, quiz)
    if cards:
        assert r["flashcards"][0]["difficulty"] == "medium"


def test_compat_and_options():
    assert json_recovery.recover('[{"question":"x"}]', strict_compat=True)["flashcards"] == []
    for raw in ({"options": ["1", "2", "3", "4"]}, {"A": 1, "B": 2, "C": 3, "D": 4}, {"options": {"A": 1, "B": 2, "C": 3, "D": 4}}):
        assert json_recovery.options_map(raw) == {"A": "1", "B": "2", "C": "3", "D": "4"}
    assert json_recovery.options_map({"options": {"a": 1}}) == {"a": "1"}  # a map stays as it is, as answers name its keys
    assert json_recovery.options_map({"A": 1, "options": {"B": 2}}) == {"A": "1"} and json_recovery.options_map({"options": ["1"]}) is None


def test_every_misspelt_key():
    for wrong, right in {"questionimoine": "question", "questin": "question", "questoin": "question", "answr": "answer", "answeer": "answer", "optons": "options", "correctanswer": "correct_answer", "correct_answeer": "correct_answer", "explnation": "explanation", "explantion": "explanation"}.items():
        assert json_recovery.TYPOS[wrong] == right
    assert len(json_recovery.TYPOS) == 10


def test_writes(spark, tmp_path):
    path = str(tmp_path / "cards")
    first = spark.createDataFrame([(1, [("q", "a", None, None), ("", "x", None, None), ("r", None, "t", "hard")]), (2, [("s", "a", None, None)])], "media_id long, cards array<struct<question:string,answer:string,topic:string,difficulty:string>>")
    rows = writes.card_rows(first)
    for _ in range(2):  # a repeated write changes nothing
        writes.replace_children(rows, path)
        assert sorted((r["media_id"], r["card_index"], r["question"], r["difficulty"]) for r in writes.table(spark, path, rows).collect()) == [(1, 0, "q", "medium"), (1, 2, "r", "hard"), (2, 0, "s", "medium")]
    writes.replace_children(rows.where("media_id = 2").withColumn("question", F.lit("new")), path)
    assert sorted(r["question"] for r in writes.table(spark, path, rows).collect()) == ["new", "q", "r"]
    writes.delete(spark, {path: "media_id"}, spark.createDataFrame([(1,)], "id long"))
    assert [r["question"] for r in writes.table(spark, path, rows).collect()] == ["new"]


def test_reviews_and_sessions(spark):
    good, bad = writes.checked_reviews(spark.createDataFrame([(1,), (5,), (6,), (None,)], "confidence int"))
    assert (good.count(), bad.count()) == (2, 2)
    assert [r["accuracy_score"] for r in writes.scored_sessions(spark.createDataFrame([(0, 0), (4, 1)], "total_questions int, correct_answers int")).collect()] == [0.0, 25.0]
    notes = writes.notes(spark.createDataFrame([(1, "T", "S", ["a", "b"], ["c"], [])], "media_id long, lecture_title string, summary string, main_topics array<string>, key_concepts array<string>, learning_outcomes array<string>"))
    assert notes.first()["content"] == "# Study Notes: T\n\n## Overview\n\nS\n\n## Topics\n\n- a\n- b\n\n## Key Concepts\n\n- c\n"


def test_lecture(spark):
    from lectern.operators import lecture

    parts = spark.range(1).select(F.array(*(F.struct(F.lit(t).alias("text"), F.lit(c).alias("confidence")) for t, c in (("a", 0.4), (" ", 0.9), ("b", 0.39)))).alias("p"))
    assert [x["text"] for x in parts.select(lecture.confident(F.col("p")).alias("p")).first()["p"]] == ["a"]
    frames = spark.createDataFrame([(1, i, "low" if i % 2 else "high", "t" if i else None, [f"C{i % 3}", "c0", "z"], " ") for i in range(10)], "media_id long, frame_id long, importance string, slide_title string, key_concepts array<string>, ocr_text string")
    assert [r["concept"] for r in lecture.timeline(frames).orderBy("position").collect()] == ["C0", "C2", "C1"]
    assert lecture.notable(frames, 3).count() == 3 and lecture.meaningful(frames, True).count() == 5 and lecture.meaningful(frames).count() == 10
