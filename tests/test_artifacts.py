"""Files with names of their own: written, listed, pruned and read back."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.sources import artifacts, files

ROWS = [(f"lec {i}/ü", a, json.dumps({"n": i, "a": a})) for i in range(40) for a in ("flashcards", "progress", "frames")] + [("talk", "transcript_txt", "one\ntwo"), ("talk", "transcript_json", None)]


@pytest.mark.parametrize("shards", [1, 8])
def test_round_trip(spark, tmp_path, shards):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame(ROWS, "stem string, artifact string, content string").repartition(3)
    artifacts.write_artifacts(rows, path, shards)
    artifacts.write_artifacts(rows.limit(5), path, shards)  # the same names again
    found = artifacts.read_artifacts(spark, path, shards)
    assert sorted((r["stem"], r["artifact"], bytes(r["content"]).decode()) for r in found.collect()) == sorted((s, a, c or "") for s, a, c in ROWS)
    listing = artifacts.read_artifacts(spark, path, shards, contents=False)
    assert {r["length"] for r in listing.where("artifact = 'transcript_txt'").collect()} == {7} and "content" not in listing.columns
    assert not os.path.exists(f"{path}/_staging/x") and os.path.exists(f"{path}/_SUCCESS") and not os.listdir(f"{path}/_staging")
    name = os.path.join(path, artifacts.shard_of("talk", shards), "talk_transcript.txt")
    assert open(name).read() == "one\ntwo"
    assert {tuple(r) for r in files.stems(listing).collect()} == {(s,) for s, _, _ in ROWS} and files.readiness(listing).where("flashcards_ready and frames_ready and not quiz_ready").count() == 40


def test_filters_reach_the_reader(spark, tmp_path, capfd):
    path = str(tmp_path / "out")
    artifacts.write_artifacts(spark.createDataFrame(ROWS, "stem string, artifact string, content string"), path, 8)
    one = artifacts.read_artifacts(spark, path, 8).where((F.col("stem") == "lec 3/ü") & F.col("artifact").isin("progress", "quiz") & (F.col("length") > 0))
    assert [(r["stem"], r["artifact"]) for r in one.collect()] == [("lec 3/ü", "progress")]
    assert one.rdd.getNumPartitions() == 1  # of eight shards
    assert artifacts.read_artifacts(spark, path, 8).where("stem = 'a' and stem = 'b'").count() == 0
    reader = artifacts.ArtifactReader({"path": path, "shards": "8"}, ["stem"])
    left = list(reader.pushFilters([artifacts.EqualTo(("stem",), "talk"), artifacts.In(("artifact",), ("quiz", "transcript_txt")), artifacts.EqualTo(("length",), 1)]))
    assert [f.attribute for f in left] == [("length",)] and [p.stems for p in reader.partitions()] == [("talk",)]
    assert list(reader.read(reader.partitions()[0])) == [("talk",)]


def test_foreign_folders_and_failures(spark, tmp_path):
    for p in ("a/x_quiz.json", "a/deep/y_quiz.json", "b/z/frames_index.json", "b/other.bin", "c/w_notes.md", "b/_quiz.json"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}")
    found = artifacts.read_artifacts(spark, str(tmp_path), prefixes=["a", "b", "none"], contents=False).collect()
    assert {(r["stem"], r["artifact"]) for r in found} == {("x", "quiz"), ("z", "frames")}
    for bad in [("", "quiz", "x"), (None, "quiz", "x"), ("s", "other", "x")]:
        with pytest.raises(Exception, match="no file for"):
            artifacts.write_artifacts(spark.createDataFrame([("good", "quiz", "x"), bad], "stem string, artifact string, content string").coalesce(1), str(tmp_path / "bad"))
    assert not os.path.exists(tmp_path / "bad" / "_SUCCESS") and not os.path.exists(tmp_path / "bad" / "good_quiz.json")
    artifacts.write_artifacts(spark.createDataFrame([], "stem string, artifact string, content string"), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == ["_SUCCESS"] and artifacts.read_artifacts(spark, str(tmp_path / "none")).count() == 0


def test_json_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("x", [("q1", "a1"), ("q2", None)]), ("y z", [])], "stem string, flashcards array<struct<question:string,answer:string>>")
    files.write_json(rows, str(tmp_path), "flashcards")
    assert sorted(os.listdir(tmp_path)) == ["_SUCCESS", "_staging", "x_flashcards.json", "y%20z_flashcards.json"]
    found = files.read_json(spark, str(tmp_path), "flashcards", "flashcards array<struct<question:string,answer:string>>")
    assert {r["stem"]: [tuple(c) for c in r["flashcards"]] for r in found.collect()} == {"x": [("q1", "a1"), ("q2", None)], "y z": []}


def test_transcript_files(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "one two", [(0.0, "one"), (2.0, "two")]), ("s2", None, None)], "stem string, full_text string, segments array<struct<start:double,text:string>>")
    files.write_transcript_files(rows, str(tmp_path), shards=1)
    assert (tmp_path / "s1_transcript.txt").read_text() == "one two" and json.loads((tmp_path / "s1_transcript.json").read_text()) == {"full_text": "one two", "segments": [{"start": 0.0, "text": "one"}, {"start": 2.0, "text": "two"}]}
    assert (tmp_path / "s2_transcript.txt").read_text() == ""
