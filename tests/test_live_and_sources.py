from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from lectern.schemas import TABLES
from lectern.sources import files, models
from lectern.streaming import live

SEGMENTS = [("s", 0, 1, 0.0, 1.0, "one two"), ("s", 0, 2, 0.0, 1.5, "again"), ("s", 1, 3, 2.0, 3.0, "three four five"), ("t", 2, 4, 1.0, 2.0, "x")]


def test_stream_like_batch(spark, tmp_path):
    for i, row in enumerate(SEGMENTS):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(dict(zip(["session_id", "chunk_index", "id", "start", "end", "text"], row, strict=True))))
    stream = live.source(spark, str(tmp_path / "in"))
    live.write_transcripts(stream, str(tmp_path / "out"), str(tmp_path / "c1"), once=True).awaitTermination(120)
    batch = spark.createDataFrame(SEGMENTS, TABLES["live_segments"])
    key = lambda df: sorted((r["session_id"], r["start"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(live.deduped(live.shifted(batch)))
    live.write_counters(stream, str(tmp_path / "counters"), str(tmp_path / "c2"), once=True).awaitTermination(120)
    assert sorted(map(tuple, live.counted(spark, str(tmp_path / "counters")).collect())) == sorted(map(tuple, live.counters(batch).collect()))


def test_stitch_and_final_pass(spark):
    rows = spark.createDataFrame([("s", 0, 0, 1.0, 2.0, "a"), ("s", 0, 1, 2.0, 3.0, "b"), ("s", 2, 0, 0.5, 1.0, "c")], TABLES["live_segments"])
    assert sorted((r["id"], r["start"]) for r in live.stitched(rows).collect()) == [(0, 1.0), (1, 2.0), (2, 600.5)]
    full = rows.withColumn("text", F.lit("full"))
    assert sorted(r["text"] for r in live.final_pass(rows.where("chunk_index = 0"), full).collect()) == ["a", "b", "full"]


def test_sampling_and_slides(spark):
    rows = spark.range(23).select(F.lit(1).alias("g"), F.col("id").alias("i"))
    assert sorted(r["i"] for r in live.uniform_sample(rows, ["g"], "i").collect()) == [0, 2, 4, 6, 9, 11, 13, 16, 18, 20]
    a, b = [1.0, 2.0, 3.0], [3.0, 1.0, 2.0]
    frames = spark.createDataFrame([("v", 0.0, a, a), ("v", 0.5, b, b), ("v", 2.0, a, a), ("v", 3.0, b, b)], "stream string, at double, histogram array<double>, pixels array<double>")
    kept = live.slide_changes(frames)
    assert sorted(r["at"] for r in kept.collect()) == [0.0, 3.0]
    assert live.slide_stats(frames, kept).first()["skipped_pct"] == 50.0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "b.txt").write_text("# T\n\nbody text")
    (tmp_path / "c.exe").write_text("no")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>three</w:t></w:p>")
    (tmp_path / "e.docx").write_text("broken")
    good, bad = files.intake(spark, str(tmp_path), "document")
    assert bad.count() == 1 and good.count() == 4
    pages = files.pages(good)
    assert pages.where("error is not null").count() == 1
    told = {r["title"]: (r["text"], r["word_count"]) for r in files.documents(files.first_pages(pages)).collect()}
    assert told["A"] == ("café", 1) and told["D"] == ("One & two\nthree", 4) and told["B"][1] == 4


def test_artifacts(spark, tmp_path):
    for name in ("x_study_notes.md", "x_quiz.json", "y_academic_report.pdf", "z_progress.json", "other.bin"):
        (tmp_path / name).write_text('{"a": 1}')
    ready = {r["stem"]: (r["notes_ready"], r["quiz_ready"], r["report_ready"]) for r in files.readiness(files.artifacts(spark, str(tmp_path))).collect()}
    assert ready == {"x": (True, True, False), "y": (False, False, True), "z": (False, False, False)}
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "frames_index.json").write_text("[]")
    assert sorted(r["stem"] for r in files.stems(files.artifacts(spark, str(tmp_path))).collect()) == ["w", "x", "y"]
    assert files.exists(spark, str(tmp_path / "x_quiz.json")) and files.objects(spark, str(tmp_path)).count() == 6
    files.put(spark, str(tmp_path / "other.bin"), str(tmp_path / "x_copy.bin"))
    assert files.delete_prefix(spark, str(tmp_path), "x_c") == 1 and not files.exists(spark, str(tmp_path / "x_copy.bin"))
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path), "quiz", "a int").select("a", "stem").collect()] == [(1, "x")]


def test_models(spark):
    rows = spark.createDataFrame([(1, "p\nq"), (2, "bad")], "id int, prompt string")

    def made():
        def model(prompts):
            if "bad" in prompts:
                raise ValueError("refused")
            return [p.upper() for p in prompts]

        return model

    told = {r["id"]: (r["reply"], r["reply_error"]) for r in models.reasoned(rows, made).collect()}
    assert told == {1: ("P\nQ", None), 2: (None, "ValueError: refused")}
    assert {r["reply"] for r in models.reasoned(rows, models.echo).collect()} == {"p", "bad"}


def test_documents_tell_their_cuts(spark, tmp_path):
    (tmp_path / "long.txt").write_text("w " * 100)
    (tmp_path / "p.pdf").write_text("%PDF-1.4")
    good, _ = files.intake(spark, str(tmp_path), "document")
    told = {r["title"]: r for r in files.documents(files.pages(good), 50).collect()}
    assert told["Long"]["char_count"] == 50 and told["Long"]["error"] == "[Text truncated to 50 chars]"
    assert told["P"]["text"] == "" and told["P"]["error"]  # no parser, or no PDF: told in the row


def test_transcript_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one"), (2, "two")], "media_id long, full_text string")
    files.write_transcripts(rows, str(tmp_path / "t"), files=1)
    assert [r["value"] for r in files.text_of(spark, str(tmp_path / "t"), 2).collect()] == ["two"]


def test_boundaries(spark):
    chunks = spark.createDataFrame([("s", i, str(d).encode()) for i, d in enumerate([1.0, 1.2, 2.0])] + [("s", 3, b"x")], "session_id string, chunk_index int, content binary")
    told = models.sliced(chunks, lambda: lambda cs: [float(c) for c in cs])
    assert sorted(map(tuple, told.collect())) == [("s", 0, 0.0, 1.0), ("s", 2, 1.0, 2.0)]
    wave = models.converted(chunks.limit(1), lambda: lambda cs: [b"RIFF" + c for c in cs])
    assert bytes(wave.first()["audio"]).startswith(b"RIFF")
    now = iter([0, 1, 2, 400, 401])
    assert models.timely("abcd", clock=lambda: next(now)) == ["a", "b"]
    pages = spark.createDataFrame([("d", 1, "good"), ("d", 2, "bad"), ("d", 3, "")], "path string, page_num int, text string")

    def made():
        def model(texts):
            if "bad" in texts:
                raise ValueError("no")
            return [{"title": t.upper(), "importance": "high", "description": "d", "summary": "s"} if t else None for t in texts]

        return model

    told = {r["page_num"]: (r["title"], r["importance"], r["description"]) for r in models.analysed_pages(pages, made).collect()}
    assert told == {1: ("GOOD", "high", "d"), 2: ("Page 2", "medium", "bad"), 3: ("Page 3", "low", "No content detected.")}
    assert [(r["stream"], r["round"]) for r in live.round_robin(spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 5.0)], "stream string, at double")).orderBy("round", "stream").collect()] == [("a", 0), ("b", 0), ("a", 1)]
