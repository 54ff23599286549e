"""Registered queries over whole inputs, where their SQL sees a part only."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import registry
from lectern.functions import text
from lectern.operators import graph
from lectern.plans.bindings import Tables


def found(spark, name: str, sf_dir) -> list:
    return registry.queries()[name](spark, str(sf_dir)).collect()


def test_whole_texts(spark, tmp_path):
    texts = ["- " * 40 + "a" * 49, "- " * 40 + "b" * 50, "x " * 60 + "last one's", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["importance"] for r in found(spark, "importance_class", tmp_path)} == {0: "medium", 1: "high", 2: "high", 3: "low"}
    assert {r["doc_id"]: r["title"] for r in found(spark, "title_case", tmp_path)} == {0: "- " * 40 + "A" + "a" * 48, 1: "- " * 40 + "B" + "b" * 49, 2: "X " * 60 + "Last One'S", 3: None}


def test_frames_of_whole_texts(spark, tmp_path):
    texts = {i: "- " * 150 + "z" * 60 for i in range(2000)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frames = Tables(spark, str(tmp_path)).frames().collect()
    assert all(r["importance"] == "high" and r["ocr_text"] == texts[r["frame_id"]] for r in frames)
    assert len({r["media_id"] for r in frames}) == 40
    rows = found(spark, "notable_slides", tmp_path)
    assert len(rows) == 40 * 35 and {r["media_id"] for r in rows} == set(range(40))
    assert len(found(spark, "meaningful_frames", tmp_path)) == 2000
    assert len({r["media_id"] for r in found(spark, "concept_timeline", tmp_path)}) == 40


def test_whole_graph(spark, tmp_path):
    brands = [f"B{i:02}" for i in range(90)]
    spark.createDataFrame([(i, b) for i, b in enumerate(brands)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7, i, i) for i in range(90)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert len(found(spark, "graph_pruned", tmp_path)) == 80
    assert len(found(spark, "graph_links", tmp_path)) == 80 * 79 // 2
    mentions = Tables(spark, str(tmp_path)).concepts()
    kept = graph.pruned(mentions, graph.cooccurrence(mentions), 3)
    assert sorted((r["position"], r["node"]) for r in kept.collect()) == [(1, "b00"), (2, "b01"), (3, "b02")]
    assert graph.exported(kept, graph.cooccurrence(mentions)).count() == 3


def test_stitches_every_chunk(spark, tmp_path):
    spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(8)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = found(spark, "chunk_stitch", tmp_path)
    assert sorted((r["id"], r["chunk_index"], r["start"], r["text"]) for r in rows) == [(2 * c + k, c, c * 300.0 + (c + 4 * k) // 2, f"t{c + 4 * k}") for c in range(4) for k in range(2)]


def test_every_language(spark, tmp_path):
    assert len({c for c, *_ in text.LANGUAGES}) == 37
    langs = ["zh", "zh-tw", " TR\n", "ml", "he", "en", "xx", None]
    spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    names = ["Chinese (Simp.)", "Chinese (Trad.)", "Turkish", "Malayalam", "Hebrew"]
    assert [r["prompt"] for r in sorted(found(spark, "language_prefix", tmp_path))] == [f"Answer in {n}.\n\nExplain" for n in names] + ["Explain"] * 3
    codes = Tables(spark, str(tmp_path)).documents().orderBy("doc_id")
    assert [r[0] for r in codes.select(text.ocr_langs(F.col("lang"))).collect()] == [["ch_sim", "en"], ["ch_tra", "en"], ["tr", "en"], ["en"], ["he", "en"], ["en"], ["en"], ["en"]]
