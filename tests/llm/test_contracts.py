"""The registered queries against what they must return, and the pipeline's stages one by one."""

from __future__ import annotations

import os
import shutil
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing, pii, quality, queries
from lectern.llm.common import written

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages labels benchmark conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rest(doc_id, of: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % of


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_as_in_sql(spark, db, name):
    found, told = queries.queries()[name](spark, SF).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(told.columns)

    def plain(df):
        one = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) else v
        return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)

    assert plain(found) == plain(told)


@pytest.mark.parametrize(("name", "label", "of", "held"), [("op2_quality", "quality", 3, 1), ("op4_toxicity", "toxic", 5, 0)])
def test_scores(spark, db, tmp_path, name, label, of, held):
    ids = db.sql("select doc_id from documents").df().doc_id
    rows = queries.queries()[name](spark, SF).toPandas()
    assert list(rows.columns)[:4] == ["doc_id", "held_out", "score", "predicted"] and sorted(rows.doc_id) == sorted(ids)
    assert all(h == (rest(i, of) == held) for i, h in zip(rows.doc_id, rows.held_out, strict=True)) and rows.held_out.any() and not rows.held_out.all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    # labels of rows that may not be learned from, and the columns that are never inputs, change nothing
    for t in TABLES:
        shutil.copy(f"{SF}/{t}.parquet", tmp_path) if os.path.isfile(f"{SF}/{t}.parquet") else shutil.copytree(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.remainder(F.col("doc_id"), of) == held
    for t, df in (("labels", labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))), ("documents", spark.read.parquet(f"{SF}/documents.parquet").withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")}))):
        df = written(df, "changed")
        shutil.rmtree(tmp_path / f"{t}.parquet") if (tmp_path / f"{t}.parquet").is_dir() else (tmp_path / f"{t}.parquet").unlink()
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    again = queries.queries()[name](spark, str(tmp_path)).toPandas()
    assert dict(zip(rows.doc_id, rows.score.round(6), strict=True)) == dict(zip(again.doc_id, again.score.round(6), strict=True))


def test_texts_and_pages(spark, db):
    docs, pages = db.sql("select doc_id, text from documents").df(), db.sql("select page_id, url from pages").df()
    told = queries.queries()["op3_pii"](spark, SF).toPandas()
    assert list(told.columns)[:2] == ["doc_id", "text"] and sorted(told.doc_id) == sorted(docs.doc_id)
    by_hand = pii.Pseudonyms(pii.session_key(spark))
    own = dict(zip(docs.doc_id, docs.text, strict=True))
    assert all(t == by_hand.replace(own[i])[0] for i, t in zip(told.doc_id, told.text, strict=True) if own[i] is not None)
    told = queries.queries()["op6_html"](spark, SF).toPandas()
    assert list(told.columns)[:4] == ["page_id", "url", "text", "n_chars"] and sorted(told.page_id) == sorted(pages.page_id) and (told.text.str.len() == told.n_chars).all()


def test_neighbours(spark, db):
    e = db.sql("select vec_id, embedding from embeddings").df()
    told = queries.queries()["op7_ann"](spark, SF).toPandas()
    assert list(told.columns)[:4] == ["query_id", "rank", "vec_id", "score"]
    good = [x is not None and len(x) and np.isfinite(x).all() and np.any(x) for x in e.embedding]
    ids, x = e.vec_id[good].to_numpy(), np.array([np.asarray(v, float) for v in e.embedding[good]])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    hit = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        own = told[told.query_id == ids[q]].sort_values("rank")
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and (own.score.diff().dropna() <= 1e-12).all() and ids[q] not in set(own.vec_id)
        assert np.allclose(own.score, [s[list(ids).index(v)] for v in own.vec_id], atol=1e-12)
        hit.append(len(set(own.vec_id) & set(ids[np.argsort(-s, kind="stable")[:5]])) / 5)
    assert np.mean(hit) >= 0.9


def test_packing_columns(spark):
    assert queries.queries()["op10_packing"](spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


EDGES = [(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "word " * 20_000, "en", "src1", 100_000), (9004, "again the same words of a text that is here twice", "en", "src2", 9), (9004, "again the same words of a text that is here twice", "en", "src2", 9), (9005, "again the same words of a text that is here twice", "en", "src3", 9), (None, "a text without an id at 10.0.0.1", "en", "src1", 3), (9006, "mail ann@corp.example on 1987-03-21", "de", "src5", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    edges = spark.createDataFrame(EDGES, given.select("doc_id", "text", "lang", "source", "n_chars").schema)
    return written(given.limit(60).unionByName(edges.withColumn("_h", F.lit("clash")).select(*given.columns)), "stage-docs")


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def values(df) -> list:
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_stages(spark, docs):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"] and p.ORACLE_SQL is None
    every = values(docs)
    kept = stages["quality classifier"](spark, docs, SF)
    machine = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), quality.may_learn())
    assert values(kept) == values(quality.scored(docs, machine).where("_score >= 0.5"))
    one = values(stages["n-gram Jaccard join"](spark, docs, SF))
    assert set(one) <= set(every) and [r[0] for r in one].count(9004) == 1 and 9005 not in [r[0] for r in one]
    assert {9001, 9002, 9003, None, 9006} <= {r[0] for r in one}
    key = pii.session_key(spark)
    told = {r[0]: r for r in values(stages["PII"](spark, docs, SF))}
    for doc_id, text, lang, source, _ in every:
        new = None if text is None else pii.Pseudonyms(key).replace(text)[0]
        assert told[doc_id][1:4] == (new, lang, source) and told[doc_id][4] == (None if new is None else len(new))
    assert "10.0.0.1" not in told[None][1] and "ann@" not in told[9006][1]
    drawn = values(stages["mixing sources to target weights"](spark, docs, SF))
    tokens = lambda t: len((t or "").split())
    total = sum(tokens(r[1]) for r in every)
    assert sum(tokens(r[1]) for r in drawn) <= total * mixing.BUDGET_PERCENT // 100
    own = {}
    for r in every:
        own.setdefault(r[0], []).append((r[1] or "").split())
    assert all(any(x[: tokens(r[1])] == r[1].split() for x in own[r[0]]) for r in drawn)  # whole texts, or a prefix
    from tokenizers import Tokenizer

    from lectern.llm import packing

    told_, packed = Tokenizer.from_file(packing.default_path()), stages["best-fit packing"](spark, docs, SF).toPandas()
    expected = []
    for doc_id, text, *_ in every:
        ids = [*told_.encode(text or "", add_special_tokens=False).ids, 1]
        expected += [(at // 4096, at, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for at in range(0, len(ids), 4096) for x in [ids[at : at + 4096]]]
    assert sorted(packed[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(expected)
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096


def test_stages_of_nothing(spark, docs):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        out = stage(spark, docs.where("false"), SF)
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == COLUMNS)


def test_tables_with_copies(spark, db, tmp_path):
    """The registered queries of archives and vectors against their SQL, on tables that have revisits and links."""
    rng = np.random.default_rng(7)
    e = db.sql("select vec_id, embedding, label from embeddings order by vec_id limit 120").df()
    rows = [(int(i), [float(x) for x in v], int(l)) for i, v, l in e.itertuples(index=False)]
    for n, (_, v, l) in enumerate(rows[:60]):  # chains of ever less alike vectors, copies, and the same in another label
        for k in range(3):
            rows.append((10_000 + 10 * n + k, [x + float(rng.normal()) * 0.07 * k * abs(x) for x in v], l if n % 4 else (l + 1) % 10))
    rows += [(20_000, None, 1), (20_001, [0.0] * 64, 1), (20_002, rows[0][1], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    pages = [(int(r.page_id), r.url, r.html) for r in db.sql("select page_id, url, html from pages order by page_id limit 30").df().itertuples()]
    pages += [(5_000 + i, f"http://copy.example/{i}", pages[i % 4][2]) for i in range(20)] + [(6_000, "http://empty.example/", None), (6_001, None, None), (6_002, "http://empty.example/2", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    own = duckdb.connect()
    for name, some in (("op9_vector_dedup", "n_links > 0"), ("op8_warc", "record_type = 'revisit'")):
        table = "embeddings" if "vector" in name else "pages"
        own.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        found = queries.queries()[name](spark, str(tmp_path))
        columns = sorted(found.columns)
        assert found.where(some).count() > 15
        assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(own.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall(), key=repr), name
