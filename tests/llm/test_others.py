"""Mixing, packing, vectors, pages, archives and the pipeline: small cases and brute force."""

from __future__ import annotations

import gzip
import os
import random
import struct
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, html_diff, mixing, packing, vector_dedup, warc
from lectern.llm.common import new_path, written

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("public_tokenizers")


def levels():
    return {"domain": mixing.domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def drawn(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string, _id int")
    found = mixing.mix(docs, levels(), mixing.WEIGHTS, mixing.budget(), **options)
    names = sorted(found.columns)
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    rows = sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr)
    assert rows == sorted(c.sql(f"select {', '.join(names)} from ({mixing.sql()})").fetchall(), key=repr)
    return found.toPandas()


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "en", "de", "fr", None]), rng.choice(["src0", "src0", "src5", "src10", "src19", None]), "e", 1) for i in range(400)]
    rows += [(900, None, "en", "src0", "e", 1), (901, " \n", "en", "src0", "e", 1), (None, "a b c", "en", "src5", "e", 1)] + rows[:20]
    found = drawn(spark, rows)
    total = sum(len((r[1] or "").split()) for r in rows)
    assert found.take_tokens.sum() == total * mixing.BUDGET_PERCENT // 100
    assert (found.take_tokens > 0).all() and (found.epoch < mixing.MAX_EPOCHS).all()


def test_mixing_siblings_first(spark):
    # books' German source can't fill its share, so its sibling language takes it before the other domains do
    leaves = spark.createDataFrame([("books", "de", "src5", 10), ("books", "en", "src5", 1000), ("web", "en", "src1", 1000)], "domain string, lang string, source string, tokens long")
    out = {(r["domain"], r["lang"]): r["alloc"] for r in mixing.allocate(leaves, ["domain", "lang", "source"], mixing.WEIGHTS, F.lit(600), 2).collect()}
    assert out == {("books", "de"): 20, ("books", "en"): 380, ("web", "en"): 200}


def test_mixing_empty_and_prefix(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(docs, levels(), mixing.WEIGHTS, mixing.budget()).count() == 0
    told = spark.createDataFrame([(" a\nb  c d", 3), ("x " * 20_000, 15_000)], "t string, n long").select(mixing.prefix(F.col("t"), F.col("n"))).collect()
    assert told[0][0] == " a\nb  c" and told[1][0].count("x") == 15_000


TEXTS = [None, "", "Hello, World! It's 3 o'clock", "ÀÉÎ çà naïve ßtraße", "<|endoftext|> x", "日本語 mixed İstanbul", "a\x1cb c\xa0d", "don't I'll we've 's'the", "x" * 9000, "word " * 9000, "½² ¼kg", "ŉ ĳ ſ ΑΣ", "é é"]


@pytest.mark.parametrize("rows", [2_000, 3])  # as it is, and with split lengths
def test_packing(spark, monkeypatch, rows):
    monkeypatch.setattr(packing, "BUCKET_ROWS", rows)
    from tokenizers import Tokenizer

    told = Tokenizer.from_file(packing.default_path())
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta.", "Gamma", "delta,"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)] + [(5000, "same", "p")] * 3, "doc_id long, text string, piece string").repartition(3)
    rows = packing.pack(written(packing.pieces(docs), "t")).toPandas()
    expected = []
    for i, t in [*enumerate(texts), *[(5000, "same")] * 3]:
        ids = [*told.encode(t or "", add_special_tokens=False).ids, 1]
        expected += [(i, at // 4096, at, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for at in range(0, len(ids), 4096) for p in [ids[at : at + 4096]]]
    assert sorted(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(expected)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 4096) + 1
    assert packing.pack(written(packing.pieces(docs.where("false")), "t")).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        counts = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(12)}
        bins: list[int] = []
        for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
            fits = [i for i, s in enumerate(bins) if s >= length]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= length
            else:
                bins.append(50 - length)
        runs = packing.plan(counts, 50)
        used: dict = {}
        for length, _, n, first, offset in runs:
            for s in range(first, first + n):
                used.setdefault(s, []).append((offset, length))
        assert len(used) == len(bins)
        for s in used.values():
            s.sort()
            assert all(o == sum(x for _, x in s[:i]) for i, (o, _) in enumerate(s)) and sum(x for _, x in s) <= 50
        assert all(sum(r[2] for r in runs if r[0] == k) == n for k, n in counts.items())


def vectors(n: int, dim: int = 24, seed: int = 0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    for i in range(0, n, 4):  # near and equal copies
        x[i] = x[0] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.05, 0.12])
    return [(i, [float(v) for v in row], i % 3 if i % 4 else 0) for i, row in enumerate(x)]


BAD = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 24, 0), (9003, [1.0] * 23 + [None], 0), (9004, [float("nan")] * 24, 0), (9005, [float("inf")] * 24, 0), (9050, [0.0] * 24, 1), (9006, [1.0, 2.0], 0), (9007, [1.0] * 24, None)]


def test_projections_grow_with_the_label():
    told = [vector_dedup.projections_for(n) for n in (0, 1, 10**5, 10**7, 10**9)]
    assert told[:3] == [8, 8, 8] and 8 < told[3] < told[4] < 20


@pytest.mark.parametrize("block", [256, 16, 5])  # as it is, and with split buckets and groups
def test_vector_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = vectors(160)
    df = spark.createDataFrame([(*r, "k") for r in rows + BAD], "vec_id long, embedding array<float>, label int, key string").repartition(3)
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    component = np.arange(len(rows))
    for _ in rows:
        component = np.minimum(component, np.where(near, component, 10**6).min(1))
    told = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect()}
    assert told == {i: (int(near[i].sum()), int(component[i]), int(component[i]) == i) for i in range(len(rows))} | {b[0]: (0, b[0], True) for b in BAD}
    assert vector_dedup.near_duplicates(df.where("false")).count() == 0


def test_nearest(spark):
    rows = vectors(400, seed=2)
    df = spark.createDataFrame([(*r, 1.0) for r in rows + BAD], "vec_id long, embedding array<float>, label int, score double").repartition(3)
    found = ann.search(df, F.col("vec_id") % 50 == 0).toPandas()
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 400, 50):
        s = (x @ x[q]).round(11)
        s[q] = -2
        own = found[found.query_id == q].sort_values("rank")
        assert list(own["rank"]) == [1, 2, 3, 4, 5] and q not in set(own.vec_id)
        assert np.allclose(own.score, s[own.vec_id], atol=1e-9)
        hit += len(set(own.vec_id) & set(np.lexsort((np.arange(400), -s))[:5]))
    assert hit >= 36 and set(found.query_id) == set(range(0, 400, 50))
    few = ann.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2]
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def test_nearest_in_many_cells(spark, monkeypatch):
    """Two dimensions with queries in each, cells of few entries, and buckets in several pieces."""
    monkeypatch.setattr(ann, "CELL", 40)
    rng = np.random.default_rng(5)
    rows = []
    for dim, n, base in ((12, 260, 0), (5, 120, 1000)):
        middle = rng.normal(size=(6, dim))
        rows += [(base + i, (middle[i % 6] + rng.normal(size=dim) * 0.3).tolist()) for i in range(n)]
    rows += [(2000, [1.0, 0.0]), (2001, [0.0, 1.0]), (2002, [3.0])]  # hardly any other vector, and none
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = ann.search(df, (F.col("vec_id") % 20 == 0) | (F.col("vec_id") > 2000)).toPandas()
    hit = asked = 0
    for q, v in rows:
        if q % 20 == 0 or q > 2000:
            near = sorted(((-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in rows if len(w) == len(v) and i != q))[:5]
            own = found[found.query_id == q].sort_values("rank")
            assert list(own["rank"]) == list(range(1, len(near) + 1)), q
            hit, asked = hit + len({i for _, i in near} & set(own.vec_id)), asked + len(near)
    assert hit >= 0.9 * asked and asked > 90


def test_nearest_ties_and_repeats(spark):
    at = {"a": [1.0, 0.0, 0.0], "b": [2.0, 0.0, 0.0], "c": [1.0, 1.0, 0.0], "d": [-1.0, 0.0, 0.0], "e": [1e200, 0.0, 0.0]}
    rows = [(0, at["a"]), (7, at["b"]), (3, at["b"]), (5, at["c"]), (5, at["c"]), (6, at["d"]), (8, at["e"]), (0, at["c"]), (None, at["a"])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(df, F.col("vec_id") == 0, k=6).collect()]
    half = round(0.5**0.5, 9)
    by_first = [(0, i, v, s) for i, (v, s) in enumerate([(3, 1.0), (7, 1.0), (8, 1.0), (0, half), (5, half), (5, half)], 1)]
    by_other = [(0, i, v, s) for i, (v, s) in enumerate([(5, 1.0), (5, 1.0), (0, half), (3, half), (7, half), (8, half)], 1)]
    assert sorted(found) == sorted(by_first + by_other)


def test_fitted_probes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = [np.array([v + rng.normal(size=16) * 0.01 for _ in range(3)]) for v in x[:10]]
    near = [n / np.linalg.norm(n, axis=1)[:, None] for n in near]
    assert ann.fitted(x[:10], near, 24)[1] <= 3  # close neighbours need few probes
    far = [x[11:14]] * 10
    assert ann.fitted(x[:10], far, 24)[0] < 24  # and far ones wider buckets
    assert [ann.projections_for(n) for n in (10, 10**5, 10**6, 10**9)] == [16, 16, 22, 42]


def test_perturbations_in_order():
    rng = np.random.default_rng(1)
    for _ in range(5):
        f = rng.uniform(size=4)
        cost = lambda steps: sum((f[i] ** 2 if s < 0 else (1 - f[i]) ** 2) for i, s in steps)  # noqa: E731, B023
        told = ann.perturbations(f, 81)
        assert len(set(map(frozenset, told))) == 81 and np.all(np.diff([cost(s) for s in told]) >= -1e-12)


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        pairs = html_diff.common(a, b)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def page(body: str) -> str:
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav>{body}<footer>&copy; site</footer></body></html>"


def test_pages(spark):
    rows = [
        (1, "http://a.b/x/1", page("<div class='ad'>Buy</div><article><header><h1>T &amp; t</h1></header><p>One\n two<p>Three<br>four<div class=share-bar>Share</div></article>")),
        (2, "http://a.b/x/2", page("<div>Welcome to the site</div><div>Only here</div><script>if (a<b) {}</script><div>Call us</div>")),
        (3, "http://a.b/x/3", page("<div>Welcome to the site</div><div>Only there</div><div>Call us</div><form>Mail <input></form>")),
        (4, "http://c.d/", None),
        (5, None, "plain <b>te</b>xt"),
        (6, "http://a.b/x/2", page("<div>Welcome to the site</div><div>Only here too</div><div id='comments'><p>first!</div><div>Call us</div>")),
        (7, "http://e.f", "<article>" + "<p>long</p>" * 3000),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    told = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_diff.extract(df).collect()}
    texts = {k: v[0] for k, v in told.items()}
    assert texts[1] == "T & t\nOne two\nThree four" and texts[2] == "Only here" and texts[3] == "Only there" and texts[6] == "Only here too"
    assert texts[4] == "" and texts[5] == "plain text" and texts[7].count("\n") == 2999
    assert all(len(t) == n for t, n in told.values())
    assert html_diff.extract(df.where("false")).count() == 0


def test_ranks(spark):
    df = spark.range(500).select(F.when(F.col("id") < 400, "h").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("host"), (F.col("id") * 37 % 500).alias("k"))
    rows = html_diff.ranked(df, "host", ["k"], 7).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["host"], []).append((r["k"], r["rank"], r["of"]))
    for own in by.values():
        own.sort()
        assert [x[1] for x in own] == list(range(len(own))) and {x[2] for x in own} == {len(own)}


def test_archives(spark):
    long = "y" * 50_000 + "é" * 9_000
    pages = [(1, "http://a/b c", "<p>é</p>"), (2, None, "<p>é</p>"), (2, None, "<p>é</p>"), (5, "u", None), (6, "u\nX: y", ""), (7, "x", long), (7, "x", long), (8, "x", "WARC/1.1\r\n\r\n0\r\n\r\n")]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, digest string")
    path = new_path(spark, "warc-test")
    warc.write(df, path)
    rows = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"], bytes(r["payload"]) if r["payload"] is not None else None) for r in warc.read(spark, path, payloads=True).collect())
    assert [r[:4] for r in rows] == [(1, 9, "revisit", 2), (2, 9, "response", None), (2, 9, "response", None), (5, 0, "revisit", 6), (6, 0, "response", None), (7, 68_000, "response", None), (7, 68_000, "response", None), (8, 17, "response", None)]
    for r, p in zip(rows, pages, strict=True):
        payload = (p[2] or "").encode()
        assert r[4] == warc.digest(payload) and r[5] in (None, payload)
    for f in sorted(Path(path.removeprefix("file://")).glob("part-*")):  # any gzip reader takes them
        with gzip.open(f) as g:
            assert g.read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    plain = new_path(spark, "warc-plain")
    warc.write(df, plain, gzip=False)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, warc.read(spark, plain).select(*columns).collect())) == sorted(map(str, warc.read(spark, path).select(*columns).collect()))
    empty = new_path(spark, "warc-empty")
    warc.write(df.where("false"), empty)
    assert warc.read(spark, empty).count() == 0
    bare = new_path(spark, "warc-bare")
    warc.write(df.select(F.lit(None).cast("long").alias("page_id"), "url", "html"), bare)
    assert [(r["page_id"], r["record_type"]) for r in warc.read(spark, bare).collect()] == [(None, "response")] * 8


def foreign(**fields) -> bytes:
    """A record as another writer would make it."""
    block = fields.pop("block")
    lines = ["WARC/1.0", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhello"
    records = [
        foreign(WARC_Type="warcinfo", WARC_Record_ID="<i>", block=b"software: x\r\n"),
        foreign(WARC_Type="response", WARC_Record_ID="<a>", Content_Type="application/http; msgtype=response", block=http),
        foreign(WARC_Type="request", WARC_Record_ID="<q>", block=b"GET / HTTP/1.1\r\n\r\n"),
        foreign(WARC_Type="response", WARC_Record_ID="<d>", Content_Type="text/dns", block=b"a.b. 300 IN A 1.2.3.4"),
        foreign(WARC_Type="revisit", WARC_Record_ID="<r>", WARC_Refers_To="<a>", WARC_Payload_Digest=f"sha1:{warc.digest(b'hello')}", block=b""),
        foreign(WARC_Type="revisit", WARC_Record_ID="<s>", WARC_Refers_To="<gone>", block=b""),
        foreign(WARC_Type="revisit", WARC_Record_ID="<t>", block=b""),
    ]
    (tmp_path / "many.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))  # a member each
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "none.warc").write_bytes(b"")
    for name in ("many.warc.gz", "one.warc.gz", "plain.warc", "none.warc"):
        rows = sorted((r["record_type"], r["payload_bytes"] or 0) for r in warc.read(spark, str(tmp_path / name)).collect())
        assert rows == ([] if name == "none.warc" else [("response", 5), ("response", 21), ("revisit", 0), ("revisit", 0), ("revisit", 5)]), name
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:3])) + gzip.compress(records[3])[:-30])
    told = warc.read(spark, str(tmp_path / "cut.warc.gz"), keep_broken=True).collect()
    assert sorted(r["record_type"] for r in told) == ["broken", "response"] and all(bool(r["error"]) == (r["record_type"] == "broken") for r in told)
    with pytest.raises(Exception, match="gzip member"):
        warc.read(spark, str(tmp_path / "cut.warc.gz"))


def test_missing_segment(spark, tmp_path):
    made = warc.responses(1, "u", b"z" * 30_000)
    (tmp_path / "x.warc").write_bytes(b"".join(r + b"\r\n\r\n" for i, r in enumerate(made) if i != 1))
    assert [r["record_type"] for r in warc.read(spark, str(tmp_path), keep_broken=True).collect()] == ["broken"]
    with pytest.raises(Exception, match="segments"):
        warc.read(spark, str(tmp_path))


def test_broken_archives():
    block = warc.responses(1, "u", b"z" * 20_000)
    assert len(block) > 2
    data = b"".join(r + b"\r\n\r\n" for r in block)
    assert len(list(warc.parse(data))) == len(block)
    with pytest.raises(ValueError, match="cut off|no record|length"):
        list(warc.parse(data[:-100]))
    with pytest.raises(ValueError, match="chunk"):
        warc.unchunked(b"5\r\nabcdefgh\r\n0\r\n\r\n")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= seen, name
    rows = docs.toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 4096 and len(corpus_pipeline.STAGES) == 5


def test_registered(spark):
    from lectern.llm import queries

    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(queries.oracle_sql()) <= set(names)


def told_apart(spark, bodies: list[str]) -> list[str]:
    df = spark.createDataFrame([(i, f"http://a.b/{i:04}", page(b)) for i, b in enumerate(bodies)], "page_id long, url string, html string").repartition(3)
    return [r["text"] for r in sorted(html_diff.extract(df).select("page_id", "text").collect())]


def test_pages_below_long_menus(spark):
    menu = "".join(f"<div>Chapter {i} of the unmarked menu</div>" for i in range(30))
    assert told_apart(spark, [f"{menu}<div>Short text number {i}</div><div>Imprint</div>" for i in range(9)]) == [f"Short text number {i}" for i in range(9)]


@pytest.mark.parametrize("copies", [7, 12, 90])
def test_pages_among_copies(spark, copies):
    menu, article = "<div>Menu of the site</div>", "".join(f"<div>Sentence {i} of an article with copies</div>" for i in range(20))
    bodies = [f"{menu}{article}<div>Seen {i} times</div>" for i in range(copies)] + [f"{menu}<div>Another article, which has its own text {i}</div>" for i in range(2)]
    told = told_apart(spark, bodies)
    lines = [f"Sentence {i} of an article with copies" for i in range(20)]
    assert [t.split("\n") for t in told[:copies]] == [[*lines, f"Seen {i} times"] for i in range(copies)]
    assert told[copies:] == [f"Another article, which has its own text {i}" for i in range(2)]


def test_names_that_are_no_frames():
    found = lambda body: [t for t, k in html_diff.lines(f"<body>{body}</body>") if k != html_diff.FRAME]
    for body in (
        "<p data-id='sidebar-12'>Text</p>", "<form><div>Text</div></form>", "<article><section class='related-work'>Text</section></article>", "<article><span class='share-price'>Text</span></article>",
        "<div class='search-results'>Text</div>", "<article class='has-sidebar'>Text</article>", "<div class='content-sidebar-wrap'><article>Text</article></div>", "<div class='md:hidden overflow-hidden'>Text</div>", "<p title='class=ad'>Text</p>", "<article class='ad-free'>Text",
    ):
        assert found(body) == ["Text"], body
    for text in (  # names of headings, paragraphs and sections of an article are slugs of their text
        "<h2 id='search'>Text</h2>", "<h2 id='related-links'>Text</h2>", "<h3 id='comments'>Text</h3>", "<h2 id='notice'>Text</h2>", "<p class='share-text'>Text</p>", "<p class='alert'>Text</p>",
        "<section id='advertising'><h2>Text</h2></section>", "<h2 class='banner'>Text</h2>", "<ul><li class='share' id='ad'>Text</li></ul>", "<p role='alert'>Text</p>", "<pre class='ad'>Text</pre>",
    ):
        assert html_diff.lines(f"<article><p>Before{text}<p>After</article>") == [("Before", html_diff.MAIN), ("Text", html_diff.MAIN), ("After", html_diff.MAIN)], text
    for text in ("<div class='ad'>x</div>", "<section class='comments'><p>x</section>", "<ul class='social-share'><li>x</ul>", "<p hidden>x</p>", "<form>x</form>"):
        assert [k for t, k in html_diff.lines(f"<article><p>Before{text}<p>After</article>") if t == "x"] == [html_diff.FRAME], text
    assert html_diff.lines("<main><p>Text</p><div id='comments'>x</div></main>")[1] == ("x", html_diff.FRAME)
    for frame in ("<div class='ad'>x</div>", "<div id='related-posts'>x</div>", "<div class='siteNav'>x</div>", "<form>x</form>", "<div role=navigation>x</div>", "<div id=comments><p>" + "x" * 999 + "</div>", "<div hidden>x</div>", "<footer>x</footer>", "<div class='left sidebar-12'>x</div>"):
        assert found(f"<article>Text</article>{frame}") == ["Text"] and found(f"<div>Text of the page</div>{frame}") == ["Text of the page"], frame
    teasers = "<article>one</article><article>two</article><div>The text that the page is about</div>"
    assert found(teasers)[-1] == "The text that the page is about" and all(k == html_diff.OPEN for _, k in html_diff.lines(teasers))


def test_two_pages_with_a_long_banner(spark):
    banner = "<div>" + "A very long banner of the site. " * 40 + "</div>"
    assert told_apart(spark, [f"{banner}<div>Short one</div>", f"{banner}<div>Short two</div>"]) == ["Short one", "Short two"]


def test_header_without_other_pages(spark):
    assert told_apart(spark, ["<header>Site of mine</header><div>Text</div>"]) == ["Text"]


def test_votes_against_brute_force(spark):
    """Lines of one order, so that a longest common subsequence is what two pages share."""
    rng, n = random.Random(8), 150
    site = [f"site line {i:02}" for i in range(6)]
    pages = []
    for i in range(n):
        own = [f"{i:03} own line {k}" for k in range(rng.randint(1, 4))] if i % 10 else [f"copied {k}" for k in range(5)] + [f"{i:03} last"]
        pages.append([x for x in site if rng.random() < 0.8] + own)
    pages[-1] = pages[-2]  # equal pages
    told = told_apart(spark, ["".join(f"<div>{x}</div>" for x in p) for p in pages])
    distinct = [p for i, p in enumerate(pages) if p not in pages[:i]]  # in the order of their paths
    last = max(len(distinct) // html_diff.BLOCK - 1, 0)
    block = lambda r: min(r // html_diff.BLOCK, last)
    part = lambda p, q: sum(len(x) for x in p if x in q) / sum(map(len, p))

    def two(ranks):
        least = min(range(len(ranks)), key=lambda i: (part(distinct[ranks[0]], distinct[ranks[i]]) if i else 2.0, i))
        return sorted({ranks[0], ranks[least]})

    marks = two(sorted(x for b in range(last + 1) for x in two([r for r in range(len(distinct)) if block(r) == b])))
    for page, text in zip(pages, told, strict=True):
        r = distinct.index(page)
        b = block(r)
        seen = {x for x in range(len(distinct)) if block(x) == b or b * html_diff.BLOCK - html_diff.VOTES <= x < b * html_diff.BLOCK or block(x) == b + 1 and x - (b + 1) * html_diff.BLOCK < html_diff.VOTES} | set(marks)
        parts_ = {x: part(page, distinct[x]) for x in seen - {r}}
        voters = sorted((x for x, v in parts_.items() if v <= (1 + min((v for v in parts_.values() if v), default=0)) / 2), key=lambda x: (abs(x - r), x))[: html_diff.VOTES]
        kept = [x for x in page if 2 * sum(x in distinct[v] for v in voters) <= len(voters)] or page
        assert text == "\n".join(kept)


def article(i: int, *more: str) -> str:
    table = f"<table><tr><td>Weight<td>{i} kg</table><ul><li>Share it<li>Print it</ul>"
    return f"<article><h1>Title {i}</h1><div class='cmp-tos'>Follow us everywhere</div><p>Own text of {i}</p>{''.join(more)}<h2>Summary</h2><p>In short: {i}</p>{table}<div class='outbrain'><h3>From the web</h3><p>Ten tricks</p></div></article>"


def article_lines(i: int, *more: str) -> list[str]:
    return [f"Title {i}", f"Own text of {i}", *more, "Summary", f"In short: {i}", "Weight", f"{i} kg"]


@pytest.mark.parametrize("most", [50_000, 0])
def test_articles_are_differenced(spark, monkeypatch, most):
    """Site text inside articles goes by differencing; quotations, headings and labels of tables stay."""
    monkeypatch.setattr(html_diff, "BROADCAST_ROWS", most, raising=False)
    quote = [("<p>A licence that some share</p>",) if i % 3 == 0 else () for i in range(70)]
    told = told_apart(spark, [article(i, *quote[i]) for i in range(70)] + ["", ""])
    assert [t.split("\n") for t in told[:70]] == [article_lines(i, *(["A licence that some share"] if quote[i] else [])) for i in range(70)] and told[70:] == ["", ""]


def test_few_articles_keep_all_lines(spark):
    site = ["Follow us everywhere", "Share it", "Print it", "From the web", "Ten tricks"]
    for told in told_apart(spark, [article(i) for i in range(4)]):
        assert set(site) < set(told.split("\n"))


def test_lines_of_a_run_of_articles_stay(spark):
    told = told_apart(spark, [f"<article><div class='cmp-tos'>Follow us everywhere</div><p>Text {i} of its own</p>{'<p>Run</p>' * (12 <= i < 33)}</article>" for i in range(40)])
    assert told == [f"Text {i} of its own" + "\nRun" * (12 <= i < 33) for i in range(40)]


def test_copies_of_an_article_have_one_vote(spark):
    copied = "".join(f"<p>Sentence {i} of an article with copies</p>" for i in range(20))
    bodies = [f"<article><p>Quoted line</p>{copied}<p>Seen {i} times</p></article>" for i in range(12)] + [f"<article><p>Text {i} of its own</p>{'<p>Quoted line</p>' * (i == 0)}</article>" for i in range(7)]
    told = told_apart(spark, bodies)
    assert told[12] == "Text 0 of its own\nQuoted line" and all(t.startswith("Quoted line\nSentence 0 of") and t.count("\n") == 21 for t in told[:12])


def test_equal_pages_keep_their_text(spark):
    assert told_apart(spark, ["<div>Menu</div><div>The only text</div>"] * 20) == ["Menu\nThe only text"] * 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_ids_of_whole_documents():
    """The word-wise path against the tokenizer, over whole texts of four languages."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    told, own = Tokenizer.from_file(packing.default_path()), packing.tokenizer(packing.default_path())
    texts = [t or "" for t in pq.read_table(f"{SF.replace('0.001', '0.1')}/documents.parquet", columns=["text"])["text"].to_pylist()]
    for text, ids in zip(texts, told.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own(text) == struct.pack(f"<{len(ids.ids)}I", *ids.ids), text[:200]


def test_packing_adds_two_columns(spark):
    cut = written(packing.pieces(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")), "t")
    assert packing.pack(cut).columns == [*cut.columns, "sequence_id", "offset"]


def test_scratch_tables_go(spark):
    from lectern.llm.common import scratch

    kept = new_path(spark, "kept")
    with scratch(spark):
        inner = written(spark.range(5), "inner")
        path = inner.inputFiles()[0].rsplit("/", 1)[0].replace("file:", "").replace("///", "/")
        inner.write.parquet(kept)
        assert os.path.isdir(path)
    assert not os.path.exists(path) and spark.read.parquet(kept).count() == 5


def test_packing_of_one_row_many_times(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same words in each row").alias("text"))
    cut = written(packing.pieces(docs), "same-pieces")
    found = packing.pack(cut).collect()
    size = found[0]["length"]
    places = {(r["sequence_id"], r["offset"]) for r in found}
    assert len(found) == len(places) == 3000 and {r["length"] for r in found} == {size}
    per = packing.CAPACITY // size
    assert len({s for s, _ in places}) == -(-3000 // per) and all(o % size == 0 for _, o in places)
