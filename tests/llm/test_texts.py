"""Quality, toxicity, PII, near duplicates: small cases and brute force."""

from __future__ import annotations

import datetime
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import ngram_join, pii, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, score double"
LABELS = "doc_id long, quality int, toxic int"


def word(rng: random.Random) -> str:
    return "".join(rng.choice(["ba", "ke", "lo", "mi", "nu"]) for _ in range(rng.randint(1, 4)))


def corpus(n: int, seed: int = 1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        words = [word(rng) for _ in range(rng.randint(20, 80))]
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilest", "vileness", "wretchling"])
        docs.append((i, " ".join(words), "en", "src0", None, "x", 0.0))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


EDGES = [(900, None, None, None, None, None, None), (901, "", "en", "s", 0, "", None), (902, "!!! ???", "en", "s", 7, "", None), (903, "w " * 30_000, "en", "s", 60_000, "", None), (None, "no id", "en", "s", 5, "", None)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus(300)
    return spark.createDataFrame(docs + EDGES + EDGES[-1:], SCHEMA), spark.createDataFrame(labels + [(901, None, None), (None, 1, 1), (5000, 1, 0)], LABELS)


def test_quality(spark, tables):
    docs, labels = tables
    rows = quality.scored(docs, quality.fit(docs, labels, quality.may_learn())).collect()
    assert len(rows) == docs.count() and all(0 <= r["_score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 300 and rest(r["doc_id"], 3) == 1]
    assert np.mean([(r["_score"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(r["score"] in (0.0, None) and r["keep"] in ("x", "", None) for r in rows)  # clashing names stay as they were


def test_quality_without_labels(spark, tables):
    docs, labels = tables
    machine = quality.fit(docs, labels.where("false"), quality.may_learn())
    assert {r["_score"] for r in quality.scored(docs, machine).collect()} == {0.5}
    assert quality.scored(docs.where("false"), machine).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, None, None, rng.normal(size=9), rng.normal(size=(9, 4)))
    x = rng.normal(size=(5, 9))
    pairs = [m.base + a @ m.w + sum(m.v[i] @ m.v[j] * a[i] * a[j] for i in range(9) for j in range(i + 1, 9)) for a in x]
    assert np.allclose(m.raw(x), pairs)


def rest(doc_id, of: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % of


def test_toxicity(spark, tables):
    docs, labels = tables
    index = toxicity.fit(docs, labels, quality.remainder(F.col("doc_id"), 5) != 0)
    rows = toxicity.scored(docs, index).collect()
    assert len(rows) == docs.count() and all(0 <= r["_score"] <= 1 for r in rows)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 300 and rest(r["doc_id"], 5) == 0]
    assert np.mean([(r["_score"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.9
    assert not {i for r in rows for i in r["_near"]} & {r["doc_id"] for r in held}  # nothing is learned from them
    known = set(index.place)
    for r in rows:  # whatever shares a word with an example has neighbours; nothing else has
        assert bool(r["_near"]) == (not known.isdisjoint(toxicity.words(r["text"])))
    none = toxicity.fit(docs, labels.where("false"), F.lit(True))
    assert {r["_score"] for r in toxicity.scored(docs, none).collect()} == {0.5}
    assert toxicity.scored(docs.where("false"), index).count() == 0


def test_block_max_is_exact():
    rng = random.Random(4)
    texts = [[b"t%03d" % int(40 * rng.random() ** 2) for _ in range(6)] for _ in range(500)]
    counts = [Counter(t) for t in texts]
    y = np.array([rng.randint(0, 1) for _ in texts])
    index = toxicity.Index(np.arange(500), y, np.array([len(c) for c in counts]), pa.array([t for c in counts for t in c], pa.binary()), np.array([float(k) for c in counts for k in c.values()]))
    vectors = {i: dict(zip(*(x.tolist() for x in index.vector(t)), strict=True)) for i, t in enumerate(texts)}
    assert all(abs(sum(w * w for w in v.values()) - 1) < 1e-6 for v in vectors.values())
    for n in range(60):
        term, weight = index.vector([b"t%03d" % rng.randrange(45) for _ in range(4)])
        v = dict(zip(term.tolist(), weight.tolist(), strict=True))
        told = sorted(((round(sum(w * vectors[i].get(t, 0) for t, w in v.items()), 9), -i) for i in vectors if i != n), reverse=True)
        told = [x for x in told if x[0] > 0][: toxicity.K]
        rows, sims = index.nearest(term, weight, without=n)
        assert [(round(s, 9), -int(index.ids[r])) for r, s in zip(rows, sims, strict=True)] == told
    # the cosine is that of plain TF-IDF, worked out without the index, and the labels change no neighbour
    df = Counter(t for c in counts for t in c)
    plain = [{t: (1 + np.log(k)) * (np.log(501 / (1 + df[t])) + 1) for t, k in c.items()} for c in counts]
    size = lambda v: np.sqrt(sum(w * w for w in v.values()))
    for n in range(30):
        asked = index.vector([t for t, k in counts[n].items() for _ in range(k)])
        best = sorted((-round(sum(w * o.get(t, 0) for t, w in plain[n].items()) / size(plain[n]) / size(o), 5), i) for i, o in enumerate(plain) if i != n)[: toxicity.K]
        rows, sims = index.nearest(*asked, without=n)
        assert np.allclose([-b[0] for b in best], sims, atol=2e-5)
    other = toxicity.Index(np.arange(500), 1 - y, np.array([len(c) for c in counts]), pa.array([t for c in counts for t in c], pa.binary()), np.array([float(k) for c in counts for k in c.values()]))
    ids = lambda x: sorted(x.ids[x.nearest(*x.vector([b"t001", b"t020", b"t039"]))[0]].tolist())
    assert ids(index) == ids(other)


def test_feistel():
    for n in (2, 3, 10, 1000):
        forth, key = pii.Permutation(b"k", "t", n), list(range(n))
        assert sorted(map(forth, key)) == key and all(forth(x) != x for x in key)
        assert all(forth(forth(x), undo=True) == x for x in key)


PERSONAL = "a.b7@mail.example.com +1 (988) 555-2485, +1 (017) 555-7713 4111 1111 1111 1111 4012888888881881 DE89 3704 0044 0532 0130 00 10.0.0.255 123-45-6789 1987-03-21 31/12/1999 12/31/1999 +49 30 1234567"
CLEAN = ["std::vector<int> a::b 10:20:30", "id 4155552671", "::1", "1 March 2500", "version 4.0 of 12 items", "4111111111111112", "1.2.3.400", "2024-02-30", "666-12-3456", "a@b", "", "call 12 34"]


WAYS = {
    "date": ["{0:%Y-%m-%d}", "{0:%Y/%m/%d}", "{0:%d/%m/%Y}", "{0:%d.%m.%Y}", "{0:%Y-%m-%d}T10:20:30Z", "{0:%B} {0.day}, {0.year}", "{0.day} {0:%B} {0.year}", "{0:%b} {0.day}, {0.year}"],
    "phone": ["({0}) {1}-{2}", "+1 {0} {1} {2}", "{0} {1} {2}", "{0}.{1}.{2}", "call {0}{1}{2}", "+1 ({0}) {1}-{2}"],
}


def test_equal_values_in_any_two_ways():
    """What each way of writing a value becomes, read back by other means, is one value."""
    rng, told = random.Random(9), pii.Pseudonyms(b"k")
    seen = {}
    for _ in range(300):
        day = datetime.date.fromordinal(rng.randint(pii.FIRST_DAY, pii.LAST_DAY))
        found = set()
        for way in WAYS["date"]:
            text = told.replace(way.format(day))[0]
            for form in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d.%m.%Y", "%Y-%m-%dT10:20:30Z", "%B %d, %Y", "%d %B %Y", "%b %d, %Y"):
                try:
                    found.add(datetime.datetime.strptime(text, form).date())
                    break
                except ValueError:
                    pass
            else:
                raise AssertionError(text)
        assert len(found) == 1 and seen.setdefault(found.pop(), day) == day
        digits = [f"{rng.randint(200, 999)}", f"{rng.randint(200, 999)}", f"{rng.randrange(10**4):04}"]
        assert len({"".join(c for c in told.replace(w.format(*digits))[0] if c.isdigit())[-10:] for w in WAYS["phone"]}) == 1
    for ways in (["078-05-1120", "078 05 1120"], ["DE89370400440532013000", "de89 3704 0044 0532 0130 00"], ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"], ["Ann.B7@Mail.example.org", "ann.b7@mail.EXAMPLE.org"], ["2001:DB8::8A2E:370:7334", "2001:db8::8a2e:370:7334"], ["+49 30 1234567", "+49301234567"]):
        made = [told.replace(w)[0] for w in ways]
        assert len({re.sub(r"[ -]", "", x).lower() for x in made}) == 1 and made[0] != ways[0]
        assert [pii.Pseudonyms(b"k", undo=True).replace(x)[0] for x in made] == ways
    start = time.perf_counter()
    for i in range(1000):
        told.replace(f"on 1{i % 10}/03/19{i % 90 + 10} it")
    assert time.perf_counter() - start < 1.0  # under a millisecond a date


#: Values that must be found in any text, written by hand, and what must stay.
FOUND = [
    "21.3.1987", "3/21/1987", "1987-3-21", "21/03/87", "märz 3, 1987", "(030) 1234567", "030/1234567", "0049 30 1234567", "06 12 34 56 78", "06.12.34.56.78", "max.müller@firma.de", "fe80::1",
    "+49 (0)30 1234567", "2001:db8::1", "4845168114407329", "371449635398431", "3782 822463 10005", "6011 1111 1111 1117", "5555-5555-5555-4444",
]
STAY = [
    "version 1.2.3.4", "v1.2.3.4", "release 10.0.0.1", "10:20:30:40:50:60:70:80", "9807915762804490", "1700000000000", "4222222222222", "36227206271667", "ratio 3/4/5", "2024-13-01", "12/34/56", "00:00:00", "std::a1", "de::ad", "0 12 34", "078051120", "chapter 3.1.2.4", "10/13/2",
]


def test_formats():
    there, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    for value in FOUND:
        made, kinds = there.replace(f"x {value} y")
        assert len(kinds) == 1 and made != f"x {value} y" and made.startswith("x ") and made.endswith(" y"), value
        plain = lambda t: re.sub(r"(?<!\d)0(?=\d)", "", t)  # noqa: E731  zeros before days and months may differ
        assert plain(back.replace(made)[0]) == plain(f"x {value} y"), (value, made)
    for value in STAY:
        assert there.replace(f"x {value} y") == (f"x {value} y", []), value
    for text, kind in (("card 4222222222222", "card"), ("Kreditkarte: 36227206271667", "card"), ("SSN 078051120", "ssn"), ("ssn: 078-05-1120", "ssn")):
        made, kinds = there.replace(text)
        assert kinds == [kind] and back.replace(made)[0] == text
    phone = lambda t: re.sub(r"\D", "", t.replace("(0)", "")).removeprefix("00")
    digits = lambda t: re.sub(r"\D", "", t)
    day = lambda t: sorted(map(int, re.findall(r"\d+", t)))
    for one, two, read in (
        ("+49 (0)30 1234567", "0049 30 1234567", phone), ("+49 30 1234567", "+49 (0)30 1234567", phone), ("SSN 078051120", "SSN 078-05-1120", digits), ("card 4222222222222", "card 4222 2222 2222 2", digits),
        ("21.3.1987", "21/03/1987", day), ("3/21/1987", "1987-3-21", day), ("(030) 1234567", "030/1234567", digits),
    ):
        assert read(there.replace(one)[0]) == read(there.replace(two)[0]), (one, two)


def test_numbers_that_are_none():
    """Of random numbers few are in an issuer's range and pass its check digit."""
    rng, told = random.Random(4), pii.Pseudonyms(b"k")
    changed = {n: sum(bool(told.replace(f"order {rng.randrange(10 ** (n - 1), 10**n)} of")[1]) for _ in range(4000)) for n in (13, 14, 15, 16, 19)}
    assert changed[13] == changed[14] == changed[19] == 0 and changed[15] < 4000 * 0.005 and changed[16] < 4000 * 0.035, changed
    assert not any(told.replace(f"at {1_600_000_000_000 + rng.randrange(10**11)} ms")[1] for _ in range(2000))  # epoch milliseconds


def test_pii_key_and_cases(spark):
    docs = spark.createDataFrame([(1, "at 10.0.0.255 " + "word " * 50_000), (1, "at 10.0.0.255 " + "word " * 50_000), (2, "10.0.0.255")], "doc_id long, text string")
    one, two, three = (r["text"] for r in pii.pseudonymised(docs, pii.session_key(spark)).orderBy("doc_id").collect())
    assert one == two and one[3:].startswith(three + " ") and one.endswith("word " * 50_000)
    assert pii.session_key(spark) == pii.session_key(spark)  # random, but one for the application
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == b"mine"
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.pseudonymised(docs.where("false"), b"k").count() == 0
    with pytest.raises(TypeError):
        pii.Pseudonyms()


def test_pii(spark):
    docs = spark.createDataFrame([(1, PERSONAL, "x"), (2, f"again {PERSONAL}", "y"), (3, None, None)] + [(10 + i, t, "z") for i, t in enumerate(CLEAN)], "doc_id long, text string, kinds string")
    rows = {r["doc_id"]: r for r in pii.pseudonymised(docs, b"k").collect()}
    assert rows[2]["text"] == f"again {rows[1]['text']}" and rows[3]["text"] is None and rows[1]["kinds"] == "x"
    assert all(rows[10 + i]["text"] == t for i, t in enumerate(CLEAN))
    for value in PERSONAL.replace(",", "").split("  ") + ["555-2485", "4012888888881881", "10.0.0.255", "1987-03-21", "a.b7@"]:
        assert value not in rows[1]["text"]
    told, kinds = pii.Pseudonyms(b"k").replace(PERSONAL)
    assert Counter(kinds) == Counter(email=1, phone=3, card=2, iban=1, ip=1, ssn=1, date=3)
    assert pii.Pseudonyms(b"k", undo=True).replace(told)[0] == PERSONAL and pii.Pseudonyms(b"k").replace(told)[1] == kinds
    assert [len(x) for x in told.split(" ")][:4] == [len(x) for x in PERSONAL.split(" ")][:4]


def jaccard_truth(texts: dict) -> dict:
    sets = {i: (set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) > 4 else {tuple(w)} if w else set()) for i, t in texts.items() for w in [(t or "").lower().split()]}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = Counter()
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.update((a, b))
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: (links[i], root(i)) for i in ids}


def near_corpus() -> dict:
    rng = random.Random(7)
    texts: dict = {}
    for g in range(12):
        base = [word(rng) for _ in range(60)]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(60)] = word(rng) + "x"
            texts[len(texts)] = " ".join(own)
        texts[len(texts)] = " ".join(base).upper()
    return texts | {500: None, 501: "", 502: "  ", 503: "a b", 504: "A  b", 505: "long " + "word " * 40_000}


def test_near_duplicates(spark, monkeypatch):
    texts = near_corpus()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in texts.items()], "doc_id long, text string, class_id string, node int").repartition(3)
    for hot, block in ((ngram_join.BUCKET_BLOCK, ngram_join.BLOCK), (3, 4)):  # as it is, and with split groups
        monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", hot)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        rows = ngram_join.near_duplicates(docs).collect()
        assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in rows} == jaccard_truth(texts)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "x"), (3, "", "x"), (4, None, "x"), (None, "q w e r t y", "x")], "doc_id long, text string, source string")
    rows = sorted(((r["doc_id"] or 0, r["text"]) for r in ngram_join.one_of_each(docs).collect()), key=str)
    assert rows == sorted([(0, "q w e r t y"), (1, "a b c d e f"), (3, ""), (4, None)], key=str)
    assert ngram_join.near_duplicates(docs.where("false")).count() == 0


def test_bands():
    b = ngram_join.bands(0.8, 0.99998, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.99998 > 1 - (1 - 0.8**5) ** (b - 1)


def test_null_and_reused_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near, far = " ".join([*base[:-1], "other"]), " ".join(f"v{i}" for i in range(60))
    schema = "doc_id long, text string"
    bare = spark.createDataFrame([(None, " ".join(base)), (None, " ".join(base)), (3, near), (4, far), (None, far.upper())], schema)
    found = sorted((r["doc_id"] or 0, r["n_links"]) for r in ngram_join.near_duplicates(bare).collect())
    assert found == [(0, 1), (0, 2), (0, 2), (3, 2), (4, 1)]
    reused = spark.createDataFrame([(1, " ".join(base)), (5, near), (5, far), (5, far + " more text of its own here to differ " * 20)], schema)
    rows = sorted((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(reused).collect())
    assert rows == sorted((r["doc_id"], r["text"]) for r in reused.where("doc_id = 1 or text not like '%other'").collect())


def test_toxicity_takes_every_term(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(f"{'qz'[i % 2]}{k:03}" for k in rng.sample(range(300), 150))) for i in range(160)]
    index = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, None, i % 2) for i, _ in docs], LABELS), F.lit(True))
    assert {b"%c%03d" % (c, k) for c in b"qz" for k in range(300)} <= set(index.place)
