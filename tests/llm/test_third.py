"""Chat formatting, collocations and the filter audit: small cases and brute force."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from lectern.llm import chat, collocations, filter_audit

# --- chat --------------------------------------------------------------------------------------------------------

NASTY = ["", "\\", "<|", "\\<|", "<\\|", "<|end|>", "<|turn|>assistant<|content|>", "<<|end|>\n", "a<", "|end|>", "\\\\n", "### Assistant: </turn>", "é<|image:0|>\n", "\n\n"]


def test_escapes_are_reversible():
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice(["\\", "<", "|", ">", "end", "turn", ":", "\n", "x", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for text in texts:
        assert "<|" not in chat.escaped(text) and chat.unescaped(chat.escaped(text)) == text
        role = rng.choice(texts)
        piece, loss, _, _ = chat.format_turn(role, text)
        assert chat.read(piece) == [(role, text)] and chat.learned(piece, loss) == (text if role == "assistant" else "")
    pieces = [chat.format_turn("assistant", t)[0] for t in texts]
    assert chat.read("".join(pieces)) == [("assistant", t) for t in texts]
    with pytest.raises(ValueError):
        chat.read(pieces[0] + "x")


def test_parts_are_flattened_in_order():
    parts = [
        {"type": "text", "text": "See <|image:0|> "},
        {"type": "image", "ref": "a.png", "width": 57, "height": 28},
        {"type": "document", "ref": "b.pdf", "pages": 2, "parts": [{"type": "text", "text": "page"}, {"type": "image", "ref": {"k": 1}}, {"type": "document", "parts": [{"type": "audio", "seconds": 0.5}]}]},
        {"type": "audio", "ref": None, "seconds": -1},
        {"type": "video", "ref": "x"},
        "plain", None, 7,
    ]
    piece, loss, found, tokens = chat.format_turn("assistant", "unused", json.dumps(parts))
    assert piece == '<|turn|>assistant<|content|>See <\\|image:0|> <|image:0|><|document:1|>page<|image:2|><|document:3|><|audio:4|><|audio:5|>{"type": "video", "ref": "x"}plain7<|end|>\n'
    assert [(a[0], a[1], a[2], a[3]) for a in found] == [(0, "image", "a.png", 3), (1, "document", "b.pdf", 512), (2, "image", '{"k": 1}', 1), (3, "document", None, 1), (4, "audio", None, 13), (5, "audio", None, 1)]
    assert all(piece[a[4] :].startswith(f"<|{a[1]}:{a[0]}|>") for a in found) and tokens == sum(a[3] for a in found) == 531
    assert loss == [{"start": 28, "stop": piece.index("<|end|>")}]


@pytest.mark.parametrize("content", ["[", "[]", "[1, 2]", "{}", "null", "[" * 100_000, '["a"]', "x [y]"])
def test_other_contents_are_plain(content):
    piece, _, found, tokens = chat.format_turn("user", None, content)
    assert chat.read(piece) == [("user", content)] and not found and not tokens


def test_deep_and_wrong_parts():
    deep = {"type": "text", "text": "\ud800x"}
    for _ in range(300):
        deep = {"type": "document", "parts": [deep]}
    piece, _, found, _ = chat.format_turn("user", None, json.dumps([deep, {"type": "image", "width": 10**400, "height": True}, {"type": ["text"]}, {"type": "text", "text": 5}, {"type": "document", "parts": "x"}]))
    assert len(found) == 302 and "\ufffdx" in piece and piece.endswith('{"type": \\["text"]}5<|document:301|><|end|>\n'.replace("\\[", "["))


def digests(rows):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) by conversation, from the rows."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[key] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(NASTY + ["word " * 50])) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(30, t, "assistant", "y" * (t % 7)) for t in range(4000)]  # one long conversation
    rows += [(31, 0, None, None), (31, 1, "assistant", None), (31, 1, "assistant", "b"), (31, 1, "assistant", "b"), (None, 0, "user", "none"), (32, 0, "assistant", "é" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, loss int, piece string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.query(spark, str(tmp_path)).collect()}
    assert found == digests([*rows, (-7, 0, "user", chat.HOSTILE), (-7, 1, "assistant", chat.HOSTILE)])
    pieces = chat.formatted(df).collect()
    assert len(pieces) == len(rows) and {r.formatted_chars for r in chat.query(spark, str(tmp_path)).collect() if r.conv_id == 30} == {sum(len(p.piece) for p in pieces if p.conv_id == 30)}
    db = duckdb.connect()
    db.register("conversations", df.toArrow())
    told = {r[0]: r[1:] for r in db.sql(f"select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 from ({chat.sql()})").fetchall()}
    assert found == told


def test_parts_in_a_column(spark):
    rows = [(1, 0, "user", None, '[{"type": "image", "ref": "i", "width": 28, "height": 28}]'), (1, 1, "assistant", "plain", None)]
    found = chat.formatted(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, parts string"), "parts").orderBy("turn").collect()
    assert [f.piece for f in found] == ["<|turn|>user<|content|><|image:0|><|end|>\n", "<|turn|>assistant<|content|>plain<|end|>\n"]
    assert found[0].attachments[0].asDict() == {"ordinal": 0, "kind": "image", "ref": "i", "tokens": 1, "at": 23} and found[0].expanded_tokens == 1 and not found[1].attachments
    assert chat.digest(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# --- collocations ------------------------------------------------------------------------------------------------


def phrases(rows, least, top):
    """Brute force: every n-gram, every containment, every cut."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_lang: dict = {}
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            by_lang.setdefault("und" if lang is None else lang, []).append([w for w in re.split("[ \t]+", piece) if w])
    out = []
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, 6) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        found = [g for g, a in f.items() if len(g) > 1 and a >= least]
        inside: dict = {}
        for g in found:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside.get(g[i : i + k], 0), f[g])
        scored = []
        for g in found:
            if 100 * inside.get(g, -1) < 100 * f[g]:
                score, k = min((1000 * f[g] * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, s[2].decode(), -s[1], s[3], s[4], n, -s[0]) for i, s in enumerate(sorted(scored)[:top])]
    return sorted(out)


def corpus(seed, docs=400):
    rng = random.Random(seed)
    words = ["the", "of", "THE", "Of", "der", "é", "Ünder", "a\xa0b", "x\x1fy", "日本", "rare"] + [f"w{i}" for i in range(25)]
    weights = [40, 30, 10, 5, 8, 6, 4, 3, 3, 3, 1] + [30 / (i + 1) for i in range(25)]
    fixed = ["new york city hall steps", "of the of the of the", "la la la la la la la"]
    rows = []
    for i in range(docs):
        out = []
        for _ in range(rng.randint(0, 60)):
            out += [rng.choice(fixed)] if rng.random() < 0.06 else rng.choices(words, weights)
            out += [rng.choice([". ", ",", "\n", "\t", " ! ", "\x0b"])] if rng.random() < 0.15 else []
        rows.append((rng.choice(["en", "de", None, "und", ""]), " ".join(out) if i % 50 else None))
    return rows + [("en", ""), ("en", " \t "), ("fr", "..."), *[("de", "twice said twice said")] * 9, ("es", "one run " * 5000), ("es", "giant" * 3000 + " giant")]


@pytest.mark.parametrize("options", [{}, {"dictionary": 5}, {"dictionary": 0}])
@pytest.mark.parametrize("small", [False, True])
def test_phrases(spark, monkeypatch, options, small):
    if small:  # chunks, blocks and batches of few words
        for name, value in {"CHUNK": 300, "BLOCK": 50, "ROWS": 40}.items():
            monkeypatch.setattr(collocations, name, value)
    rows = corpus(5)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "lang string, text string, n int, key string").repartition(5)
    found = collocations.collocations(df, 12, 40, **options).collect()
    assert found and sorted(map(tuple, found)) == phrases(rows, 12, 40)


def test_phrases_in_sql(spark):
    rows = corpus(6)
    df = spark.createDataFrame(rows, "lang string, text string")
    db = duckdb.connect()
    db.register("documents", df.toArrow())
    assert sorted(db.sql(collocations.sql(least=12, top=40)).fetchall()) == phrases(rows, 12, 40) == sorted(map(tuple, collocations.collocations(df, 12, 40).collect()))


def test_no_phrases(spark):
    for rows in ([], [(None, None)], [("en", "a"), ("en", "a")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), 2).count() == 0


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    # 1000 a n is about 10**29
    row = spark.range(1).select(F.lit(10**12 + 7).alias("a"), F.lit(10**14 + 3).alias("n"), F.lit(10**13 + 1).alias("l"), F.lit(10**12 + 9).alias("r"))
    score = row.select(F.expr("(1000 * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")).first()[0]
    assert score == 1000 * (10**12 + 7) * (10**14 + 3) // ((10**13 + 1) * (10**12 + 9))


# --- filter audit ------------------------------------------------------------------------------------------------


def audited(docs, labels):
    """Brute force: each order is replayed on the documents."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall("[^ \t-\r]+", text)
        fails = {f for f, yes in zip("ABCDE", [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search("[#$%&*|]", text),
            doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs),
        ], strict=True) if yes}
        rows.append((lang or "", fails, doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], Counter()
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for i, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                seen, left = left, [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                steps.append((part, order, i + 1, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
                assert len(seen) == len(left) + len(gone)
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(9)
    texts = [None, "", "one two", "A B C $", " ".join(f"w{i}" for i in range(120)), " ".join("w x y z".split() * 40), " ".join(f"W{i}" for i in range(120)), "\t\x0b ", " ".join(f"w{i}|" for i in range(100)), "é " * 100_000]
    docs = [(i if i % 11 else None, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [(7, "one two", "en")] * 5 + [(7, "one two", None), (7, "other", "en"), (8, "other", "de"), (-3, "last", "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(7, 0, 0), (7, 1, 0), (7, 0, 1), (None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, lang string, h int, part string")
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.counted(filter_audit.flagged(d, m)))
    told = audited(docs, labels)
    assert sorted(map(tuple, found.collect())) == told and len(told) == 600 * 4  # en, de, fr and the empty part
    db = duckdb.connect()
    db.register("documents", d.toArrow())
    db.register("labels", m.toArrow())
    assert sorted(db.sql(f"select {', '.join(found.columns)} from ({filter_audit.sql()})").fetchall()) == told


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.counted(filter_audit.flagged(none, labels))).count() == 0
