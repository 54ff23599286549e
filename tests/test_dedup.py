"""Greedy deduplication at sizes that its parts are for: chains, copies, frequent terms, large groups of vectors."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import registry
from lectern.operators import dedup
from lectern.operators.components import components


def scanned(items, pairs):
    """By definition: each item in order joins its first similar leader."""
    out = {}
    for g, i in sorted(items):
        first = [a for a in sorted(a for h, a, b in pairs if h == g and b == i) if out[g, a] == a]
        out[g, i] = first[0] if first else i
    return out


def graph(seed, groups=3, n=60, edges=150):
    rng = random.Random(seed)
    items = [(g, i) for g in range(groups) for i in range(n)]
    pairs = {(g, *sorted(rng.sample(range(n), 2))) for g in range(groups) for _ in range(edges)}
    pairs |= {(9, i, i + 1) for i in range(n - 1)}  # a chain
    return items + [(9, i) for i in range(n)], sorted(pairs)


@pytest.mark.parametrize("fold", [dedup.FOLD, 70, 5])  # by group, by component, in rounds
def test_scan(spark, fold):
    items, pairs = graph(1)
    found = dedup.clusters(spark.createDataFrame(items, "group int, id long"), spark.createDataFrame(pairs, "group int, i long, j long"), fold).collect()
    assert {(r["group"], r["id"]): r["leader"] for r in found} == scanned(items, pairs)


def test_chain_of_a_thousand(spark):
    n = 1000
    items = spark.range(n).select(F.lit("g").alias("group"), "id")
    pairs = spark.range(n - 1).select(F.lit("g").alias("group"), F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    began = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    leaders = dedup.clusters(items, pairs).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(began)
    assert {r["leader"] for r in leaders} == set(range(0, n, 2)) and jobs < 15  # of 500 rounds before


def test_components(spark):
    chain = [("a", i, i + 1) for i in range(200)] + [("b", 5, 3), ("b", 7, 7), ("b", 9, 3)]
    random.Random(2).shuffle(chain)
    found = {(r["group"], r["node"]): r["part"] for r in components(spark.createDataFrame(chain, "group string, i long, j long")).collect()}
    assert found == {("a", i): 0 for i in range(201)} | {("b", i): 3 for i in (3, 5, 9)}
    assert components(spark.createDataFrame([], "group string, i long, j long")).count() == 0


def test_copies_stay_linear(spark):
    n = 10_000
    items = spark.range(n).select(F.lit(1).alias("group"), "id", F.when(F.col("id") % 1000 == 999, "other words here").when(F.col("id") % 2 == 0, "Kinetic  energy of it").otherwise("kinetic energy OF it!").alias("text"))
    items = items.unionByName(spark.createDataFrame([(1, n, "-"), (1, n + 1, "-")], items.schema))
    classes = dedup.text_classes(items)
    assert dedup.class_pairs(classes, 0.1).count() == 0 and classes.select("rep").distinct().count() == 4
    began = time.time()
    kept = dedup.concepts(items).orderBy("id").collect()
    assert [(r["id"], r["text"]) for r in kept] == [(0, "Kinetic  energy of it"), (999, "other words here"), (n, "-"), (n + 1, "-")]
    assert time.time() - began < 60


def test_copies_like_items(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(g, i, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for g in (1, 2) for i in range(80)]
    items = spark.createDataFrame(rows, "group int, id long, text string")
    for threshold in (0.3, 0.85):
        pairs = dedup.text_pairs(items, threshold)
        told = scanned([r[:2] for r in rows], [tuple(r)[:3] for r in pairs.collect()])
        classes = dedup.text_classes(items)
        reps = {(r["group"], r["id"]): r["leader"] for r in dedup.clusters(classes.where("id = rep"), dedup.class_pairs(classes, threshold)).collect()}
        assert {(r["group"], r["id"]): reps[r["group"], r["rep"]] for r in classes.collect()} == told
        some = dedup.class_pairs(classes, threshold, postings=3)  # frequent terms in blocks
        plain = lambda df: sorted((r["group"], r["i"], r["j"], round(r["sim"], 9)) for r in df.collect())
        assert plain(some) == plain(dedup.class_pairs(classes, threshold)) and len(plain(some)) == len(set(plain(some)))


def vectors(seed, n, dims=16, centres=40):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    rows = [(0, i, (middle[i % centres] + rng.normal(0, 0.15, dims)).tolist()) for i in range(n)]
    rows += [(1, n + i, rng.normal(size=dims).tolist()) for i in range(30)] + [(1, n + 40 + i, rng.normal(size=3).tolist()) for i in range(20)] + [(1, n + 99, [0.0] * dims)]
    return rows


def brute(rows, threshold):
    out = set()
    for g in {r[0] for r in rows}:
        for d in {len(r[2]) for r in rows}:
            own = [(i, np.array(v)) for h, i, v in rows if h == g and len(v) == d and any(v)]
            if own:
                m = np.array([v / np.linalg.norm(v) for _, v in own])
                a, b = np.nonzero(np.triu(m @ m.T >= threshold, 1))
                out |= {(g, *sorted((own[x][0], own[y][0]))) for x, y in zip(a, b, strict=True)}
    return out


def test_vectors_in_cells(spark):
    rows = vectors(4, 900)
    df = spark.createDataFrame(rows, "group int, id long, vector array<double>").repartition(5)
    shares = []
    for threshold in (0.0, 0.5, 0.9, 0.97):
        found = [(r["group"], r["i"], r["j"]) for r in dedup.vector_pairs(df, threshold, block=64).collect()]
        assert len(found) == len(set(found)) and set(found) == brute(rows, threshold), threshold
    for threshold in (0.5, 0.9, 0.97, 0.995):
        many = spark.createDataFrame(vectors(4, 6000), df.schema)
        r = dedup.compared(many, threshold).where("group = 0").first()
        shares.append(r["compared"] / r["pairs"])
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.2 < shares[0], shares


def test_cells_only_where_they_save_work(spark):
    rows = vectors(5, 6000)
    df = spark.createDataFrame(rows, "group int, id long, vector array<double>")
    held = len(rows) - 1  # without the zero vector
    assert dedup.cells(df, 0.3).count() == held  # 64 pivots made 32 guests of each vector, though all cells met
    assert dedup.cells(df, 0.995).count() > held


@pytest.mark.parametrize("block", [4, 300])
def test_few_large_blocks(spark, block):
    rows = vectors(6, 900)
    df = spark.createDataFrame(rows, "group int, id long, vector array<double>").withColumn("vector", F.col("vector").cast("array<float>"))
    blocks = {r["group"]: r["_blocks"] for r in dedup.cells(df, 0.3, block).where("size(vector) = 16").select("group", "_blocks").distinct().collect()}
    assert blocks == {4: {0: 8, 1: 3}, 300: {0: 3, 1: 1}}[block]
    found = [(r["group"], r["i"], r["j"]) for r in dedup.vector_pairs(df, 0.3, block=block).collect()]
    rows = [(r["group"], r["id"], r["vector"]) for r in df.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 0.3)
    again = df.where("id < 20").unionByName(df.where("id < 20"))
    assert not [r for r in dedup.vector_pairs(again, 0.3).collect() if r["i"] == r["j"]]  # a repeated id is no pair, as in SQL


def led(rows, threshold):
    """Leaders by definition, of vectors by id: a repeated id is one item."""
    pairs = {p for p in brute(rows, threshold) if p[1] < p[2]}
    return scanned({r[:2] for r in rows}, pairs)


@pytest.mark.parametrize(("head", "followers"), [(dedup.HEAD, dedup.FOLLOWERS), (120, 64)])
def test_leaders_without_pairs(spark, head, followers):
    rows = vectors(7, 500)
    schema = "group int, id long, vector array<double>"
    odd = [(None, 9000, rows[0][2]), (None, 9001, rows[0][2]), (3, 9002, [0.0, 0.0]), (3, 9003, None)]
    repeated = [(0, i, rows[i + 3][2]) for i in range(0, 300, 17)]
    for more, threshold in ((odd, 0.3), (odd + repeated, 0.9), (odd, 0.999)):
        df = spark.createDataFrame(rows + more, schema).repartition(3)
        found = dedup.vector_clusters(df, threshold, head, followers).distinct().collect()
        told = led(rows + [r for r in more if r not in odd], threshold) | {r[:2]: r[1] for r in odd}
        assert {(r["group"], r["id"]): r["leader"] for r in found} == told and len(found) == len(told)


def test_near_copies_are_no_pairs(spark, tmp_path):
    n = 12_000  # 72 million pairs, which were listed, checkpointed and folded
    near = F.array(*((F.lit(float(k + 1)) + 1e-3 * F.rand(k)).cast("float") for k in range(8)))
    spark.range(n).select(F.col("id").alias("vec_id"), near.alias("embedding"), F.lit(1).alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    began = time.time()
    assert [tuple(r) for r in registry.queries()["embedding_dedup"](spark, str(tmp_path)).collect()] == [(1, 0)]
    assert time.time() - began < 30
