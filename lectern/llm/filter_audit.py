"""How quality filters interact, for every order in which they can be applied, by a relational word pipeline.

1. Words are exploded from the texts and counted by (document, word), then by document: total and distinct words.
2. Capitals, special characters, copies and labels are flags of a document. They meet the word counts by outer
   joins, as a text without words has no row there.
3. The failed filters of a document are a number from 0 to 31. One aggregation counts the documents of each number in
   columns of their own, 32 a part, and as many for those of good quality and for toxic ones.
4. All orders and steps follow from these columns, without a look at the documents.

A document is a row. Rows with the same id, text and part are one row with a multiplicity, so that neither repeats
nor null ids need a number of their own; ids, hash of the text and of the part name it. Copies are found by
the SHA-256 of their texts. Texts with very many copies and ids with very many texts are looked up without gathering them.

Defined cases: a null text is empty; a null lang is the part "" together with the empty one; a repeated row counts each
time and is no copy of itself; a null id is smaller and larger than none, so its row is no copy and has none; several labels of
an id count as the largest; an id without label is neither good nor toxic; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, weighted_lookup, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SPECIAL = "[#$%&*|]"
#: What parts words; a word is a longest run of other characters.
BLANK = r"[\x20\x09-\x0D]+"
MASKS = 1 << len(FILTERS)


def _rows(docs: DataFrame) -> DataFrame:
    """k, h (together the name of a row), id, part and text."""
    text, part = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), part.alias("part"), text.alias("text"))
    return rows.select(F.coalesce("id", F.lit(0).cast("long")).alias("k"), F.xxhash64(F.col("id").isNull(), "part", "text").alias("h"), "*")


def word_counts(docs: DataFrame) -> DataFrame:
    """k, h, words and distinct_words of each row with a word; repeated rows are one."""
    texts = _rows(docs).groupBy("k", "h").agg(F.first("text").alias("text")).select("k", "h", F.split("text", BLANK).alias("ws"))
    words = texts.select("k", "h", F.explode("ws").alias("word")).where("word <> ''")
    counted = words.groupBy("k", "h", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("k", "h").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (bit i: filter i fails), good, toxic and n, the number of rows, for each distinct row."""
    rows = _rows(docs)
    capitals = F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * MOST_CAPITALS
    heads = rows.select("k", "h", "id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), capitals.alias("c"), F.col("text").rlike(SPECIAL).alias("d"))
    heads = written(heads.groupBy("k", "h", "id", "part", "sha", "c", "d").agg(F.count("*").alias("n")), "audit-rows")
    texts = written(heads.groupBy("sha").agg(F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1"), "audit-texts")
    copies = weighted_lookup(heads.where("id is not null").select("k", "h", "id", "sha"), texts, ["sha"], "copies").where("id > least")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    marks = written(marks.where("good or toxic"), "audit-labels")

    rows = heads.select("k", "h", "id", "part", "c", "d", "n").join(word_counts(docs), ["k", "h"], "left")
    rows = lookup(rows.join(copies.select("k", "h", F.lit(True).alias("e")), ["k", "h"], "left"), marks, ["k"], "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [words < LEAST_WORDS, distinct * 100 < words * LEAST_DISTINCT, F.col("c"), F.col("d"), F.coalesce("e", F.lit(False))]
    failed = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    named = F.col("id").isNotNull()
    return rows.select("part", failed.alias("failed"), (named & F.coalesce("good", F.lit(False))).alias("good"), (named & F.coalesce("toxic", F.lit(False))).alias("toxic"), "n")


def counted(flags: DataFrame) -> DataFrame:
    """A row a part with 32 counts of its rows by failed filters, all_0 to all_31, and good_ and toxic_ likewise."""

    def counts(name: str, of: Column) -> list[Column]:
        return [F.sum(F.when(of & (F.col("failed") == m), F.col("n")).otherwise(0)).alias(f"{name}_{m}") for m in range(MASKS)]

    return flags.groupBy("part").agg(*counts("all", F.lit(True)), *counts("good", F.col("good")), *counts("toxic", F.col("toxic")))


def audit(counts: DataFrame) -> DataFrame:
    """Each part, order of filters and step, from the counts."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = counts.select("part", *(F.array(*(F.col(f"{name}_{m}") for m in range(MASKS))).alias(name) for name in ("all", "good", "toxic")))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = F.expr(f"transform(sequence(1, {len(FILTERS)}), i -> shiftleft(1, ascii(substr(filter_order, i, 1)) - ascii('{FILTERS[0]}')))")
    rows = rows.withColumn("bits", bits)
    rows = rows.withColumns({"own": F.element_at("bits", F.col("step")), "before": F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b)})

    def total(of: str, where) -> Column:
        """Sum of the counts whose number m holds."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(where(m), F.element_at(of, m + 1)).otherwise(0))

    def has(m: Column, bits: str) -> Column:
        return m.bitwiseAND(F.col(bits)) != 0

    def removed(of: str) -> Column:
        return total(of, lambda m: has(m, "own") & ~has(m, "before"))

    # a filter removes what fails it in the share of the orders in which it comes first of the failed ones
    first = F.lit(len(orders))
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(has(m, "own"), F.element_at("all", m + 1) * F.floor(first / F.bit_count(m))).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        total("all", lambda m: ~has(m, "own") & ~has(m, "before")).alias("kept"),
        removed("all").alias("removed"),
        total("all", lambda m: has(m, "own") & has(m, "before")).alias("redundant"),
        total("all", lambda m: m == F.col("own")).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(counted(flagged(docs, labels)))


def sql(documents: str = "documents", labels: str = "labels") -> str:
    """DuckDB SQL for the rows of query(); it replays each order on the documents."""
    return f"""
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws
  from {documents}),
marks as (
  select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from {labels} where doc_id is not null group by 1),
least as (select text, min(doc_id) as least from docs group by 1),
fails as (
  select d.part, coalesce(m.good, false) as good, coalesce(m.toxic, false) as toxic,
         (case when len(ws) < {LEAST_WORDS} then 'A' else '' end)
         || (case when 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) then 'B' else '' end)
         || (case when 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(d.text) then 'C' else '' end)
         || (case when regexp_matches(d.text, '{SPECIAL}') then 'D' else '' end)
         || (case when d.doc_id > l.least then 'E' else '' end) as failed
  from docs d join least l on l.text = d.text left join marks m on m.doc_id = d.doc_id),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
groups as (select part, failed, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic from fails group by 1, 2),
steps as (select filter_order, s::int as step, filter_order[s] as own, filter_order[:s - 1] as before from orders, unnest(range(1, 6)) as t(s)),
met as (
  select g.part, s.filter_order, s.step, s.own, n, n_good, n_toxic, failed,
         contains(failed, own) as fails_own, failed <> '' and regexp_matches(failed, case when before = '' then 'X' else '[' || before || ']' end) as gone
  from groups g, steps s),
told as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter (not gone and not fails_own), 0)::bigint as kept,
         coalesce(sum(n) filter (not gone and fails_own), 0)::bigint as removed,
         coalesce(sum(n) filter (gone and fails_own), 0)::bigint as redundant,
         coalesce(sum(n) filter (failed = own), 0)::bigint as unique_fails,
         coalesce(sum(n_good) filter (not gone and fails_own), 0)::bigint as good_lost,
         coalesce(sum(n_toxic) filter (not gone and fails_own), 0)::bigint as toxic_lost
  from met group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from told"""
