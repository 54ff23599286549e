"""From raw documents to packed training sequences, in stages that each read what the one before wrote.

A stage takes (spark, docs, sf_dir), with docs as the columns of documents, and returns a DataFrame; all but the
last return the columns of documents. run() applies them to the table documents.

Defined cases: those of the operators that the stages call; a document whose quality is scored 0.5 or more stays,
so with labels of one class or none all stay or go together; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import mixing, ngram_join, packing, pii, quality
from lectern.llm.common import delete, new_path, scratch, written
from lectern.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorisation machine rejects."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.may_learn())
    return quality.scored(docs, machine).where("_score >= 0.5").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    ship(spark)
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With pseudonyms for personal data; n_chars follows the text."""
    ship(spark)
    docs = pii.pseudonymised(docs.select(*COLUMNS), pii.session_key(spark))
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each source draws: a row for each epoch, the last document of a source cut to its budget."""
    ship(spark)
    levels = {"mix_domain": mixing.domain(F.col("source")), "mix_lang": F.col("lang"), "mix_source": F.col("source")}
    drawn = mixing.mix(docs.select(*COLUMNS), levels, mixing.WEIGHTS, mixing.budget(), carry=COLUMNS)
    text = F.when(F.col("take_tokens") < F.col("n_tokens"), mixing.prefix(F.col("text"), F.col("take_tokens"))).otherwise(F.col("text"))
    return drawn.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in the sequences."""
    ship(spark)
    return packing.pack(written(packing.pieces(docs), "pack-pieces"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", pii_pseudonyms),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the trained classifier, the keyed pseudonyms and the packing; tests hold the stages against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage writes for itself goes when its result is written, and that when the next one is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage-{i}")
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
