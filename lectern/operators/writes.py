"""Writes: results, cards, sessions and reviews, each as the rewrite of the touched part of a table.

A table is a folder. Its rows lie in BUCKETS buckets by the hash of one column, each bucket a folder of Parquet
files, and one small file names the folders that are the table now. A write puts the buckets that it touches into
new folders and then replaces that file in one atomic step: a reader sees the old or the new contents, a write that
dies leaves the old ones, and a repeated write changes nothing. One writer at a time. A write deletes nothing, so
DataFrames made before it stay good; vacuum() deletes what no reader can be at any more.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, CURRENT = 64, "_current.json"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _current(spark: SparkSession, path: str) -> dict:
    """The column that deals the rows, and the folder of each bucket that has any."""
    fs, p = _at(spark, f"{path}/{CURRENT}")
    if not fs.exists(p):
        return {"by": None, "folders": {}}
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, current: dict) -> None:
    jvm = spark._jvm
    fs, new = _at(spark, f"{path}/{CURRENT}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    try:
        stream.write(json.dumps(current, sort_keys=True).encode())
    finally:
        stream.close()
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    options[0] = next(x for x in kind.getEnumConstants() if x.toString() == "OVERWRITE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{path}/{CURRENT}"), options)


def table(spark: SparkSession, path: str, like: DataFrame, buckets: list[str] | None = None) -> DataFrame:
    """The table at the path, or some buckets of it; an empty one of the same columns where there is none."""
    folders = _current(spark, path)["folders"]
    wanted = sorted(f"{path}/{f}" for b, f in folders.items() if buckets is None or b in buckets)
    return spark.read.schema(like.schema).parquet(*wanted) if wanted else spark.createDataFrame([], like.schema)


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("string")


def _touched(rows: DataFrame, by: str) -> list[str]:
    return [r[0] for r in rows.select(_bucket(by)).distinct().collect()]  # at most BUCKETS


def _replace(path: str, by: str, buckets: list[str], rows: DataFrame) -> None:
    """rows as the contents of the given buckets; the other buckets stay where they are."""
    spark, version = rows.sparkSession, uuid.uuid4().hex
    current = _current(spark, path)
    if current["by"] not in (None, by):
        raise ValueError(f"the table is dealt by {current['by']}, not by {by}")
    rows.withColumn("_b", _bucket(by)).write.partitionBy("_b").parquet(f"{path}/{version}")
    fs, made = _at(spark, f"{path}/{version}")
    there = {s.getPath().getName().removeprefix("_b=") for s in fs.listStatus(made) if s.isDirectory()}
    folders = {b: f for b, f in current["folders"].items() if b not in buckets} | {b: f"{version}/_b={b}" for b in there}
    _publish(spark, path, {"by": by, "folders": folders})


def vacuum(spark: SparkSession, path: str, keep_seconds: float = 24 * 3600) -> int:
    """Deletes the folders that the table doesn't name and that are older than any reader; how many those were."""
    fs, p = _at(spark, path)
    named, before, gone = set(_current(spark, path)["folders"].values()), (time.time() - keep_seconds) * 1000, 0
    for version in fs.listStatus(p):
        buckets = fs.listStatus(version.getPath()) if version.isDirectory() else []
        old = [b for b in buckets if b.isDirectory() and b.getModificationTime() <= before and f"{version.getPath().getName()}/{b.getPath().getName()}" not in named]
        gone += sum(bool(fs.delete(b.getPath(), True)) for b in old)
    return gone


def upserted(old: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """old with the change's rows in place of those with their keys."""
    return old.join(change.select(*keys).distinct(), keys, "left_anti").select(*change.columns).unionByName(change)


def upsert(change: DataFrame, path: str, keys: list[str]) -> None:
    """The table with the change's rows in place of those with their keys; only buckets of keys[0] are rewritten."""
    buckets = _touched(change, keys[0])
    _replace(path, keys[0], buckets, upserted(table(change.sparkSession, path, change, buckets), change, keys))


def replace_children(children: DataFrame, path: str, parent: str = "media_id") -> None:
    """All rows of the change's parents anew."""
    upsert(children, path, [parent])


def card_rows(cards: DataFrame) -> DataFrame:
    """media_id and an array of cards as rows; cards without a question go, the others keep their index."""
    rows = cards.select("media_id", F.posexplode("cards").alias("card_index", "c"))
    question = F.trim(F.coalesce("c.question", F.lit("")))
    return rows.where(question != "").select("media_id", "card_index", question.alias("question"), F.coalesce("c.answer", F.lit("")).alias("answer"), F.coalesce("c.topic", F.lit("")).alias("topic"), F.coalesce("c.difficulty", F.lit("medium")).alias("difficulty"))


def scored_sessions(attempts: DataFrame) -> DataFrame:
    """Quiz attempts with their accuracy, 0 for no questions."""
    return attempts.withColumn("accuracy_score", F.when(F.col("total_questions") > 0, F.col("correct_answers") / F.col("total_questions") * 100).otherwise(F.lit(0.0)))


def append(rows: DataFrame, path: str) -> None:
    """Rows of events, which are never rewritten, as further files."""
    rows.write.mode("append").parquet(path)


def checked_reviews(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews with a confidence from 1 to 5, and those that are refused."""
    good = F.coalesce(F.col("confidence").between(1, 5), F.lit(False))
    return reviews.where(good), reviews.where(~good)


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """rows but those of the media in gone (id)."""
    return rows.join(gone.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(*rows.columns)


def delete(spark: SparkSession, paths: dict[str, str], gone: DataFrame) -> None:
    """The children of the media in gone (id) from each table; paths: path by the name of its media column."""
    for path, column in paths.items():
        if folders := _current(spark, path)["folders"]:
            like = spark.read.parquet(f"{path}/{next(iter(folders.values()))}")
            buckets = _touched(gone.select(F.col("id").cast(like.schema[column].dataType).alias(column)), column)
            _replace(path, column, buckets, without(table(spark, path, like, buckets), gone, column))


def without_user(rows: DataFrame, user_id: int) -> DataFrame:
    """All but a user's rows."""
    return rows.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))


def notes(summary: DataFrame) -> DataFrame:
    """media_id and Markdown notes from a summary: the fallback when no model wrote any (S14). Empty sections are left out."""
    listed = lambda c: F.concat_ws("\n", F.transform(c, lambda x: F.concat(F.lit("- "), x)))
    part = lambda head, body: F.when(body.isNotNull() & (body != ""), F.concat(F.lit(f"## {head}\n\n"), body, F.lit("\n")))
    parts = [part("Overview", F.col("summary")), part("Topics", listed(F.col("main_topics"))), part("Key Concepts", listed(F.col("key_concepts"))), part("Learning Outcomes", listed(F.col("learning_outcomes")))]
    return summary.select("media_id", F.concat_ws("\n", F.concat(F.lit("# Study Notes: "), F.coalesce("lecture_title", F.lit("Lecture")), F.lit("\n")), *parts).alias("content"))
