"""Substring search by an index of trigrams, in place of a scan of every text.

The index is a table of (trigram, id), in folders by a hash of the trigram. A search reads the folders of the wanted
words' trigrams only; the ids that have all of them are candidates, and only their texts are looked at. It finds what a scan finds.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.library import contains

FOLDERS, SIZE = 64, 3


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for null and for shorter texts."""
    letters = F.split(F.lower(text), "")
    letters = F.filter(letters, lambda c: c != "")
    from_ = lambda i: F.slice(letters, F.lit(i), F.greatest(F.size(letters) - (SIZE - 1), F.lit(0)))
    joined = lambda a, b: F.concat(a, b)
    some = F.zip_with(F.zip_with(from_(1), from_(2), joined), from_(3), joined)
    return F.when(F.size(letters) >= SIZE, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def folder_of(trigram: Column) -> Column:
    return F.pmod(F.crc32(trigram), F.lit(FOLDERS)).cast("int")


def write_index(rows: DataFrame, path: str, text: str = "text", id_column: str = "id") -> None:
    """The index of rows, which have one row an id; a repeated id has the trigrams of all its texts."""
    found = rows.select(F.col(id_column).alias("id"), F.explode(trigrams(F.col(text))).alias("trigram")).distinct()
    found.withColumn("folder", folder_of(F.col("trigram"))).repartition("folder", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("trigram").write.mode("overwrite").partitionBy("folder").parquet(path)


def wanted_trigrams(wanted: str) -> list[str]:
    wanted = wanted.lower()
    return sorted({wanted[i : i + SIZE] for i in range(len(wanted) - SIZE + 1)})


def candidates(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """id of the texts with every trigram of the wanted words; wanted has at least SIZE characters."""
    names = wanted_trigrams(wanted)
    folders = sorted({zlib.crc32(n.encode()) % FOLDERS for n in names})
    some = spark.read.parquet(path).where(F.col("folder").isin(folders) & F.col("trigram").isin(names))
    return some.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(names)).select("id")


def search(rows: DataFrame, path: str, wanted: str, text: str = "text", id_column: str = "id") -> DataFrame:
    """The rows whose text holds the words in any case. Words of fewer than SIZE characters ask for a scan."""
    if len(wanted.lower()) < SIZE:
        return rows.where(contains(F.col(text), wanted))
    found = candidates(rows.sparkSession, path, wanted).withColumnRenamed("id", id_column)
    return rows.join(found, id_column, "left_semi").where(contains(F.col(text), wanted))


