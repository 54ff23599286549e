"""Search by an index and reads of a database: the rows of a scan, of which a small part is looked at."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import search, writes
from lectern.operators.library import contains
from lectern.sources import database


def test_search_like_a_scan(spark, tmp_path):
    rng = random.Random(2)
    words = "alpha Beta gamma DELTA ünï straße 日本語 x1 ab a b's %_ İstanbul".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5))) if i % 17 else None) for i in range(900)] + [(900, "needle in a haystack"), (901, "ab"), (902, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path / "index")
    search.write_index(df, path)
    for wanted in ("beta", "TA GAM", "a b", "日本語", "straße", "b's", "%_", "ab", "", "needle", "none such", "lpha alpha", "i̇stanbul"):
        told = {r["id"] for r in df.where(contains(F.col("text"), wanted)).collect()}
        assert {r["id"] for r in search.search(df, path, wanted).collect()} == told, wanted
    seen = search.candidates(spark, path, "needle").count()
    assert seen == 1 and search.candidates(spark, path, "alpha").count() < 900
    plan = search.candidates(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "In(trigram" in plan
    assert spark.read.parquet(path).where(F.col("folder") != search.folder_of(F.col("trigram"))).count() == 0


@pytest.fixture(scope="module")
def derby(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("db")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{folder}/derby.log")
    url = f"jdbc:derby:{folder}/media;create=true"
    rows = spark.range(500).select((F.col("id") * 3).alias("id"), (F.col("id") % 7).alias("user_id"), F.concat(F.lit("lec_"), F.col("id") % 11).alias("stem"))
    database.write(rows.coalesce(1), url, "media", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", createTableColumnTypes="stem varchar(64)")
    return url, rows


def test_database(spark, derby):
    url, rows = derby
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    some = database.scan(spark, url, "media", [2, 5], **options)
    assert some.rdd.getNumPartitions() == 8
    found = some.where("stem = 'lec_3'").select("id", "stem")
    assert sorted(map(tuple, found.collect())) == sorted((r["id"], r["stem"]) for r in rows.where("user_id in (2, 5) and stem = 'lec_3'").collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "In(user_id, [2,5])" in pushed and "EqualTo(stem,lec_3)" in pushed and "struct<id:bigint,stem:string>" in plan
    assert database.scan(spark, url, "media", [1], partitions=1, **options).count() == 72
    with pytest.raises(ValueError):
        database.scan(spark, url, "media", [], **options)


def test_tables_keep_what_readers_hold(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200).select(F.col("id").alias("media_id"), F.lit("old").alias("text"))
    writes.replace_children(rows, path)
    before = writes.table(spark, path, rows)
    writes.replace_children(rows.where("media_id < 150").withColumn("text", F.lit("new")), path)
    assert before.where("text = 'old'").count() == 200  # read after the write
    assert writes.table(spark, path, rows).where("text = 'new'").count() == 150
    assert writes.vacuum(spark, path) == 0 and writes.vacuum(spark, path, keep_seconds=0) > 0 and writes.vacuum(spark, path, keep_seconds=0) == 0
    assert writes.table(spark, path, rows).count() == 200
