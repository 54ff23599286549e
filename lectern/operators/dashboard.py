"""The dashboard's blocks. The moment that counts as now is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import subject
from lectern.operators.media import input_type

KINDS = ["video", "audio", "images", "document", "live"]


def with_live(media: DataFrame, live: DataFrame, dedupe_live: bool = False) -> DataFrame:
    """Media and live lectures in one bag (U2): a processed live lecture counts twice unless dedupe_live is set."""
    m = media.select("user_id", F.col("id").cast("string").alias("key"), input_type(F.col("media_type")).alias("input_type"), F.col("uploaded_at").alias("created_at"))
    lectures = live.select("user_id", F.col("session_id").alias("key"), F.lit("live").alias("input_type"), F.col("started_at").alias("created_at"))
    if dedupe_live:
        m = m.where("input_type <> 'live'")
    return m.unionByName(lectures)


def type_counts(bag: DataFrame, now: Column) -> DataFrame:
    """Counts by type, and those of the last 48 hours, where live is left out."""
    recent = F.col("created_at") >= now - F.expr("interval 48 hours")
    counts = [F.count_if(F.col("input_type") == k).alias(f"total_{k}") for k in KINDS]
    counts += [F.count_if((F.col("input_type") == k) & recent).alias(f"recent_{k}") for k in KINDS if k != "live"]
    out = bag.groupBy("user_id").agg(*counts)
    plus = lambda prefix: sum((F.col(f"{prefix}_{k}") for k in KINDS if f"{prefix}_{k}" in out.columns), F.lit(0))
    return out.withColumns({"total_all": plus("total").cast("long"), "recent_all": plus("recent").cast("long")})


def recent(bag: DataFrame, n: int = 10) -> DataFrame:
    """Each user's n newest entries."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "key")
    return bag.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n).select("user_id", "position", "key", "input_type", "created_at")


def subject_distribution(details: DataFrame) -> DataFrame:
    """How often each normalised subject occurs; empty ones are left out."""
    s = details.select(subject(F.col("subject_area")).alias("subject")).where("subject is not null and subject <> ''")
    return s.groupBy("subject").agg(F.count("*").alias("n"))


def shares(distribution: DataFrame) -> DataFrame:
    """With each subject's percentage of all (A10). The total is one row, broadcast."""
    total = distribution.agg(F.sum("n").alias("_total"))
    return distribution.crossJoin(F.broadcast(total)).select("subject", "n", F.round(F.col("n") / F.col("_total") * 100, 6).alias("pct"))
