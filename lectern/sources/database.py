"""Tables of a database over JDBC, read in parallel, with what the database can filter left to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bounds(spark: SparkSession, url: str, table: str, column: str, quote: str = '"', **options: str) -> tuple[int, int]:
    """Least and largest value of a whole-number column, told by the database; 0 and 0 of an empty table. quote: of its names."""
    reader = spark.read.format("jdbc").options(url=url, query=f"select min({quote}{column}{quote}) as lo, max({quote}{column}{quote}) as hi from {table}", **options)
    row = reader.load().first()
    return int(row[0] or 0), int(row[1] or 0)


def scan(spark: SparkSession, url: str, table: str, users: list[int], by: str = "id", partitions: int = 8, user_column: str = "user_id", quote: str = '"', **options: str) -> DataFrame:
    """The rows of some users: every read names its users, and the database filters them.

    The column `by` is cut into ranges of equal width, and each task reads one. Filters, columns and limits of later steps reach
    the database too. options go to the connection (driver, user, password).
    """
    if not users:
        raise ValueError("name the users whose rows are read")
    low, high = bounds(spark, url, table, by, quote, **options)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    reader = reader.options(partitionColumn=by, lowerBound=low, upperBound=high + 1, numPartitions=max(1, min(partitions, high - low + 1)))
    reader = reader.option("pushDownPredicate", "true").option("pushDownLimit", "true").option("pushDownOffset", "true").option("fetchsize", "10000")
    return reader.load().where(F.col(user_column).isin(users))


def write(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Appends rows; the table is made if it isn't there."""
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
