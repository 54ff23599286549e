"""What the operators of this subpackage share: written intermediate tables, lookups, shingles."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup table of at most so many rows is sent to every executor.
BROADCAST_ROWS = 50_000

#: A semi-join filters with a broadcast of at most so many keys; with more the join after it does the filtering.
SEMI_ROWS = 1_000_000

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names, or in a session without one a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if _scopes:
        _scopes[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside are deleted at the end: for results that are written elsewhere before it."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt: int = 32) -> DataFrame:
    """big joined with small, which has one row a key and is already a written table.

    small is counted first. Up to BROADCAST_ROWS rows it is broadcast. Beyond that both sides are shuffled on
    the key and a salt, with small repeated for each salt, so that a key with a third of big's rows is spread.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    rows = big.withColumn("_salt", (F.monotonically_increasing_id() % salt).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return rows.join(spread.hint("merge"), [*on, "_salt"], how).drop("_salt")  # its size estimate knows nothing of the explode


def only(big: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """big without rows that a later join with keys would drop, if the (written) keys are few enough to broadcast."""
    return big.join(F.broadcast(keys.select(column).distinct()), column, "left_semi") if keys.count() <= SEMI_ROWS else big


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def weighted_lookup(big: DataFrame, small: DataFrame, on: list[str], rows: str) -> DataFrame:
    """big joined with small (written, one row a key), whose column `rows` counts big's rows of the key.

    Keys with a large share of big are few by their counts; their rows meet a broadcast table and never a shuffle.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on)
    total = small.agg(F.sum(rows)).first()[0]
    heavy = F.col(rows) >= max(1000, total // 2000)  # so at most 2000 keys
    few, big = small.where(heavy), written(big, "looked-up")  # as it is read twice
    there = big.join(F.broadcast(few), on)
    rest = big.join(F.broadcast(few.select(*on)), on, "left_anti").join(small.where(~heavy), on)
    return there.unionByName(rest)


def halves(rows: DataFrame, node: str, blocks: str) -> DataFrame:
    """rows once for each pair of blocks (lo <= hi) of their group that their own block is part of."""
    own = F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")


def small(batches, rows: int = 256):
    """The same rows in small batches, so that a task holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def grouped(batches, keys: list[str]):
    """The tables of rows with equal keys, from batches that are sorted by them. Holds one group at a time."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    last = None

    def flush():
        return pa.Table.from_batches(held)

    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(b.column(k)) for k in keys]
        changes = np.zeros(b.num_rows, bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changes).tolist(), b.num_rows]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield flush()
            held = []
        for a, z in zip(starts, starts[1:], strict=False):
            if a and held:
                yield flush()
                held = []
            held.append(b.slice(a, z - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield flush()


class Forest:
    """Union-find over 0 to n - 1; a root is the smallest of its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def join_all(self, near) -> None:
        """near: a square or oblong boolean matrix of pairs given as (rows, columns, matrix)."""
        rows, columns, matrix = near
        for i, r in enumerate(rows):
            for j in matrix[i].nonzero()[0]:
                self.join(int(r), int(columns[j]))
