"""Live sessions: segments that arrive in chunks, the session's state, and the final pass.

The functions on segments are stateless DataFrame operators that a stream and a batch both use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import words
from lectern.schemas import TABLES
from lectern.streaming.slides import slide_changes  # noqa: F401

CHUNK_SECONDS, STITCH_SECONDS, LEAST_WORDS = 15, 300, 5


def shifted(segments: DataFrame, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Times from the session's start instead of the chunk's."""
    return segments.withColumns({"start": F.col("start") + F.col("chunk_index") * seconds, "end": F.col("end") + F.col("chunk_index") * seconds})


def deduped(segments: DataFrame) -> DataFrame:
    """Of segments of one start the one of the smallest id."""
    order = Window.partitionBy("session_id", "start").orderBy("id", "text")
    return segments.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("session_id", "start", "end", "id", "text")


def counters(segments: DataFrame) -> DataFrame:
    """Segments and words of each session, and whether they are too few for a summary."""
    return segments.groupBy("session_id").agg(F.count("*").alias("segments"), F.coalesce(F.sum(words(F.col("text"))), F.lit(0)).alias("words")).withColumn("too_short", F.col("words") < LEAST_WORDS)


def stitched(segments: DataFrame, seconds: int = STITCH_SECONDS) -> DataFrame:
    """Chunks one after the other (L13): a missing chunk keeps its time, ids run on over the chunks that are there."""
    own = F.row_number().over(Window.partitionBy("session_id", "chunk_index").orderBy("id", "text")) - 1
    sizes = segments.groupBy("session_id", "chunk_index").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).drop("n")
    return segments.withColumn("_own", own).join(sizes, ["session_id", "chunk_index"]).select("session_id", "chunk_index", (F.col("before") + F.col("_own")).alias("id"), (F.col("start") + F.col("chunk_index") * seconds).alias("start"), "text")


def uniform_sample(rows: DataFrame, group: list[str], index: str, most: int = 10) -> DataFrame:
    """At most so many rows of each group, evenly spread (P19). index counts the group's rows from 0."""
    n = F.count("*").over(Window.partitionBy(*group))
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * F.col("_of") / most).cast("long"))
    return rows.withColumn("_of", n).where((F.col("_of") <= most) | F.array_contains(at, F.col(index).cast("long"))).drop("_of")


def slide_stats(frames: DataFrame, accepted: DataFrame) -> DataFrame:
    """Seen, accepted and skipped frames of each stream, and the percentage skipped."""
    seen = frames.groupBy("stream").agg(F.count("*").alias("seen"))
    out = seen.join(accepted.groupBy("stream").agg(F.count("*").alias("accepted")), "stream", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    return out.withColumn("skipped", F.col("seen") - F.col("accepted")).withColumn("skipped_pct", 100 * F.col("skipped") / F.greatest("seen", F.lit(1)))


def source(spark: SparkSession, path: str) -> DataFrame:
    """Segment records as files of JSON lines that arrive under a path (L1, L3), with the time when they arrived."""
    return spark.readStream.schema(TABLES["live_segments"]).json(path).withColumn("arrived", F.col("_metadata.file_modification_time"))


def write_transcripts(segments: DataFrame, path: str, checkpoint: str, seconds: int = CHUNK_SECONDS, once: bool = False, late: str = "6 hours"):
    """Starts the stream that appends shifted segments, each start of a session once.

    The state holds the starts seen within the watermark of `late` behind the newest arrival, longer than a session
    lasts. Triggered every so many seconds, or with once until the input is used up.
    """
    rows = shifted(segments).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["session_id", "start"])
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def write_counters(segments: DataFrame, path: str, checkpoint: str, once: bool = False, late: str = "6 hours", compact: int = 20):
    """Starts the stream that appends the counters of each session and hour of arrival below a path.

    State is one row for each session and hour within the watermark; sums by session are a batch query, counted(). Each
    batch is a folder; after every so many batches one folder with the last state of all takes their place. Those before
    the one merged last are deleted, so that readers of the newest find what they listed.
    """
    hours = segments.withWatermark("arrived", late).groupBy("session_id", F.window("arrived", "1 hour").alias("hour"))
    rows = hours.agg(F.count("*").alias("segments"), F.coalesce(F.sum(words(F.col("text"))), F.lit(0)).alias("words"))

    def put(batch: DataFrame, number: int) -> None:  # a repeated batch replaces itself
        batch.select("session_id", F.col("hour.start").alias("hour"), "segments", "words").write.mode("overwrite").parquet(f"{path}/batch={2 * number}")
        if number % compact == compact - 1:
            _last(batch.sparkSession.read.parquet(path).where(F.col("batch") <= 2 * number)).select("session_id", "hour", "c.*").write.mode("overwrite").parquet(f"{path}/batch={2 * number + 1}")
            _drop_batches(batch.sparkSession, path, 2 * (number - compact) + 1)

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if once else writer).start()


def _last(counters_: DataFrame) -> DataFrame:
    return counters_.groupBy("session_id", "hour").agg(F.max_by(F.struct("segments", "words"), "batch").alias("c"))


def _drop_batches(spark: SparkSession, path: str, before: int) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.listStatus(folder):
        name = found.getPath().getName()
        if name.startswith("batch=") and int(name.removeprefix("batch=")) < before:
            fs.delete(found.getPath(), True)


def counted(spark: SparkSession, path: str) -> DataFrame:
    """Counters of each session from what write_counters() has written: the last state of each hour."""
    return _last(spark.read.parquet(path)).groupBy("session_id").agg(F.sum("c.segments").alias("segments"), F.sum("c.words").alias("words")).withColumn("too_short", F.col("words") < LEAST_WORDS)


#: State after each event, for the states in which it is allowed.
STEPS = {
    "start": {"created": "recording"},
    "stop": {"recording": "stopped"},
    "end": {"created": "processing", "recording": "processing", "stopped": "processing"},
    "finish": {"processing": "done"},
    "fail": {"recording": "error", "stopped": "error", "processing": "error", "created": "error"},
    "cancel": {"created": "cancelled", "recording": "cancelled", "stopped": "cancelled", "error": "cancelled"},
}


def step(state: str, event: str) -> tuple[str, bool]:
    """The next state and whether the event is allowed."""
    after = STEPS.get(event, {}).get(state)
    return (after, True) if after else (state, False)


def transition(state: Column, event: Column) -> Column:
    """step() as a struct of state and allowed, for rows that know their state."""
    after = F.create_map(*(F.lit(x) for e, to in STEPS.items() for s, t in to.items() for x in (f"{e} {s}", t)))[F.concat_ws(" ", event, state)]
    return F.struct(F.coalesce(after, state).alias("state"), after.isNotNull().alias("allowed"))


def sessions(live: DataFrame) -> DataFrame:
    """Each user's live sessions, the newest first."""
    order = Window.partitionBy("user_id").orderBy(F.desc("started_at"), "session_id")
    return live.withColumn("position", F.row_number().over(order))


def round_robin(frames: DataFrame) -> DataFrame:
    """Frames in rounds of one frame a stream, streams that end dropping out (L15). frames: stream, at."""
    rounds = F.row_number().over(Window.partitionBy("stream").orderBy("at"))
    return frames.withColumn("round", rounds - 1)


def final_pass(live: DataFrame, full: DataFrame) -> DataFrame:
    """The full pass added to the live segments; of one start the live one stays."""
    columns = ["session_id", "start", "end", "id", "text"]
    both = live.select(*columns, F.lit(0).alias("_from")).unionByName(full.select(*columns, F.lit(1).alias("_from")))
    order = Window.partitionBy("session_id", "start").orderBy("_from", "id", "text")
    return both.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select(*columns)
