"""Live sessions as keyed state of a stream: the state machine, the transcript, and the slides of a frame stream.

Each is a stateful processor, whose state lies in the state store of the executors and is cleared by timers. Rows have a
time of arrival; timers follow its watermark, so a stream that is run again, or runs over what is there and ends, says the same. A
batch that folds the same rows in order gives the same results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.text import strip
from lectern.streaming.live import step
from lectern.streaming.slides import Slides

#: Milliseconds that an unfinished gap, a finished session, or a silent one is kept.
GAP, KEEP, LATE = 10 * 60 * 1000, 24 * 3600 * 1000, "6 hours"


WORD = r"[^ \t\r\n]+"

#: Settings of streams with these processors: state in RocksDB, and no checksum files beside those of checkpoints, whose
#: few threads wait for each other in Spark 4.1 when as many tasks commit at a time.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


@contextmanager
def keyed_state(spark: SparkSession):
    """The session with SETTINGS while streams are started; a stream keeps those it was started with."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _latest(pdf: pd.DataFrame) -> int:
    return int(pdf["arrived"].max().timestamp() * 1000)


def _arriving(rows: DataFrame, late: str, *columns: str) -> DataFrame:
    """The columns and arrived, with its watermark; rows later than that are dropped.

    A stream with a stateful processor also starts a Python process on the driver, which isn't given what was shipped to the
    executors and finds this package by its path.
    """
    rows.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return rows.select(*columns, F.col("arrived").cast("timestamp").alias("arrived")).withWatermark("arrived", late)


class _Timed(StatefulProcessor):
    """Forgets a session when no row has come for `keep` milliseconds."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wake(self, arrived: int, after: int) -> None:
        """One timer at a time, so many milliseconds after the arrival."""
        self.sleep()
        self.handle.registerTimer(arrived + after)

    def sleep(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def close(self) -> None:
        pass


# --- state machine (L8) ------------------------------------------------------------------------------------------


class Machine(_Timed):
    """Events of a session in the order of their numbers, however they arrive.

    The state holds the session's state, the number that is due, and the events that came before it. A number that was
    dealt with is a repeat and changes nothing. If the due number doesn't come for `gap` milliseconds, those that wait go on.
    A cancelled session keeps its last number only, so that events on their way are refused, until it is forgotten.
    """

    def __init__(self, keep: int = KEEP, gap: int = GAP):
        super().__init__(keep)
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "state string, due long")
        self.early = handle.getMapState("early", "seq long", "event string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, due = self.now.get() if self.now.exists() else ("created", 1)
        waiting = {k[0]: v[0] for k, v in self.early.iterator()}
        held, arrived = set(waiting), 0
        for pdf in rows:
            arrived = max(arrived, _latest(pdf))
            for seq, event in zip(pdf["seq"].tolist(), pdf["event"].tolist(), strict=True):
                if seq >= due:
                    waiting.setdefault(seq, event)
        yield from self._go(key, state, due, waiting, held, arrived)

    def _go(self, key, state, due, waiting, held, arrived, skip: bool = False) -> Iterator[pd.DataFrame]:
        state, due, out = _advanced(state, due, waiting, skip)
        for seq in held - set(waiting):
            self.early.removeKey((seq,))
        for seq in set(waiting) - held:
            self.early.updateValue((seq,), (waiting[seq],))
        self.now.update((state, due))
        self.wake(arrived, self.gap if waiting else self.keep)
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["session_id", "seq", "state", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = {k[0]: v[0] for k, v in self.early.iterator()}
        if waiting:
            yield from self._go(key, *self.now.get(), waiting, set(waiting), expiredTimerInfo.getExpiryTimeInMs(), skip=True)
        else:
            self.now.clear()


def _advanced(state: str, due: int, waiting: dict, skip: bool = False) -> tuple[str, int, list[tuple]]:
    """State and number due after the events of waiting that follow each other, which are taken out, and what each of them did."""
    out = []
    if skip and waiting:
        due = min(waiting)
    while due in waiting:
        state, allowed = step(state, waiting.pop(due))
        out.append((due, state, allowed))
        due += 1
    return state, due, out


class Machines(_Timed):
    """Machine for many short sessions: a key is a bucket of sessions, read and written at once.

    A call of the processor and each use of its state cost much more than an event. The state holds for each session
    its state, the number due and the time when it is to be woken, and the early events of all; the one timer is that of the first to be woken.
    """

    def __init__(self, keep: int = KEEP, gap: int = GAP):
        super().__init__(keep)
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("held", "session_id array<string>, state array<string>, due array<long>, wake array<long>, early_of array<int>, early_seq array<long>, early_event array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, latest = self._read(), {}
        for pdf in rows:
            ids, events = (pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in ("session_id", "event"))
            at = pdf["arrived"].to_numpy("datetime64[ms]").astype("int64").tolist()
            for session, seq, event, arrived in zip(ids, pdf["seq"].tolist(), events, at, strict=True):
                if session not in held:
                    held[session] = ["created", 1, 0, {}]
                latest[session] = max(arrived, latest.get(session, 0))
                if seq >= held[session][1]:
                    held[session][3].setdefault(seq, event)
        yield from self._go(held, latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        held = self._read()
        due = {session: x[2] for session, x in held.items() if x[2] <= now}
        for session in [s for s in due if not held[s][3]]:
            del held[session], due[session]
        yield from self._go(held, due, skip=True)

    def _go(self, held: dict, latest: dict, skip: bool = False) -> Iterator[pd.DataFrame]:
        """Takes the sessions of latest on, which has the time of each one's last row, and writes all that are held."""
        out = []
        for session, arrived in latest.items():
            state, due, _, waiting = held[session]
            state, due, told = _advanced(state, due, waiting, skip)
            held[session] = [state, due, arrived + (self.gap if waiting else self.keep), waiting]
            out += [(session, *x) for x in told]
        self.sleep()
        if held:
            early = [(n, seq, event) for n, x in enumerate(held.values()) for seq, event in x[3].items()]
            self.held.update((list(held), *(list(x) for x in list(zip(*held.values(), strict=True))[:3]), *([e[k] for e in early] for k in range(3))))
            self.handle.registerTimer(min(x[2] for x in held.values()))
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "seq", "state", "allowed"])

    def _read(self) -> dict:
        """By session its state, the number due, when it is to be woken, and its early events."""
        if not self.held.exists():
            return {}
        sessions, state, due, wake, of, seq, event = self.held.get()
        held = {session: [*x, {}] for session, *x in zip(sessions, state, due, wake, strict=True)}
        for n, q, e in zip(of, seq, event, strict=True):
            held[sessions[n]][3][q] = e
        return held


#: Buckets of sessions, the keys of a stream's state. A row brings the state of its whole bucket in and out: more buckets suit more sessions.
BUCKETS = 1024


def machine(events: DataFrame, late: str = LATE, keep: int = KEEP, gap: int = GAP, buckets: int = BUCKETS) -> DataFrame:
    """State after each event of a stream of session_id, seq (from 1), event and arrived, each once.

    Sessions are held in buckets, whose number is that of the stream for ever; with 0 each session is a key, which suits few long ones;
    their ids, if numbers, must not be null then.
    """
    kind = events.schema["session_id"].dataType.simpleString()
    rows = _arriving(events.withColumn("seq", F.col("seq").cast("long")).where("seq is not null"), late, "session_id", "seq", "event")
    told = "seq long, state string, allowed boolean"
    if not buckets:
        return rows.groupBy("session_id").transformWithStateInPandas(Machine(keep, gap), f"session_id {kind}, {told}", "Append", "EventTime")
    rows = rows.withColumn("session_id", F.col("session_id").cast("string")).withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    out = rows.groupBy("bucket").transformWithStateInPandas(Machines(keep, gap), f"session_id string, {told}", "Append", "EventTime")
    return out.withColumn("session_id", F.col("session_id").cast(kind))


# --- transcript (L4, L6, L9) -------------------------------------------------------------------------------------


class Transcript(_Timed):
    """The segments of a session by start time, and their text after each batch.

    Of segments of one start a live one comes before one of the final pass, and then the one of the smallest id and text, in
    whatever order they arrive: late and repeated chunks change nothing that a batch wouldn't say. All new chunks of a
    batch are taken, not the newest alone, as nothing is won by leaving the others to the final pass. The final
    pass adds the segments whose starts no chunk had. A cancelled session's segments go, and none comes after.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.segments = handle.getMapState("segments", "start double", "full boolean, id long, end double, text string")
        self.newest = handle.getValueState("newest", "chunk_index int, full boolean, cancelled boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        there = {k[0]: tuple(v) for k, v in self.segments.iterator()}
        chunk, full, cancelled = self.newest.get() if self.newest.exists() else (-1, False, False)
        changed, arrived = set(), 0
        for pdf in rows:
            arrived = max(arrived, _latest(pdf))
            cancelled = cancelled or bool(pdf["cancelled"].any())
            for r in () if cancelled else pdf.itertuples(index=False):
                new = (bool(r.full), int(r.id), float(r.end), r.text or "")
                if r.start not in there or self._order(new) < self._order(there[r.start]):
                    there[r.start] = new
                    changed.add(r.start)
                chunk, full = max(chunk, -1 if r.full else int(r.chunk_index)), full or bool(r.full)
        if cancelled:
            self.segments.clear()
            there, changed, chunk, full = {}, set(), -1, False
        for start in changed:
            self.segments.updateValue((start,), there[start])
        self.newest.update((chunk, full, cancelled))
        self.wake(arrived, self.keep)
        text = " ".join(there[s][3].strip() for s in sorted(there))
        yield pd.DataFrame({"session_id": [key[0]], "segments": [len(there)], "words": [len(re.findall(WORD, text))], "newest_chunk": [chunk], "final": [full], "cancelled": [cancelled], "text": [text]})

    @staticmethod
    def _order(segment: tuple) -> tuple:
        full, id_, _, text = segment
        return full, id_, text

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.segments.clear()
        self.newest.clear()
        return iter([])


def transcripts(segments: DataFrame, late: str = LATE, keep: int = KEEP) -> DataFrame:
    """Transcript of each session after each batch.

    segments: as shifted() gives them, with full, true for the final pass, cancelled, true for a row that says so, and arrived.
    """
    kind = segments.schema["session_id"].dataType.simpleString()
    schema = f"session_id {kind}, segments long, words long, newest_chunk int, final boolean, cancelled boolean, text string"
    rows = _arriving(segments, late, "session_id", "chunk_index", "id", "start", "end", "text", "full", "cancelled")
    return rows.groupBy("session_id").transformWithStateInPandas(Transcript(keep), schema, "Update", "EventTime")


def transcripts_at_once(segments: DataFrame) -> DataFrame:
    """The last state of each session that isn't cancelled, of a batch of all segments."""
    segments = segments.join(segments.where("cancelled").select("session_id").distinct(), "session_id", "left_anti")
    first = segments.groupBy("session_id", "start").agg(F.min_by("text", F.struct("full", "id", "text")).alias("text"))
    lines = first.groupBy("session_id").agg(F.count("*").alias("segments"), F.array_sort(F.collect_list(F.struct("start", strip(F.coalesce("text", F.lit(""))).alias("text")))).alias("lines"))
    seen = segments.groupBy("session_id").agg(F.max(F.when(~F.col("full"), F.col("chunk_index")).otherwise(-1)).alias("newest_chunk"), F.bool_or("full").alias("final"))
    text = F.array_join("lines.text", " ")
    return lines.join(seen, "session_id").select("session_id", "segments", F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), "newest_chunk", "final", text.alias("text"))


# --- slides (L14) ------------------------------------------------------------------------------------------------


class SlideFilter(_Timed):
    """Slides of a stream of frames: the state is the last accepted frame.

    The frames of a batch are taken in order of time. One that comes later than a newer frame that was accepted is too near to it, and is no slide.
    """

    def __init__(self, options: dict, keep: int = KEEP):
        super().__init__(keep)
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at double, histogram array<double>, pixels array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        slides = Slides(**self.options, last=before and (before[0], *(np.asarray(v, float) for v in before[1:])))
        pdf = pd.concat(list(rows)).sort_values("at")
        taken = [slides.takes(r.at, np.asarray(r.histogram, float), np.asarray(r.pixels, float)) for r in pdf.itertuples(index=False)]
        if any(taken):
            at, histogram, pixels = slides.last
            self.last.update((float(at), histogram.tolist(), pixels.tolist()))
        self.wake(_latest(pdf), self.keep)
        yield pd.DataFrame({"stream": [key[0]] * len(pdf), "at": pdf["at"].tolist(), "accepted": taken})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])


def slide_stream(frames: DataFrame, late: str = LATE, keep: int = KEEP, **options: float) -> DataFrame:
    """Each frame of a stream (stream, at, histogram, pixels, arrived) and whether it is a new slide."""
    kind = frames.schema["stream"].dataType.simpleString()
    return _arriving(frames, late, "stream", "at", "histogram", "pixels").groupBy("stream").transformWithStateInPandas(SlideFilter(options, keep), f"stream {kind}, at double, accepted boolean", "Append", "EventTime")
