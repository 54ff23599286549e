"""Keyed state of live sessions: streams that say the same as folds over batches, whatever the order of arrival."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.streaming import live, sessions, slides


@pytest.fixture(scope="module")
def keyed(spark):
    with sessions.keyed_state(spark):
        yield spark


def streamed(spark, tmp_path, batches, schema, operator, mode):
    """(batch, row) of the operator's output; each batch is a file, one is taken at a time."""
    there = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("arrived", F.lit(f"2024-01-01 00:{i:02}:00").cast("timestamp")).coalesce(1).write.mode("append").json(str(there / f"at={i:03}"))
    source = spark.readStream.schema(schema + ", arrived timestamp").option("maxFilesPerTrigger", 1).json(str(there) + "/at=*")
    out = []
    operator(source).writeStream.foreachBatch(lambda b, n: out.extend((n, r) for r in b.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(180)
    return out


def test_events_in_any_order(keyed, tmp_path):
    rng = random.Random(4)
    names = list(live.STEPS)
    events = [(f"s{s}", i + 1, rng.choice(names)) for s in range(12) for i in range(rng.randint(1, 9))]
    events += [("c", 1, "start"), ("c", 2, "cancel"), ("c", 3, "start"), ("c", 4, "end"), ("d", 1, "end"), ("d", 2, "cancel"), ("d", 3, "finish")]
    rows = [e for e in events for _ in range(rng.choice([1, 1, 2]))]  # some come twice
    rng.shuffle(rows)
    batches = [rows[i::4] for i in range(4)]
    found = [tuple(r) for _, r in streamed(keyed, tmp_path, batches, "session_id string, seq long, event string", sessions.machine, "append")]
    told, state = [], {}
    for s, i, e in events:
        state[s], allowed = live.step(state.get(s, "created"), e)
        told.append((s, i, state[s], allowed))
    assert sorted(found) == sorted(told)
    assert [r[2:] for r in sorted(found) if r[0] == "c"] == [("recording", True), ("cancelled", True), ("cancelled", False), ("cancelled", False)]
    assert [r[2:] for r in sorted(found) if r[0] == "d"] == [("processing", True), ("processing", False), ("done", True)]


class Handle:
    """State in memory, for what timers do."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return Value()

    def getMapState(self, name, key, value):
        return Map()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return iter(list(self.timers))


class Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Due:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_gaps_and_silence():
    m, h = sessions.Machine(keep=1000, gap=10), Handle()
    m.init(h)

    def rows(at, *events):
        return iter([pd.DataFrame(events, columns=["seq", "event"]).assign(arrived=pd.Timestamp(at, unit="ms"))])

    assert not list(m.handleInputRows(("s",), rows(0, (3, "end"), (2, "stop")), None)) and h.timers == {10}
    told = pd.concat(m.handleExpiredTimer(("s",), None, Due(10)))  # the first event never came
    assert told.values.tolist() == [["s", 2, "created", False], ["s", 3, "processing", True]] and h.timers == {1010} and not m.early
    assert not list(m.handleInputRows(("s",), rows(20, (1, "start"), (3, "end")), None))  # too late, and a repeat
    assert h.timers == {1020} and m.now.get() == ("processing", 4)
    assert not list(m.handleExpiredTimer(("s",), None, Due(1020))) and not m.now.exists()


SEGMENT = "session_id string, chunk_index int, id long, start double, end double, text string, full boolean, cancelled boolean"


def test_transcripts_like_a_batch(keyed, tmp_path):
    rng = random.Random(8)
    rows = [(f"s{s}", c, c * 10 + i, float(c * 15 + rng.choice([0, 3, 3, 7])), c * 15 + 9.5, rng.choice([" a ", "b c", "", None, "dé"]), False, False) for s in range(6) for c in range(5) for i in range(3)]
    full = [(f"s{s}", 0, i, float(i * 5), i * 5 + 4.0, f"full {i}", True, False) for s in range(0, 6, 2) for i in range(15)]
    late = rows[::7]  # repeated chunks
    gone = [("s1", 0, 0, 0.0, 0.0, None, False, True), ("s1", 9, 99, 200.0, 201.0, "after", False, False)]
    rng.shuffle(rows)
    batches = [rows[:40], full[:20] + rows[40:60], late + rows[60:], full[20:] + gone[:1], gone[1:] + late]
    found = {}
    for n, r in sorted(streamed(keyed, tmp_path, batches, SEGMENT, sessions.transcripts, "update"), key=lambda x: x[0]):
        found[r["session_id"]] = r
    told = sessions.transcripts_at_once(keyed.createDataFrame([r for b in batches for r in b], SEGMENT)).collect()
    assert {r["session_id"]: tuple(r) for r in told} == {s: tuple(r[c] for c in ("session_id", "segments", "words", "newest_chunk", "final", "text")) for s, r in found.items() if s != "s1"}
    assert (found["s1"]["segments"], found["s1"]["text"], found["s1"]["cancelled"]) == (0, "", True)
    assert found["s0"]["final"] and not found["s3"]["final"] and "full" in found["s0"]["text"]
    # the same as the batch operators on segments
    live_rows = keyed.createDataFrame([r for b in batches for r in b if not r[6]], SEGMENT)
    kept = live.final_pass(live.deduped(live_rows), live.deduped(keyed.createDataFrame(full, SEGMENT))).where("session_id <> 's1'")
    assert {(r["session_id"], r["n"]) for r in kept.groupBy("session_id").agg(F.count("*").alias("n")).collect()} == {(s, r["segments"]) for s, r in found.items() if s != "s1"}


def frames(seed, streams=5, most=60):
    rng = np.random.default_rng(seed)
    out = []
    for s in range(streams):
        base, at = rng.normal(100, 30, 16), 0.0
        for _ in range(int(rng.integers(1, most))):
            at += float(rng.choice([0.25, 0.5, 1.0, 2.0]))
            base = rng.normal(100, 30, 16) if rng.random() < 0.3 else base
            out.append((f"v{s}", at, (base + rng.normal(0, 4, 16)).tolist(), (base + rng.normal(0, 8, 16)).tolist()))
    return out


FRAME = "stream string, at double, histogram array<double>, pixels array<double>"


def folded(rows):
    """By definition, with no code of the library."""
    out, last = set(), {}
    for s, at, h, p in sorted(rows):
        h, p = np.array(h), np.array(p)
        if s in last:
            t, a, x = last[s]
            ssim = (2 * x.mean() * p.mean() + 6.5025) * (2 * np.cov(x, p, bias=True)[0, 1] + 58.5225) / ((x.mean() ** 2 + p.mean() ** 2 + 6.5025) * (x.var() + p.var() + 58.5225))
            if at - t < 1 or not (np.corrcoef(a, h)[0, 1] < 0.92 or ssim < 0.85):
                continue
        last[s] = at, h, p
        out.add((s, at))
    return out


def test_slides_of_a_batch_and_a_stream(keyed, tmp_path):
    rows = frames(3)
    told = folded(rows)
    assert 10 < len(told) < len(rows) / 2
    df = keyed.createDataFrame(rows, FRAME).repartition(7)
    assert {tuple(r) for r in slides.slide_changes(df).collect()} == told
    ordered = sorted(rows, key=lambda r: r[1])
    batches = [ordered[i : i + len(rows) // 4 + 1] for i in range(0, len(rows), len(rows) // 4 + 1)]
    found = [r for _, r in streamed(keyed, tmp_path, [random.Random(1).sample(b, len(b)) for b in batches], FRAME, sessions.slide_stream, "append")]
    assert len(found) == len(rows) and {(r["stream"], r["at"]) for r in found if r["accepted"]} == told
    assert slides.slide_changes(keyed.createDataFrame([], FRAME)).count() == 0


def test_counters_are_compacted(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(4)}", i % 3, i, float(i), i + 1.0, "w " * rng.randint(0, 5)) for i in range(60)]
    for i in range(12):
        spark.createDataFrame(rows[i * 5 : i * 5 + 5], live.TABLES["live_segments"]).coalesce(1).write.json(str(tmp_path / f"in/at={i:02}"))
    source = spark.readStream.schema(live.TABLES["live_segments"]).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/at=*")).withColumn("arrived", F.col("_metadata.file_modification_time"))
    out = tmp_path / "out"
    live.write_counters(source, str(out), str(tmp_path / "state"), once=True, compact=4).awaitTermination(120)
    assert sorted(map(tuple, live.counted(spark, str(out)).collect())) == sorted(map(tuple, live.counters(spark.createDataFrame(rows, live.TABLES["live_segments"])).collect()))
    folders = sorted(int(p.name.removeprefix("batch=")) for p in out.iterdir() if p.name.startswith("batch="))
    assert folders[0] == 15 and 23 in folders and len(folders) < 12  # of 12 batches and 3 merges


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def told(frames):
    return [tuple(r) for pdf in frames for r in pdf.values.tolist()]


def test_a_bucket_of_sessions():
    m, h = sessions.Machines(keep=1000, gap=10), Handle()
    m.init(h)

    def rows(at, *events):
        return iter([pd.DataFrame(events, columns=["session_id", "seq", "event"]).assign(arrived=pd.Timestamp(at, unit="ms"))])

    many = [(f"s{s}", seq, event) for s in range(300) for seq, event in ((2, "stop"), (1, "start"), (2, "stop"))]
    out = list(m.handleInputRows((0,), rows(5, *many), None))
    assert len(out) == 1 and len(out[0]) == 600 and h.timers == {1005}  # one table and one timer, not one for each session
    assert not list(m.handleInputRows((0,), rows(7, ("t", 3, "end"), ("t", 2, "stop"), (None, 2, "x")), None)) and h.timers == {17}
    assert told(m.handleInputRows((0,), rows(8, ("s7", 3, "end"), ("s7", 1, "start"), (None, 1, "start")), None)) == [("s7", 3, "processing", True), (None, 1, "recording", True), (None, 2, "recording", False)]
    assert told(m.handleExpiredTimer((0,), Now(20), Due(17))) == [("t", 2, "created", False), ("t", 3, "processing", True)] and h.timers == {1005}
    assert not list(m.handleInputRows((0,), rows(30, ("t", 1, "start"), ("t", 3, "end")), None))  # too late, and a repeat
    assert not list(m.handleExpiredTimer((0,), Now(1006), Due(1005))) and h.timers == {1008} and len(m.held.get()[0]) == 3
    assert not list(m.handleExpiredTimer((0,), Now(1030), Due(1008))) and not h.timers and not m.held.exists()


@pytest.mark.parametrize("buckets", [0, 3])
def test_buckets_say_the_same(keyed, tmp_path, buckets):
    rng = random.Random(5)
    events = [(s if s or not buckets else None, i + 1, rng.choice([*live.STEPS, None])) for s in range(20) for i in range(rng.randint(1, 9))]
    rows = [e for e in events for _ in range(rng.choice([1, 2]))] + [(3, None, "start")]  # an event without a number is none
    rng.shuffle(rows)
    found = streamed(keyed, tmp_path, [rows[i::3] for i in range(3)], "session_id long, seq long, event string", lambda e: sessions.machine(e, buckets=buckets), "append")
    state, expected = {}, []
    for s, i, e in events:
        state[s], allowed = live.step(state.get(s, "created"), e)
        expected.append((s, i, state[s], allowed))
    by = lambda r: (r[0] or 0, r[1])
    assert sorted((tuple(r) for _, r in found), key=by) == sorted(expected, key=by)
