"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions of the features in time linear in them, by the sum-of-squares identity.

It is trained by Adam on at most MAX_TRAIN labelled documents, those with the smallest hashes of their ids, so
the driver's memory is bounded. Scoring is one pass over the whole texts without a shuffle.

Defined cases: null texts are empty ones; unlabelled and null labels teach nothing; with labels of one class or
none every score is the smoothed share of that class; equal rows are scored each; a label table with several
rows of one id counts the largest; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

MAX_TRAIN = 6000
HASHED, FACTORS, EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY, SEED = 1 << 12, 8, 12, 300, 128, 0.01, 1e-4, 11

#: Classes of ASCII bytes.
_UPPER, _DIGIT, _STOP, _COMMA = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?", b",;:"
_SYMBOL, _SPACE = b"!\"#$%&'()*+/<=>@[\\]^_`{|}~", b" \t\n\r\x0b\x0c"
STATISTICS = ["log_chars", "log_words", "word_length", "upper", "digit", "stop", "comma", "symbol", "space", "distinct", "repeated_next", "repeated_next2", "line_length", "distinct_lines", "short", "long", "bar", "wide", "meta_chars"]


def statistics(text: str, words: list[bytes], raw: bytes, n_chars: float) -> list[float]:
    n, size = len(words) or 1, len(raw) or 1
    lines = text.split("\n")
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    lengths = list(map(len, words))
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(lengths) / n, share(_UPPER), share(_DIGIT), share(_STOP), share(_COMMA), share(_SYMBOL), share(_SPACE),
        len(set(words)) / n, sum(map(eq, words, words[1:])) / n, sum(map(eq, words, words[2:])) / n, np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines),
        sum(x < 3 for x in lengths) / n, sum(x > 14 for x in lengths) / n, share(b"|"), (len(raw) - len(text)) / size, np.log1p(max(n_chars, 0.0)),
    ]


def features(texts: list[str | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words as normalised log counts, and the statistics."""
    x, stats = np.zeros((len(texts), HASHED), np.float32), np.zeros((len(texts), len(STATISTICS)), np.float32)
    for i, (t, n) in enumerate(zip(texts, n_chars, strict=True)):
        t = t or ""
        words = t.lower().encode("utf-8", "replace").split()
        stats[i] = statistics(t, words, t.encode("utf-8", "replace"), float(len(t) if n is None else n))
        if words:
            count = np.bincount(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & (HASHED - 1), minlength=HASHED)
            row = np.log1p(count, dtype=np.float32)
            x[i] = row / np.sqrt(row @ row)
    return x, stats


class Machine:
    """The trained parameters; score() gives probabilities."""

    def __init__(self, base: float, mean=None, scale=None, w=None, v=None):
        self.base, self.mean, self.scale, self.w, self.v = base, mean, scale, w, v
        self.v2 = None if v is None else v**2

    def joined(self, x: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.clip((stats - self.mean) / self.scale, -4, 4) / 4])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + x @ self.w + 0.5 * (((x @ self.v) ** 2) - (x**2) @ self.v2).sum(1)

    def score(self, x: np.ndarray, stats: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.raw(self.joined(x, stats)).astype(np.float64), -30, 30)))


def train(x: np.ndarray, stats: np.ndarray, y: np.ndarray) -> Machine:
    n, positive = len(y), float(y.sum())
    if positive in (0, n):
        return Machine((positive + 1) / (n + 2))
    rng = np.random.default_rng(SEED)
    m = Machine(float(np.log(positive / (n - positive))), stats.mean(0), stats.std(0) + 1e-3)
    features_ = m.joined(x, stats)
    p = {"w": np.zeros(features_.shape[1], np.float32), "v": rng.normal(0, 0.05, (features_.shape[1], FACTORS)).astype(np.float32), "b": np.array([m.base], np.float32)}
    first, second, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // n)):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at : at + BATCH]
            a = features_[rows]
            inner = a @ p["v"]
            out = p["b"][0] + a @ p["w"] + 0.5 * (inner**2 - (a**2) @ (p["v"] ** 2)).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(out, -30, 30)))) - y[rows]).astype(np.float32) / len(rows)
            grads = {"w": a.T @ g + DECAY * p["w"], "v": a.T @ (g[:, None] * inner) - ((a**2).T @ g)[:, None] * p["v"] + DECAY * p["v"], "b": np.array([g.sum()], np.float32)}
            step += 1
            for k, d in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(p["b"][0]), m.mean, m.scale, p["w"], p["v"])


def remainder(id_column: Column, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def labelled(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, limit: int, columns: list[str]) -> DataFrame:
    """At most limit labelled documents, those with the smallest hashes of their ids; one row an id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & may_learn)
    known = known.groupBy("doc_id").agg(F.max(label).alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", *columns).join(F.broadcast(known), "doc_id")
    one = rows.groupBy("doc_id").agg(F.max("_label").alias("_label"), F.max(F.struct(*columns)).alias("_row"))  # of one row
    return one.select("doc_id", "_label", *(F.col(f"_row.{c}").alias(c) for c in columns))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, limit: int = MAX_TRAIN) -> Machine:
    """docs: doc_id, text, n_chars; labels: doc_id, quality. may_learn: a condition on doc_id."""

    def extract(batches):
        for b in small(batches):
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                x, stats = features(texts[at : at + 256], b.column("n_chars").to_pylist()[at : at + 256])
                packed = []
                for row in x:
                    at_ = np.flatnonzero(row).astype("<u2")
                    packed.append((at_.tobytes(), row[at_].astype("<f4").tobytes()))
                arrays = [b.column("doc_id").slice(at, len(x)), pa.array([r[0] for r in packed], pa.binary()), pa.array([r[1] for r in packed], pa.binary()), pa.array([s.astype("<f4").tobytes() for s in stats], pa.binary()), b.column("_label").slice(at, len(x)).cast(pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "at", "x", "stats", "label"])

    sample = labelled(docs, labels, "quality", may_learn, limit, ["text", "n_chars"])
    rows = sample.mapInArrow(extract, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at binary, x binary, stats binary, label int").toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    x = np.zeros((len(rows), HASHED), np.float32)
    for i, (at, v) in enumerate(zip(rows["at"], rows["x"], strict=True)):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(v, "<f4")
    stats = np.array([np.frombuffer(s, "<f4") for s in rows["stats"]], np.float32).reshape(len(rows), len(STATISTICS))
    return train(x, stats, rows["label"].to_numpy(np.float32))


def scored(docs: DataFrame, machine: Machine, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all by default) of docs and _score; docs has text and n_chars."""
    keep = keep or docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", _score double"

    def score(batches):
        for b in small(batches):
            texts, sizes, out = b.column("_text").to_pylist(), b.column("_n").to_pylist(), []
            for at in range(0, len(texts), 64):
                out.append(machine.score(*features(texts[at : at + 64], sizes[at : at + 64])))
            kept = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], [*keep, "_score"])

    return docs.select(*keep, F.col("text").alias("_text"), F.col("n_chars").cast("long").alias("_n")).mapInArrow(score, schema)


def may_learn() -> Column:
    return remainder(F.col("doc_id"), 3) != 1


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = scored(docs, fit(docs, labels, may_learn()), ["doc_id"])
    return rows.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
