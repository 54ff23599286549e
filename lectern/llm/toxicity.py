"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Every word of the labelled examples is a term; none is left out. Texts are unit vectors of (1 + ln tf) * idf. The
examples' postings are cut into blocks of BLOCK examples with the largest weight of each term in each block. A search
adds up these bounds, visits blocks from the largest bound down and ends when no block can hold a nearer example, so
its K nearest by cosine are exact.

Their labels vote. A neighbour's vote weighs the more the nearer it is, and by what the labels say of the words that
it shares with the text: the part of the cosine that is due to telling words, each taken z^4 / (z^4 + LEVEL^4) times,
where z is the score of the log ratio of its shares in toxic and other examples. Prose is alike in words that tell nothing, so
neighbours alone find half as much. A logistic curve is fitted on the votes of the examples, each without itself and with what
the labels of the other folds say of words, and turns votes into scores. The neighbours and their similarities are the evidence.

Bounds, all parameters: at most MAX_EXAMPLES labelled documents are learned from, those with the smallest hashes of
their ids; that bounds the index, which goes to every executor. Near copies among them (NEAR of SEEDS word minima
agree) are one example, that with the smallest id, or a copied text would outvote and miscount all others. Every
document is searched, over its whole text.

Defined cases: null texts are empty ones; null labels teach nothing; with no labels each score is 0.5; a text
without any word of the examples gets the examples' share of toxic ones, as there is no neighbour; equal
similarities prefer the smaller doc_id; equal rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written
from .quality import labelled, remainder

MAX_EXAMPLES, K, BLOCK = 8000, 64, 256
#: Words below LEAST tell nothing; EVEN is what each vote weighs at least, and DOUBT pulls sums of weak votes towards 0.
LEVEL, LEAST, EVEN, DOUBT, FOLDS = 5.0, 0.1, 1e-4, 0.01, 4
#: Neighbours that are told as evidence, and texts whose common words are multiplied at a time.
EVIDENCE, TOGETHER = 16, 32
COMMON = 1 / 16
SEEDS, NEAR = 16, 10
#: ASCII letters stay and so do bytes of other letters; all else separates words.
_APART = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_APART).split()


def signature(text: str | None) -> np.ndarray:
    """Minima of SEEDS hashes over the distinct words."""
    own = np.fromiter({zlib.crc32(w) for w in words(text)} or {0}, np.uint64)
    odd = (np.arange(1, SEEDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    mixed = (own[:, None] + np.uint64(1)) * odd
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(0).view(np.int64)


def apart(rows: list[tuple[int, list[int]]]) -> list[int]:
    """Ids of rows (id, signature) without those of which NEAR minima agree with an earlier one that stays."""
    seen: dict[tuple[int, int], list[int]] = {}
    out = []
    for id_, own in rows:
        if max(Counter(k for x in enumerate(own) for k in seen.get(x, ())).values(), default=0) < NEAR:
            for x in enumerate(own):
                seen.setdefault(x, []).append(len(out))
            out.append(id_)
    return out


def told_apart(df: np.ndarray, toxic: np.ndarray, n: int, positive: int) -> np.ndarray:
    """0 to 1 for each term: how surely its share differs between the classes."""
    other = df - toxic
    ratio = np.log((toxic + 0.5) / (positive + 1)) - np.log((other + 0.5) / (n - positive + 1))
    z4 = (ratio**2 / (1 / (toxic + 0.5) + 1 / (other + 0.5))) ** 2
    return z4 / (z4 + LEVEL**4)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range of a size, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Index:
    """Labelled examples as postings by term and block, with the largest weight of each, and the calibration.

    Examples that look alike (by their surest term, their most frequent common term and their size) lie side by
    side, so that the bounds of blocks differ. The blocks of terms that COMMON of the examples hold are nearly full,
    so these terms have a weight for each example of a block instead of postings.
    """

    def __init__(self, ids: np.ndarray, y: np.ndarray, sizes: np.ndarray, terms: pa.Array, counts: np.ndarray):
        """ids in rising order, with label y and so many terms each; terms and counts: those of all examples in a row."""
        n = len(ids)
        coded = terms.dictionary_encode()
        term, self.vocabulary = np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()
        row = np.repeat(np.arange(n), sizes)
        size = len(self.vocabulary)
        df, toxic = np.bincount(term, minlength=size), np.bincount(term, y[row], minlength=size)
        fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids.tolist()], np.int64)
        sure = [told_apart(df, toxic, n, int(y.sum()))]
        for f in range(FOLDS):
            out = fold[row] == f
            sure.append(told_apart(df - np.bincount(term[out], minlength=size), toxic - np.bincount(term[out], y[row[out]], minlength=size), int((fold != f).sum()), int(y[fold != f].sum())))
        self.sure = np.array(sure, np.float32)  # by all examples, and by those out of each fold
        self.sure[self.sure < LEAST] = 0
        sure = sure[0]
        self.scale = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
        self.base = float((y.sum() + 1) / (n + 2))
        weight = (1 + np.log(counts)) * self.scale[term].astype(np.float64)
        weight = (weight / np.sqrt(np.bincount(row, weight**2, minlength=n))[row]).astype(np.float32)

        def top(of: np.ndarray, least: float) -> np.ndarray:
            found = np.full(n, -1)
            by = np.lexsort((term, of))
            by = by[of[by] >= least]
            found[row[by]] = term[by]
            return found

        common = df >= max(2, n * COMMON)
        order = np.lexsort((ids, sizes, top(np.where(common[term], counts, 0), 1), top(sure[term], 0.25)))
        new = np.empty(n, np.int64)
        new[order] = np.arange(n)
        self.ids, self.y = ids[order], y[order].astype(float)
        by = np.lexsort((new[row], term))
        at, self.weight = new[row][by], weight[by]
        cell = term[by] * (n // BLOCK + 1) + at // BLOCK
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        self.offset, self.size = (at % BLOCK).astype(np.uint8), np.diff(np.append(starts, len(cell))).astype(np.uint16)
        self.block = (at[starts] // BLOCK).astype(np.int32)
        self.cells = np.bincount(term[by][starts], minlength=len(self.vocabulary)).astype(np.int32)
        self.common = np.flatnonzero(common)
        self.a, self.b, self.shared = 1.0, 0.0, None
        self._open()

    def _open(self) -> None:
        """What searches use, from what is sent to executors."""
        self.blocks = -(-len(self.ids) // BLOCK)
        self.place = {t: i for i, t in enumerate(self.vocabulary)}
        self.starts = np.append(0, np.cumsum(self.size, dtype=np.int64))
        self.first = np.append(0, np.cumsum(self.cells, dtype=np.int64))
        self.most = np.maximum.reduceat(self.weight, self.starts[:-1]) if len(self.size) else np.zeros(0, np.float32)
        self.wide = np.full(len(self.vocabulary), -1)
        self.wide[self.common] = np.arange(len(self.common))
        self.full = np.zeros((self.blocks * BLOCK, len(self.common)), np.float32)
        posting_term = np.repeat(np.arange(len(self.vocabulary)), self.starts[self.first[1:]] - self.starts[self.first[:-1]])
        posting_row = np.repeat(self.block.astype(np.int64) * BLOCK, self.size) + self.offset
        wide = np.flatnonzero(self.wide[posting_term] >= 0)
        self.full[posting_row[wide], self.wide[posting_term[wide]]] = self.weight[wide]
        self.widest = self.full.reshape(self.blocks, BLOCK, len(self.common)).max(1, initial=0)
        telling = np.flatnonzero((self.sure > 0).any(0)[posting_term])
        telling = telling[np.argsort(posting_row[telling], kind="stable")]
        self.told_at = np.searchsorted(posting_row[telling], np.arange(self.blocks * BLOCK + 1))
        self.told_term, self.told_weight = posting_term[telling], self.weight[telling].astype(np.float64)
        self.asked = np.zeros(len(self.vocabulary))

    def __getstate__(self) -> dict:
        names = "scale sure base ids y weight offset size block cells common a b".split()
        return {k: getattr(self, k) for k in names} | {"vocabulary": zlib.compress(pickle.dumps(self.vocabulary), 1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"vocabulary": pickle.loads(zlib.decompress(state["vocabulary"])), "shared": None}
        self._open()

    def vector(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text's words, those of the examples only."""
        count = Counter(map(self.place.get, found))
        count.pop(None, None)
        term = np.fromiter(count.keys(), np.int64, len(count))
        weight = (1 + np.log(np.fromiter(count.values(), np.float64, len(count)))) * self.scale[term].astype(np.float64)
        return term, (weight / (np.sqrt(weight @ weight) or 1.0)).astype(np.float32).astype(np.float64)

    def dense(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The common terms' weights of each vector."""
        out = np.zeros((len(vectors), len(self.common)))
        for i, (term, weight) in enumerate(vectors):
            wide = self.wide[term]
            out[i, wide[wide >= 0]] = weight[wide >= 0]
        return out

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = K, without: int | None = None, dense: np.ndarray | None = None, about: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the k nearest examples that share a term, nearest first. without: an id to leave out.

        dense and about: what dense() gives, and its products with all examples in single precision.
        """
        dense = self.dense([(term, weight)])[0] if dense is None else dense
        about = self.full @ dense.astype(np.float32) if about is None else about  # to choose whose sum is taken in double
        rare = self.wide[term] < 0
        term, weight = term[rare], weight[rare]
        sizes = self.first[term + 1] - self.first[term]
        cells, weights = _ranges(self.first[term], sizes), np.repeat(weight, sizes)
        block = self.block[cells]
        bound = np.bincount(block, weights * self.most[cells], minlength=self.blocks) + self.widest @ dense
        order = np.argsort(-bound, kind="stable")
        rows, sims, least, at, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 16
        while at < self.blocks and bound[order[at]] > 0 and not (len(rows) == k and bound[order[at]] < least - 1e-9):
            visited = order[at : at + step]
            at, step = at + step, step * 2
            if len(rows) == k:
                visited = visited[bound[visited] >= least - 1e-9]
            place = np.full(self.blocks, -1)
            place[visited] = np.arange(len(visited))
            here = np.flatnonzero(place[block] >= 0)
            some = cells[here]
            sizes = self.starts[some + 1] - self.starts[some]
            postings = _ranges(self.starts[some], sizes)
            score = np.bincount(np.repeat(place[block[here]] * BLOCK, sizes) + self.offset[postings], self.weight[postings] * np.repeat(weights[here], sizes), minlength=len(visited) * BLOCK)
            near = score + about.reshape(-1, BLOCK)[visited].ravel()
            new = np.flatnonzero(near > max(0.0, least - 1e-5))
            if len(new) > k + 1:
                new = new[near[new] >= np.partition(near[new], len(new) - k - 1)[len(new) - k - 1] - 1e-5]  # one more, if one is left out
            found = visited[new // BLOCK] * BLOCK + new % BLOCK
            if without is not None:
                new, found = (x[self.ids[found] != without] for x in (new, found))
            rows, sims = np.concatenate([rows, found]), np.concatenate([sims, score[new] + self.full[found].astype(np.float64) @ dense])
            best = np.lexsort((self.ids[rows], -sims.round(9)))[:k]
            rows, sims = rows[best], sims[best]
            least = sims[-1] if len(rows) == k else 0.0
        return rows, sims

    def vote(self, term: np.ndarray, weight: np.ndarray, rows: np.ndarray, sims: np.ndarray, without: int | None = None) -> float:
        """Between -1 and 1; neighbours that share no telling word, and far ones, pull it towards 0.

        without: an example's id, whose fold's labels say nothing of words.
        """
        sure = self.sure[0 if without is None else 1 + zlib.crc32(str(without).encode()) % FOLDS]
        self.asked[term] = weight * sure[term]
        sizes = self.told_at[rows + 1] - self.told_at[rows]
        at = _ranges(self.told_at[rows], sizes)
        telling = np.bincount(np.repeat(np.arange(len(rows)), sizes), self.told_weight[at] * self.asked[self.told_term[at]], minlength=len(rows))
        self.asked[term] = 0
        near = (telling + EVEN) / (1.001 - np.minimum(sims, 1.0))
        return float((near * (2 * self.y[rows] - 1)).sum() / (near.sum() + DOUBT))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The curve from the votes x to the labels y, by Newton's method with a weak pull towards a = 4, b = 0."""
        y, a, b = y * (1 - 2e-3) + 1e-3, 4.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([((p - y) * x).sum() + 0.5 * (a - 4), (p - y).sum() + 0.5 * b])
            s = p * (1 - p)
            h = np.array([[(s * x * x).sum() + 0.5, (s * x).sum()], [(s * x).sum(), s.sum() + 0.5]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        self.a, self.b = max(float(a), 0.0), float(b)

    def scores(self, texts: list[str | None], told: dict | None = None) -> list[tuple[float, list[int], list[float]]]:
        """The score of each text, and as evidence the neighbours' ids and similarities. told: what exact copies were told before."""
        told = {} if told is None else told
        if len(told) > 10_000:
            told.clear()
        keys = [hashlib.blake2b((t or "").encode("utf-8", "replace"), digest_size=16).digest() for t in texts]
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in told}
        asked = [(k, *self.vector(words(t))) for k, t in new.items()]
        for at in range(0, len(asked), TOGETHER):
            some = asked[at : at + TOGETHER]
            dense = self.dense([(t, w) for _, t, w in some])
            about = dense.astype(np.float32) @ self.full.T
            for i, (k, term, weight) in enumerate(some):
                if not len(term):
                    told[k] = self.base, [], []
                    continue
                rows, sims = self.nearest(term, weight, dense=dense[i], about=about[i])
                p = 1 / (1 + np.exp(-np.clip(self.a * self.vote(term, weight, rows, sims) + self.b, -30, 30)))
                told[k] = float(p), self.ids[rows[:EVIDENCE]].tolist(), sims[:EVIDENCE].tolist()
        return [told[k] for k in keys]

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        return self.scores([text])[0]


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, limit: int = MAX_EXAMPLES) -> Index:
    """docs: doc_id (an integer), text; labels: doc_id, toxic."""
    sample = written(labelled(docs, labels, "toxic", may_learn, limit, ["text"]), "toxic-labelled")

    def sign(batches):
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([signature(t).tolist() for t in b.column("text").to_pylist()], pa.list_(pa.int64()))], ["id", "own"])

    signed = sorted(map(tuple, sample.mapInArrow(sign, "id long, own array<long>").collect()))  # at most limit rows
    kept = docs.sparkSession.createDataFrame([(i,) for i in apart(signed)], "doc_id long")
    sample = written(sample.join(F.broadcast(kept), "doc_id"), "toxic-examples")

    def count(batches):
        for b in small(batches):
            found = [Counter(words(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("_label").cast(pa.int32()), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["id", "y", "terms", "counts"])

    rows = sample.mapInArrow(count, "id long, y int, terms array<binary>, counts array<int>").toArrow()  # at most limit rows
    rows = rows.sort_by("id").combine_chunks()
    terms, counts = (rows[c].combine_chunks() if rows.num_rows else pa.array([], pa.list_(t)) for c, t in (("terms", pa.binary()), ("counts", pa.int32())))
    index = Index(np.asarray(rows["id"], np.int64), (np.asarray(rows["y"]) > 0).astype(np.int64), np.diff(np.asarray(terms.offsets)), terms.flatten(), np.asarray(counts.flatten(), np.float64))
    if not len(index.ids):
        return index

    index.shared = shared = docs.sparkSession.sparkContext.broadcast(index)  # of at most limit examples

    def votes(batches):
        index = shared.value
        for b in small(batches):
            ids = b.column("doc_id").cast(pa.int64()).to_pylist()
            vectors = [index.vector(words(t)) for t in b.column("text").to_pylist()]
            x = [index.vote(*v, *index.nearest(*v, without=i), without=i) for i, v in zip(ids, vectors, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column("_label").cast(pa.float64())], ["x", "y"])

    told = sample.mapInArrow(votes, "x double, y double").toArrow()
    order = np.lexsort((np.asarray(told["y"]), np.asarray(told["x"])))  # sums in one order whatever the partitions
    index.calibrate(np.asarray(told["x"])[order], (np.asarray(told["y"])[order] > 0).astype(float))
    return index


def scored(docs: DataFrame, index: Index, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all by default), score, and the evidence: ids and similarities of the nearest examples."""
    keep = keep or docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", _score double, _near array<long>, _similar array<double>"

    shared, curve = index.shared or docs.sparkSession.sparkContext.broadcast(index), (index.a, index.b)

    def run(batches):
        index = shared.value
        (index.a, index.b), told = curve, {}
        for b in small(batches):
            done = index.scores(b.column("_text").to_pylist(), told)
            columns = [pa.array([d[0] for d in done], pa.float64()), pa.array([d[1] for d in done], pa.list_(pa.int64())), pa.array([d[2] for d in done], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *columns], [*keep, "_score", "_near", "_similar"])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    index = fit(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    rows = scored(docs, index, ["doc_id"])
    return rows.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_near").alias("nearest_ids"), F.col("_similar").alias("similarities"))
