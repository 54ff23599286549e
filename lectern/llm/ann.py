"""Approximate nearest neighbours: p-stable hashing with several probes a table, and exact reranking.

Vectors are scaled to length one, where the largest cosine is the smallest Euclidean distance, and hashed into
TABLES tables of quantised projections. A query visits its own bucket and perturbed ones in the order of their
estimated success: by the sum of squared distances to the walls crossed, generated from a heap.

A table has PROJECTIONS projections, and more beyond MANY vectors, by the logarithm of their number. How many buckets
of each a query visits is fitted: SAMPLE_QUERIES queries are compared with every vector, and the fewest probes are
taken that would have reached RECALL of their nearest. Every vector is indexed.

A query visits its likeliest buckets of a few tables first. The similarity of the K-th nearest that it meets there is
its bar: below it nothing can be among the K nearest, so that a query gives a bounded number of candidates however
many cells it visits. Then it visits the others. Buckets are dealt to cells of about CELL entries; a larger bucket is
split over several. A cell holds its vectors in half precision once, and each query once that probes one of its
buckets. What may be among the K nearest, with a margin for the precision, is then compared exactly, on the original vectors.

Of equal vectors only the K + 1 with the smallest ids are indexed, as no query can have another of them.

A query that has met fewer than K vectors by then, as in tiny tables, is hashed again with half as many projections, and so
on down to one: nothing is ever compared but what shares a visited bucket.

Defined cases: vectors that are null, empty, zero, or hold null, NaN or infinite components take no part and a
query of that kind has no rows; vectors of different dimensions are no candidates for each other; ties go to the
smaller id; rows of one id are candidates each, and queries each with ranks of their own; rows without an id take
no part; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped, lookup, parts, written
from .pstable import Projections, by_dimension, takes_part, unit

TABLES, WIDTH, K, CELL = 32, 3.0, 5, 8192
PROJECTIONS, MANY, MOST_PROBES = 16, 100_000, 128
RECALL, SAMPLE_QUERIES = 0.935, 128
#: Tables and their buckets that a query visits first.
FIRST_TABLES, FIRST_PROBES = 8, 4
#: More than twice the error of a cosine of which one vector is in half precision.
MARGIN = 2e-3


def perturbations(fractions: np.ndarray, n: int) -> list[tuple[tuple[int, int], ...]]:
    """The n most promising sets of steps (projection, -1 or 1), the empty one first."""
    return [steps for _, steps in ranked(fractions, n)]


def ranked(fractions: np.ndarray, n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """perturbations() with their costs."""
    walls = sorted([(f * f, i, -1) for i, f in enumerate(fractions.tolist())] + [((1 - f) ** 2, i, 1) for i, f in enumerate(fractions.tolist())])
    costs, steps = [w[0] for w in walls], [w[1:] for w in walls]
    out: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    heap = [(costs[0], (0,))]
    while heap and len(out) < n:
        cost, chosen = heapq.heappop(heap)
        if len({steps[c][0] for c in chosen}) == len(chosen):
            out.append((cost, tuple(steps[c] for c in chosen)))
        last = chosen[-1]
        if last + 1 < len(walls):
            heapq.heappush(heap, (cost + costs[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (cost - costs[last] + costs[last + 1], (*chosen[:-1], last + 1)))
    return out


def needed(queries: np.ndarray, others: list[np.ndarray]) -> list[np.ndarray]:
    """Probes of each table after which a query meets each of its others; MOST_PROBES + 1 for more.

    queries: positions (n x tables x projections); others: for each query the positions of its others.
    """
    out = []
    for at, there in zip(queries, others, strict=True):
        fractions = at - np.floor(at)
        steps = np.floor(there) - np.floor(at)
        cost = np.where(steps == 0, 0, np.where(steps == -1, fractions**2, np.where(steps == 1, (1 - fractions) ** 2, np.inf))).sum(2)
        least = np.full(len(there), MOST_PROBES + 1)
        for t in range(len(at)):
            known = np.array([c for c, _ in ranked(fractions[t], MOST_PROBES)])
            first = np.searchsorted(known, cost[:, t] - 1e-12) + 1
            least = np.minimum(least, np.where(cost[:, t] <= known[-1] + 1e-12, first, MOST_PROBES + 1))
        out.append(least)
    return out


def projections_for(total: int) -> int:
    """So that the share of the vectors in a bucket falls as their number grows."""
    return PROJECTIONS + max(0, math.floor(2 * math.log2(max(total, 1) / MANY)))


def fitted(queries: np.ndarray, nearest: list[np.ndarray], projections: int) -> tuple[int, int]:
    """Projections and probes. queries: unit rows; nearest: those of each. Fewer projections if MOST_PROBES don't do."""
    while projections > 4:
        p = Projections(queries.shape[1], TABLES, projections, WIDTH)
        found = np.concatenate(needed(p.positions(queries), [p.positions(n) for n in nearest]))
        for probes in range(1, MOST_PROBES + 1):
            if (found <= probes).mean() >= RECALL:
                return projections, probes
        projections -= 4
    return projections, MOST_PROBES


_FOUND = pa.schema([("query", pa.int64()), ("uid", pa.int64()), ("about", pa.float32())])


def _best(scores: np.ndarray, uids: np.ndarray, own: int, k: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of what may be among the k largest of an array, at or above the bar, without own."""
    at = np.flatnonzero((scores >= bar - MARGIN) & (uids != own))
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k] - MARGIN]
    return at, scores[at]


def _batch(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    flat = [np.concatenate(x) if found else [] for x in ([np.full(len(u), q) for q, u, _ in found], [u for _, u, _ in found], [s for _, _, s in found])]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(flat, _FOUND, strict=True)], schema=_FOUND)


def _against(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """What may be among the k nearest of few queries (uid, vector), which go to every task, in every partition of rows."""
    asked = [(uid, unit(np.array([v]))[0]) for uid, v in queries]

    def compare(batches):
        for b in batches:
            uids, out = np.asarray(b.column("uid")), []
            for dim, at, m in by_dimension(b.column("vector")):
                own = [(q, v) for q, v in asked if len(v) == dim]
                scores = unit(m) @ np.array([v for _, v in own]).T if own else np.zeros((len(m), 0))
                for i, (q, _) in enumerate(own):
                    near, s = _best(scores[:, i], uids[at], q, k)
                    out.append((q, uids[at][near], s))
            yield _batch(out)

    return rows.select("uid", "vector").mapInArrow(compare, "query long, uid long, about float")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """Of what was found by query, each vector once, those that may be among the k nearest."""
    found = found.groupBy("query", "uid").agg(F.max("about").alias("about"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("about"), "uid"))
    least = F.min(F.when(F.col("_rank") <= k, F.col("about"))).over(Window.partitionBy("query"))
    return found.withColumn("_rank", rank).withColumn("_least", least).where(F.col("about") >= F.col("_least") - MARGIN).select("query", "uid")


def _fit(rows: DataFrame, k: int, total: int) -> tuple[int, int]:
    queries = [(r["uid"], r["vector"]) for r in rows.where("is_query").orderBy(F.xxhash64("uid", F.lit(1)), "uid").select("uid", "vector").limit(SAMPLE_QUERIES).collect()]
    if not queries or total < 3:
        return PROJECTIONS, 1
    near = written(_nearest(_against(rows, queries, k), k), "ann-sample")
    near = near.join(rows.select("uid", "vector"), "uid").select("query", "vector").collect()  # of SAMPLE_QUERIES queries
    dims = [len(v) for _, v in queries]
    dim = max(set(dims), key=lambda d: (dims.count(d), d))
    own = []
    for q, v in queries:
        told = [r["vector"] for r in near if r["query"] == q]
        if len(v) == dim and len(told) >= min(k, total - 1):
            told, asked = unit(np.array(told)), unit(np.array([v]))[0]
            own.append((asked, told[np.argsort(-(told @ asked), kind="stable")[:k]]))
    return fitted(np.array([q for q, _ in own]), [n for _, n in own], projections_for(total)) if own else (PROJECTIONS, MOST_PROBES)


def _index(batches, projections: int):
    """(tab, bucket, uid, half): a row for each vector and table."""
    made: dict[int, Projections] = {}
    for b in batches:
        for dim, at, rows in by_dimension(b.column("vector")):
            p = made.setdefault(dim, Projections(dim, TABLES, projections, WIDTH))
            for some in range(0, len(at), 256):
                units = unit(rows[some : some + 256])
                buckets = p.buckets(p.positions(units))
                half = pa.array([v.tobytes() for v in units.astype("<f2")], pa.binary())
                take = pa.array(np.repeat(np.arange(len(units)), TABLES), pa.int64())
                tab = pa.array(np.tile(np.arange(TABLES, dtype=np.int8), len(units)))
                yield pa.RecordBatch.from_arrays([tab, pa.array(buckets.ravel(), pa.int64()), b.column("uid").take(pa.array(at[some : some + 256], pa.int64())).take(take), half.take(take)], ["tab", "bucket", "uid", "half"])


def _probes(batches, projections: int, probes: int):
    """(bucket, uid, first): a row for each bucket that a query visits, and whether it is one of the first."""
    made: dict[int, Projections] = {}
    for b in batches:
        uids = np.asarray(b.column("uid"))
        for dim, at, rows in by_dimension(b.column("vector")):
            p = made.setdefault(dim, Projections(dim, TABLES, projections, WIDTH))
            positions = p.positions(unit(rows))
            buckets = p.buckets(positions)
            fractions = positions - np.floor(positions)
            for i, row in enumerate(at):
                moved, first = [], []
                for t in range(TABLES):
                    odd, own = p.odd[t].tolist(), int(buckets[i, t])
                    moved += [own + sum(odd[j] * s for j, s in steps) for steps in perturbations(fractions[i, t], probes)]
                    first += [t < FIRST_TABLES and n < FIRST_PROBES for n in range(len(moved) - len(first))]
                names = np.array([(x + (1 << 63)) % (1 << 64) - (1 << 63) for x in moved], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), uids[row])), pa.array(first)], ["bucket", "uid", "first"])


def _short(queries: DataFrame, found: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The queries that have met fewer than k vectors, though there are more of their dimension."""
    sizes = written(rows.groupBy(F.size("vector").alias("dim")).agg((F.count("*") - 1).alias("others")), "ann-dimensions")
    met = found.groupBy("query").agg(F.count_distinct("uid").alias("n")).withColumnRenamed("query", "uid")
    asking = lookup(queries.withColumn("dim", F.size("vector")), sizes, ["dim"]).join(met, "uid", "left")
    return written(asking.where(F.coalesce("n", F.lit(0)) < F.least("others", F.lit(k))).select("uid", "vector"), "ann-short")


def _visited(rows: DataFrame, queries: DataFrame, projections: int, probes: int, k: int, total: int) -> DataFrame:
    """(query, uid, about) of what may be among the k nearest that share a visited bucket with a query."""
    cells = max(1, math.ceil(total * TABLES / CELL))
    index = written(rows.select("uid", "vector").mapInArrow(lambda b: _index(b, projections), "tab byte, bucket long, uid long, half binary"), "ann-index")
    sizes = written(index.groupBy("bucket").agg(F.ceil(F.count("*") / CELL).cast("int").alias("pieces")), "ann-buckets")
    split = written(sizes.where("pieces > 1"), "ann-split")
    part = F.pmod(F.xxhash64("bucket"), F.lit(cells)).cast("int")
    held = lookup(index, split, ["bucket"], "left").withColumn("cell", part)
    held = held.withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("uid"), F.col("pieces"))).cast("int"))
    probed = lookup(queries.mapInArrow(lambda b: _probes(b, projections, probes), "bucket long, uid long, first boolean"), sizes, ["bucket"])
    probed = probed.withColumn("cell", part).withColumn("piece", F.explode(F.when(F.col("pieces") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("pieces")))))
    probed = written(probed.select("cell", "piece", "bucket", "uid", "first"), "ann-probes")

    first = written(_compared(held.where(F.col("tab") < FIRST_TABLES), probed.where("first"), queries.withColumn("bar", F.lit(float("-inf")).cast("float")), cells, k), "ann-first")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("bar"), "found"))
    bar = first.groupBy(F.col("query").alias("uid"), F.col("uid").alias("found")).agg(F.max("about").alias("bar"))
    bar = bar.withColumn("_rank", rank).where(F.col("_rank") == k).select("uid", "bar")
    least = F.coalesce("bar", F.lit(float("-inf"))).cast("float").alias("bar")
    barred = written(queries.join(bar, "uid", "left").select("uid", "vector", least), "ann-bars")
    return first.unionByName(written(_compared(held, probed.where("not first"), barred, cells, k), "ann-found"))


def _compared(held: DataFrame, probed: DataFrame, queries: DataFrame, cells: int, k: int) -> DataFrame:
    """(query, uid, about) of the k nearest above a query's bar in each cell. queries: uid, vector, bar."""
    visits = probed.select("cell", "piece", "uid").distinct().join(queries, "uid")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("half", "binary"), ("vector", "array<double>"), ("bar", "float"))]
    all_ = held.select("cell", "piece", F.lit(0).alias("kind"), "bucket", "uid", "half", *none[1:])
    all_ = all_.unionByName(visits.select("cell", "piece", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("bucket"), "uid", none[0], "vector", "bar"))
    all_ = all_.unionByName(probed.select("cell", "piece", F.lit(2).alias("kind"), "bucket", "uid", *none))
    all_ = all_.repartition(max(parts(held.sparkSession), cells // 8), "cell", "piece").sortWithinPartitions("cell", "piece", "kind", "bucket", "uid")

    def visit(batches):
        for t in grouped(batches, ["cell", "piece"]):
            kind, bucket, uids = (np.asarray(t[c].combine_chunks()) for c in ("kind", "bucket", "uid"))
            a, z = np.searchsorted(kind, [1, 2])
            order = np.argsort(uids[z:], kind="stable")  # probes by query
            wanted, asking = bucket[z:][order], uids[z:][order]
            halves = t["half"].combine_chunks().slice(0, int(a))
            sizes = np.asarray(pc.binary_length(halves), np.int64) // 2
            least = np.asarray(t["bar"].combine_chunks().slice(int(a), int(z - a)))
            out = []
            for dim, at, asked in by_dimension(t["vector"].combine_chunks().slice(int(a), int(z - a))):
                own = np.flatnonzero(sizes == dim)
                if not len(own):
                    continue
                there = bucket[own]
                names, first, local = np.unique(uids[own], return_index=True, return_inverse=True)
                units = np.frombuffer(b"".join(halves.take(pa.array(own[first])).to_pylist()), "<f2").reshape(-1, dim).astype(np.float32)
                asked = unit(asked).astype(np.float32)
                for i, row in enumerate(at):
                    q = int(uids[a + row])
                    b = wanted[slice(*np.searchsorted(asking, [q, q + 1]))]
                    starts, ends = np.searchsorted(there, b), np.searchsorted(there, b, "right")
                    sizes_ = ends - starts
                    met = np.zeros(len(names), bool)
                    met[local[np.repeat(starts - np.cumsum(sizes_) + sizes_, sizes_) + np.arange(sizes_.sum())]] = True
                    met = np.flatnonzero(met)
                    near, s = _best(units[met] @ asked[i], names[met], q, k, least[row])
                    out.append((q, names[met][near], s))
            yield _batch(out)

    return all_.mapInArrow(visit, "query long, uid long, about float")


def search(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, choice: tuple[int, int] | None = None) -> DataFrame:
    """query_id, rank from 1, vec_id and score, the cosine, of the k nearest found for each query.

    choice: projections and probes, fitted if not given.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = written(rows.where(F.col("id").isNotNull() & takes_part(F.col("vector"))).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    queries = rows.where("is_query").select("uid", "vector")
    total = rows.count()
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("id", "uid"))
    indexed = written(rows.select("uid", "id", "vector").withColumn("_copy", copy).where(F.col("_copy") <= k + 1).select("uid", "vector"), "ann-indexed")
    projections, probes = choice or _fit(rows, k, total)
    found, asking = None, queries
    while True:
        more = _visited(indexed, asking, projections, probes, k, total)
        found = more if found is None else found.unionByName(more)
        if projections == 1:
            break
        asking = _short(queries, found, rows, k)
        if asking.isEmpty():
            break
        projections, probes = projections // 2, MOST_PROBES
    near = _nearest(found, k)
    near = near.join(rows.select("uid", F.col("id").alias("vec_id"), F.col("vector").alias("v")), "uid")
    near = near.join(queries.select(F.col("uid").alias("query"), F.col("vector").alias("q")), "query")
    near = near.join(rows.where("is_query").select(F.col("uid").alias("query"), F.col("id").alias("query_id")), "query")

    def score(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for _, at, v in by_dimension(b.column("v")):
                q = next(m for _, _, m in by_dimension(b.column("q").take(pa.array(at, pa.int64()))))
                v, q = (np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) for x in (v, q))  # exact, and no square overflows
                out[at] = np.clip((v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum(1))), -1, 1)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("query", "query_id", "uid", "vec_id")] + [pa.array(out)], ["query", "query_id", "uid", "vec_id", "score"])

    told = near.select("query", "query_id", "uid", "vec_id", "v", "q").mapInArrow(score, "query long, query_id long, uid long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", 14)), "vec_id", "uid")
    return told.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
