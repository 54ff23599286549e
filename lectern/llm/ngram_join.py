"""Near-duplicate documents: a similarity join on n-gram sets by MinHash banding, verified on the full sets.

A document's set holds the hashes of its runs of N lower-case words between white space; a shorter text's set
holds the run of all its words. Two documents are linked if the Jaccard similarity of their sets is THRESHOLD or
more. How many bands of how many rows are used follows from the recall aimed at (see bands()).

1. Documents of equal words form a class; from here on classes count once, however many copies there are.
2. Each class has a MinHash signature; its band hashes are shuffled. Bands whose buckets hold the same classes
   are one bucket. Within a bucket the signatures are compared, and a spanning forest of the pairs estimated
   NEARLY or more similar goes on. A bucket of more than BUCKET_BLOCK classes is dealt to pairs of blocks, each a task's
   work of its own, so nothing goes on uncompared and no task holds a large bucket.
3. Connected classes form candidate groups. Every pair within a group is verified on the full sets, by sparse
   set operations or matrix products in blocks of at most BLOCK classes and SET_BLOCK n-grams. Links are counted
   and a spanning forest is kept; no pair becomes a row.
4. Components of the forests are the groups of near duplicates.

The large joins are merge joins at every size, so that plans don't change between a small and a large corpus.

A link is missed only if no band agrees or the estimate falls below NEARLY: for a pair at the threshold less
than one in 30,000, less for nearer ones.

Defined cases: texts that are null, empty or blank have no n-grams, link with nothing and stay; equal rows are
documents each; documents with a null id are linked like others and are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEMI_ROWS, Forest, grouped, halves, lookup, only, parts, small, weighted_lookup, written
from .components import components

N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.99998, 5
NEARLY, BUCKET_BLOCK, BLOCK, SET_BLOCK = 0.65, 256, 512, 300_000


def bands(threshold: float, recall: float, rows: int) -> int:
    """Fewest bands of so many rows that find a pair at the threshold with the probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(words: list[bytes], n: int = N) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of n words, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) | np.fromiter(map(zlib.adler32, words), np.uint64, len(words)) << np.uint64(32)
    size = max(1, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(min(n, len(words))):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + size]
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    return np.unique(out)


def split(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def class_key(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


class MinHash:
    def __init__(self, size: int):
        rng = np.random.default_rng(5)
        self.a = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, np.uint64)

    def __call__(self, hashes: np.ndarray) -> bytes:
        """The upper 32 bits of each minimum."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max)
        for at in range(0, len(hashes), 256):
            least = np.minimum(least, (hashes[at : at + 256, None] * self.a + self.b).min(0))
        return (least >> np.uint64(32)).astype("<u4").tobytes()


def alike(sets: list[np.ndarray], tags: np.ndarray, threshold: float):
    """(rows, columns, matrix of linked pairs) over sets; between the two tags if there are two, else within."""
    left, right = (np.arange(len(sets)),) * 2 if (one := tags.min() == tags.max()) else (np.flatnonzero(tags == tags.min()), np.flatnonzero(tags == tags.max()))
    sizes = np.array([len(s) for s in sets], np.float64)
    both = np.zeros((len(left), len(right)))
    if len(left) * len(right) <= 64:
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                if not one or i < j:
                    x, y = (a, b) if len(sets[a]) <= len(sets[b]) else (b, a)
                    at = np.searchsorted(sets[y], sets[x])
                    both[i, j] = (sets[y][np.minimum(at, len(sets[y]) - 1)] == sets[x]).sum()
        if one:
            both += both.T
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes.astype(int))
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times > 1  # an n-gram of one set alone is in no intersection
        number = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 2048
        for at in range(0, int(shared.sum()), width):
            a, z = np.searchsorted(column, [at, at + width])
            dense = np.zeros((len(sets), width), np.float32)
            dense[owner[a:z], column[a:z] - at] = 1
            both += dense[left] @ dense[right].T
    near = both >= threshold * (sizes[left][:, None] + sizes[right] - both) - 1e-9
    if one:
        np.fill_diagonal(near, False)
    return left, right, near


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """For each document: its id, class_id, n_links, component_id and kept.

    class_id is the smallest id of the documents with the same words; n_links the number of other documents
    linked directly; component_id the smallest id reachable by links; kept whether it is the document's own.
    """
    return _marked(docs, id_column, text_column, n, threshold, recall, rows).drop("_h")


def _marked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """near_duplicates() with _h, the hash of the text, as ids may be null or reused."""
    id_type = docs.schema[id_column].dataType.simpleString()
    count = bands(threshold, recall, rows)
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("h"))

    def sign(batches):
        minhash = MinHash(count * rows)
        for b in small(batches):
            keys, signatures, sizes = [], [], []
            for t in b.column("text").to_pylist():
                words = split(t)
                s = shingles(words, n)
                keys.append(class_key(words))
                signatures.append(minhash(s) if words else None)
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int32())], ["id", "h", "key", "signature", "n"])

    signed = written(docs.mapInArrow(sign, f"id {id_type}, h long, key binary, signature binary, n int"), "signatures")
    classes = signed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("bare"), "id", "h"))["h"].alias("h"), F.count("*").alias("copies"), F.any_value("signature").alias("signature"), F.any_value("n").alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    band = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * 4 * rows + 1, F.lit(4 * rows))))
    banded = classes.select("node", F.explode(band).alias("bucket"))
    mix = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("first"), *mix).where("size > 1")
    buckets = written(buckets.groupBy("size", "first", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "size", "first"), "buckets")
    members = written(banded.join(buckets.hint("merge"), "bucket"), "members")

    def estimate(batches):
        for t in grouped(batches, ["bucket", "lo", "hi"]):
            node, tags, k = np.asarray(t["node"].combine_chunks()), np.asarray(t["own"].combine_chunks()), t.num_rows
            s = np.frombuffer(b"".join(t["signature"].to_pylist()), "<u4").reshape(k, -1)
            forest, least = Forest(k), NEARLY * s.shape[1]
            left, right = np.flatnonzero(tags == t["lo"][0].as_py()), np.flatnonzero(tags == t["hi"][0].as_py())
            for at in range(0, len(left) if len(right) else 0, 64):
                some = left[at : at + 64]
                forest.join_all((some, right, (s[some, None, :] == s[None, right, :]).sum(2) >= least))
            pairs = [(int(node[i]), int(node[forest.root(i)])) for i in range(k) if forest.root(i) != i]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    compared = halves(members.withColumn("blocks", F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")), "node", "blocks").select("bucket", "lo", "hi", "own", "node")
    compared = compared.join(classes.select("node", "signature").hint("merge"), "node")
    compared = compared.repartition(parts(docs.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(estimate, "u long, v long")
    groups = written(components(compared).withColumnRenamed("component", "group"), "groups")

    sized = classes.select("node", "key", "rep", "h", "copies", "n").join(groups.hint("merge"), "node")
    totals = sized.groupBy("group").agg(F.count("*").alias("classes"), F.sum(F.col("n").cast("long")).alias("grams"))
    totals = written(totals.select("group", F.greatest(F.ceil(F.col("classes") / BLOCK), F.ceil(F.col("grams") / SET_BLOCK)).cast("int").alias("blocks")), "group-sizes")
    wanted = written(lookup(sized, totals, ["group"]), "candidates")

    def sets(batches):
        for b in small(batches):
            keep, found = [], []
            for i, (text, key) in enumerate(zip(b.column("text").to_pylist(), b.column("key").to_pylist(), strict=True)):
                words = split(text)
                if class_key(words) == key:  # another text may have the same hash
                    keep.append(i)
                    found.append(shingles(words, n).tobytes())
            b = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("group"), b.column("blocks"), b.column("copies"), pa.array(found, pa.binary())], ["node", "group", "blocks", "copies", "grams"])

    wanted = wanted.select(F.col("rep").alias("id"), "h", "node", "group", "blocks", "copies", "key")
    named, bare = wanted.where("id is not null"), wanted.where("id is null").drop("id")
    texts = only(docs, named, "id").join(named.hint("merge"), ["id", "h"]).drop("id")
    if not bare.isEmpty():  # classes without any id: each text once
        texts = texts.unionByName(docs.where("id is null").select("h", "text").distinct().join(bare.hint("merge"), "h"))
    texts = texts.mapInArrow(sets, "node long, group long, blocks int, copies long, grams binary")
    cells = halves(texts, "node", "blocks")
    cells = cells.repartition(parts(docs.sparkSession), "group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "node")

    def verify(batches):
        for t in grouped(batches, ["group", "lo", "hi"]):
            node, tags, copies = (np.asarray(t[c].combine_chunks()) for c in ("node", "own", "copies"))
            _, single = np.unique(node, return_index=True)  # repeated rows
            grams = t["grams"].combine_chunks()
            sets_ = [np.frombuffer(grams[int(i)].as_py(), np.uint64) for i in single]
            node, tags, copies = node[single], tags[single], copies[single]
            if t["lo"][0] != t["hi"][0] and tags.min() == tags.max():
                continue
            left, right, near = alike(sets_, tags, threshold)
            forest, links = Forest(len(node)), np.zeros(len(node), np.int64)
            forest.join_all((left, right, near))
            links[left] += near @ copies[right]
            if len(left) < len(node):
                links[right] += near.T @ copies[left]
            roots = [int(node[forest.root(i)]) for i in range(len(node))]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(roots, pa.int64()), pa.array(links, pa.int64()), pa.array(np.full(len(node), int(t["blocks"][0].as_py())), pa.int32())], ["node", "root", "links", "blocks"])

    verified = written(cells.mapInArrow(verify, "node long, root long, links long, blocks int"), "verified")
    several = components(verified.where("blocks > 1").select(F.col("node").alias("u"), F.col("root").alias("v")))
    found = verified.where("blocks = 1").select("node", F.col("root").alias("component")).unionByName(several)
    links = verified.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0")
    joined = classes.select("node", "key", "rep", "copies").join(links, "node", "left").join(found, "node", "left")
    joined = joined.withColumn("component", F.coalesce("component", "node"))
    least = written(joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("of")), "component-ids")
    labelled = written(weighted_lookup(joined, least, ["component"], "of").select("key", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), "linked-classes")
    bare = signed.select("id", "h", "key")
    linked = weighted_lookup(bare.where("key is not null"), labelled, ["key"], "copies").select("id", "h", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = bare.where("key is null").select("id", "h", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_column), "class_id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("h").alias("_h"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that are not kept; of repeated rows of one id with the same text one stays."""
    marks = written(_marked(docs, **options), "near-duplicates")
    gone = written(marks.where("not kept").select("doc_id", "_h").distinct(), "not-kept")  # ids may be reused
    gone = F.broadcast(gone) if gone.count() <= SEMI_ROWS else gone.hint("merge")
    out = docs.withColumn("_h", F.xxhash64(options.get("text_column", "text"))).join(gone, ["doc_id", "_h"], "left_anti").select(*docs.columns)
    again = written(marks.where("kept and doc_id is not null and n_links > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.count():
        repeated = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
        out = out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql() -> str:
    """DuckDB SQL for the rows of query(), by a join of all n-grams."""
    return f"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, ws, list_distinct(case when len(ws) = 0 then [] when len(ws) < {N} then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - {N - 2}), lambda i: array_to_string(ws[i:i + {N - 1}], ' ')) end) as grams from w),
g as (select doc_id, unnest(grams) as x from s),
shared as (select a.doc_id as i, b.doc_id as j, count(*) as c from g a join g b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
links as (select i, j from shared join s a on a.doc_id = i join s b on b.doc_id = j where c >= {THRESHOLD} * (len(a.grams) + len(b.grams) - c) - 1e-9),
reach as (select doc_id as i, doc_id as j from documents union select r.i, l.j from reach r join links l on l.i = r.j),
comp as (select i as doc_id, min(j) as component_id from reach group by 1),
n as (select i as doc_id, count(*) as n_links from links group by 1)
select s.doc_id, case when len(ws) = 0 then s.doc_id else min(s.doc_id) over (partition by array_to_string(ws, ' ')) end as class_id, coalesce(n_links, 0) as n_links, component_id, s.doc_id = component_id as kept
from s join comp using (doc_id) left join n using (doc_id)"""
