"""Near-duplicate vectors: Euclidean p-stable hashing of normalised vectors, then exact cosine checks.

Vectors of equal label whose cosine is THRESHOLD or more are linked. For vectors of length one that is a
distance of sqrt(2 - 2 THRESHOLD) or less; the number of tables of quantised projections follows from the recall
aimed at for that distance. Projections grow with the logarithm of the largest label (see projections_for()), so
that buckets of vectors without structure stay near BLOCK however many there are.

1. Equal vectors of a label form a class; from here on classes count once.
2. Classes are hashed. Buckets of the same classes are one bucket. Within a bucket all cosines are checked and a
   spanning forest of the links goes on. A bucket of more than BLOCK classes is dealt to pairs of blocks, each a
   task's work of its own, so nothing goes on unchecked and no task holds a large bucket.
3. Connected classes form groups. All cosines within a group are computed, in blocks of at most BLOCK classes;
   links are counted and a spanning forest is kept; no pair becomes a row. So the links found are exact within
   each group.
4. Components of the forests give component_id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null
label, link with nothing; vectors of different dimensions are not compared; rows of equal ids are vectors each;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, grouped, halves, lookup, parts, weighted_lookup, written
from .components import components
from .pstable import Projections, by_dimension, tables_for, takes_part, unit

THRESHOLD, RECALL, PROJECTIONS, WIDTH, BLOCK = 0.98, 0.9999, 8, 1.0, 256


def projections_for(n: int) -> int:
    """PROJECTIONS, or so many that the fullest interval of each leaves less than BLOCK of n vectors in a bucket."""
    fullest = math.erf(WIDTH / 2 / math.sqrt(2))  # of a normal distribution, where an interval is centred on 0
    return max(PROJECTIONS, math.ceil(math.log(max(n, 1) / BLOCK) / -math.log(fullest)))


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of cosines of at least the threshold; those too near to it for a matrix product are summed apart."""
    cosines = unit(left) @ unit(right).T
    near = cosines >= threshold
    for i, j in zip(*np.nonzero(np.abs(cosines - threshold) < 1e-12), strict=True):
        a, b = left[i], right[j]
        near[i, j] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= threshold
    return near


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id, n_links, component_id and kept for each vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    able = F.col("label").isNotNull() & F.col("id").isNotNull() & takes_part(F.col("vector"))
    rows = written(rows.withColumn("vector", F.when(able, F.col("vector"))).withColumn("key", F.xxhash64("vector")), "vectors")
    classes = rows.where("vector is not null").groupBy("label", "key", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    projections = projections_for(largest)
    tables = tables_for(math.sqrt(2 - 2 * threshold), WIDTH, projections, recall)

    def hashed(batches):
        made: dict[int, Projections] = {}
        for b in batches:
            for dim, at, m in by_dimension(b.column("vector")):
                p = made.setdefault(dim, Projections(dim, tables, projections, WIDTH))
                names = p.buckets(p.positions(unit(m)))
                yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(at, pa.int64())), b.column("label").take(pa.array(at, pa.int64())), pa.array(names.tolist(), pa.list_(pa.int64()))], ["node", "label", "buckets"])

    label_type = classes.schema["label"].dataType.simpleString()
    banded = classes.select("node", "label", "vector").mapInArrow(hashed, f"node long, label {label_type}, buckets array<long>")
    banded = written(banded.select("node", "label", F.explode("buckets").alias("b")).select("node", F.xxhash64("label", "b").alias("bucket")), "hashed")
    mix = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("first"), *mix).where("size > 1")
    buckets = written(buckets.groupBy("size", "first", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "size", "first"), "buckets")
    members = written(banded.join(buckets, "bucket"), "members")

    def matrices(t):
        """(indices, matrix) for each dimension of a group's vectors."""
        return [(at, m) for _, at, m in by_dimension(t["vector"].combine_chunks())]

    def check(batches):
        for t in grouped(batches, ["bucket", "lo", "hi"]):
            node, tags, forest = np.asarray(t["node"].combine_chunks()), np.asarray(t["own"].combine_chunks()), Forest(t.num_rows)
            lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
            for at, m in matrices(t):
                left, right = tags[at] == lo, tags[at] == hi
                if left.any() and right.any():
                    forest.join_all((at[left], at[right], linked(m[left], m[right], threshold)))
            pairs = [(int(node[i]), int(node[forest.root(i)])) for i in range(len(node)) if forest.root(i) != i]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    cells = halves(members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "node", "blocks").select("bucket", "lo", "hi", "own", "node")
    cells = cells.join(classes.select("node", "vector"), "node")
    checked = cells.repartition(parts(spark), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(check, "u long, v long")
    groups = written(components(checked).withColumnRenamed("component", "group"), "groups")
    totals = written(groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "group-sizes")
    wanted = lookup(classes.select("node", "vector", "copies").join(groups, "node"), totals, ["group"])
    cells = halves(wanted, "node", "blocks")
    cells = cells.repartition(parts(spark), "group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "node")

    def count(batches):
        for t in grouped(batches, ["group", "lo", "hi"]):
            node, tags, copies = (np.asarray(t[c].combine_chunks()) for c in ("node", "own", "copies"))
            forest, links, lo, hi = Forest(len(node)), np.zeros(len(node), np.int64), t["lo"][0].as_py(), t["hi"][0].as_py()
            for at, m in matrices(t):
                left, right = tags[at] == lo, tags[at] == hi
                near = linked(m[left], m[right], threshold) if left.any() and right.any() else np.zeros((left.sum(), right.sum()), bool)
                if lo == hi:
                    np.fill_diagonal(near, False)
                forest.join_all((at[left], at[right], near))
                links[at[left]] += near @ copies[at[right]]
                if lo != hi:
                    links[at[right]] += near.T @ copies[at[left]]
            roots = [int(node[forest.root(i)]) for i in range(len(node))]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(roots, pa.int64()), pa.array(links, pa.int64()), pa.array(np.full(len(node), t["blocks"][0].as_py()), pa.int32())], ["node", "root", "links", "blocks"])

    verified = written(cells.mapInArrow(count, "node long, root long, links long, blocks int"), "verified")
    several = components(verified.where("blocks > 1").select(F.col("node").alias("u"), F.col("root").alias("v")))
    found = verified.where("blocks = 1").select("node", F.col("root").alias("component")).unionByName(several)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.select("node", "label", "key", "vector", "rep", "copies").join(links, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = written(joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("of")), "component-ids")
    labelled = written(weighted_lookup(joined, least, ["component"], "of").select("label", "key", "vector", "copies", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), "linked-classes")
    both = weighted_lookup(rows.where("vector is not null"), labelled, ["label", "key", "vector"], "copies").select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return both.unionByName(alone).select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql() -> str:
    """DuckDB SQL for the rows of query(), by all pairs of a label."""
    norm = "sqrt(list_dot_product(v, v))"
    return f"""
with recursive v as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, v, {norm} as n from v),
links as (select a.vec_id as i, b.vec_id as j from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) / (a.n * b.n) >= {THRESHOLD}),
reach as (select vec_id as i, vec_id as j from embeddings union select r.i, l.j from reach r join links l on l.i = r.j),
comp as (select i as vec_id, min(j) as component_id from reach group by 1),
c as (select i as vec_id, count(*) as n_links from links group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from comp left join c using (vec_id)"""
