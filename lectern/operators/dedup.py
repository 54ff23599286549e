"""Semantic deduplication: greedy, in order, by similarity to the leaders kept so far.

Items of a group are scanned in order. An item that is similar to a leader before it joins the first such leader;
else it becomes a leader. That isn't transitive, so connected components would be wrong.

Similar vectors are found in cells around pivots where these save work, and similar texts by the rare terms that they must share;
large cells and frequent terms are dealt to pairs of blocks. Equal texts are one class, as a copy has its representative's leader. The scan is a fold
over sorted pairs, in one task for each group, of a large group for each component, and only of larger ones in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.operators.components import components
from lectern.plans.session import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if one of the vectors is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Rows from which a group of vectors is cut into blocks; a block has as many, or LARGE times as many at most once there are FEW.
BLOCK, LARGE, FEW = 1024, 32, 3
#: Pivots of vectors of one dimension, at most so many dimensions with pivots, and blocks from which a group may have cells.
PIVOTS, DIMENSIONS, CELLS_FROM = 64, 16, 4
#: Groups whose counts are broadcast, and rows of a block that are multiplied at a time.
BROADCAST, TILE = 100_000, 1024


def _usable(items: DataFrame) -> DataFrame:
    """The vectors that have a group and a direction. Floats stay floats, as tasks make them doubles."""
    kind = items.schema["vector"].dataType.elementType.simpleString()
    vector = F.col("vector") if kind in ("float", "double") else F.transform("vector", lambda x: x.cast("double"))
    return items.where(F.col("group").isNotNull() & (F.sqrt(dot(vector, vector)) > 0)).select("group", "id", vector.alias("vector"))


def _sizes(rows: DataFrame) -> tuple[DataFrame, int, float]:
    """Vectors of each group and their weight, in which those of over 64 dimensions count as several; the groups; the largest weight."""
    weight = F.count("*") * F.greatest(F.lit(1.0), F.max(F.size("vector")) / 64)
    sizes = cut(rows.groupBy("group").agg(F.count("*").alias("n"), weight.alias("weight")))
    groups, most = sizes.agg(F.count("*"), F.max("weight")).first()
    return sizes, groups, most or 0.0


def _blocks(weight: Column, block: int) -> Column:
    """Few blocks, and more only if they would be too large: a vector is sent once for each block of its group."""
    return F.greatest(F.ceil(weight / (LARGE * block)), F.least(F.ceil(weight / block), F.lit(FEW))).cast("int")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def _pivots(unit: DataFrame) -> dict[int, np.ndarray]:
    """By dimension the unit vectors with the smallest hashes of their ids: any will do, as none can lose a pair."""
    some = unit.select("vector", F.size("vector").alias("_d"), F.xxhash64("id").alias("_h"))
    some = some.withColumn("_rn", F.row_number().over(Window.partitionBy("_d").orderBy("_h"))).where(F.col("_rn") <= PIVOTS)
    found: dict[int, list] = {}
    for r in some.orderBy("_d", "_h").limit(PIVOTS * DIMENSIONS).collect():
        found.setdefault(r["_d"], []).append(r["vector"])
    return {d: np.unique(_unit(np.array(v, float)), axis=0) for d, v in found.items()}


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _by_dimension(vectors: pa.ListArray):
    sizes, flat = np.diff(np.asarray(vectors.offsets)), np.asarray(vectors.flatten()).astype(float)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, _unit(flat[(ends[at] - d)[:, None] + np.arange(d)])


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray], reach: float, *columns: str) -> DataFrame:
    """The columns of rows with cell and guest, once for each cell in which the row's vector is compared."""

    def deal(batches):
        for b in batches:
            at, cell, guest = [], [], []
            for d, rows, m in _by_dimension(b.column("vector")):
                if d not in pivots:
                    at, cell, guest = [*at, rows], [*cell, np.zeros(len(rows), int)], [*guest, np.zeros(len(rows), bool)]
                    continue
                angle = np.arccos(np.clip(m @ pivots[d].T, -1, 1))
                home = angle.argmin(1)
                meets = (angle <= angle.min(1)[:, None] + reach) & (np.arange(len(pivots[d])) >= home[:, None])
                x, y = np.nonzero(meets)
                at, cell, guest = [*at, rows[x]], [*cell, y], [*guest, y != home[x]]
            if at:
                kept = b.select(list(columns)).take(pa.array(np.concatenate(at)))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(guest), pa.bool_())], [*columns, "cell", "guest"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", cell int, guest boolean"
    return rows.mapInArrow(deal, schema)


def cells(items: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """The vectors with cell and guest, once for each cell in which they are compared, and the blocks of that cell.

    A vector's home is the cell of its nearest pivot. With t as the threshold's angle, a vector at the angle a from its home's
    pivot can only be similar to vectors of cells whose pivots are within a + 2t of it, by the triangle inequality
    between the two and both pivots. It is a guest in those after its home, so each pair meets once. What cells would save is
    counted first: a group is one cell if it is small, if over half of its pairs would meet all the same, or if guests would be
    sent more than three times as many rows.
    """
    unit = _usable(items)
    sizes, groups, most = _sizes(unit)
    at_once = {"cell": F.lit(0), "guest": F.lit(False)}
    if most <= block:
        return unit.withColumn("_blocks", F.lit(1)).withColumns(at_once)
    one = unit.join(_small(sizes.select("group", _blocks(F.col("weight"), block).alias("_blocks")), groups), "group").withColumns(at_once)
    if not threshold > 0 or most <= CELLS_FROM * block:
        return one
    pivots, reach = _pivots(unit), 2 * float(np.arccos(min(threshold, 1.0))) + 1e-9
    large = sizes.where(F.col("weight") > CELLS_FROM * block)
    rows = unit.join(_small(large.select("group"), groups), "group", "left_semi")
    counts = _dealt(rows, pivots, reach, "group").groupBy("group", "cell").agg(F.count_if(~F.col("guest")).alias("h"), F.count_if("guest").alias("g"))
    counts = counts.join(_small(large, groups), "group").withColumn("_blocks", _blocks((F.col("h") + F.col("g")) * F.col("weight") / F.col("n"), block))
    meet, sent = F.sum(F.expr("h * (h - 1) / 2 + h * g")), F.sum(F.expr("(h + g) * _blocks"))
    worth = counts.groupBy("group", "n", "weight").agg(meet.alias("meet"), sent.alias("sent")).where(F.col("meet") <= F.expr("n * (n - 1) / 4"))
    worth = cut(worth.where(F.col("sent") <= 3 * F.col("n") * _blocks(F.col("weight"), block)).select("group"))
    if not (n := worth.count()):
        return one
    blocks = cut(counts.join(_small(worth, n), "group", "left_semi").select("group", "cell", "_blocks"))
    in_cells = _dealt(rows.join(_small(worth, n), "group", "left_semi"), pivots, reach, "group", "id", "vector")
    in_cells = in_cells.join(_small(blocks, n * PIVOTS), ["group", "cell"]).select(*one.columns)
    return one.join(_small(worth, n), "group", "left_anti").unionByName(in_cells)


def compared(items: DataFrame, threshold: float) -> DataFrame:
    """For each group its vectors, all their pairs, and those that vector_pairs() compares."""
    sizes = cells(items, threshold).groupBy("group", "cell").agg(F.count_if(~F.col("guest")).alias("h"), F.count_if("guest").alias("g"))
    return sizes.groupBy("group").agg(F.sum("h").alias("vectors"), F.sum(F.expr("h * (h - 1) div 2 + h * g")).alias("compared")).withColumn("pairs", F.expr("vectors * (vectors - 1) div 2"))


def vector_pairs(items: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """group, i < j and sim for vectors of a group at least so similar.

    Vectors meet in cells; a cell is cut into blocks, and each pair of blocks is a task of matrix products, tile by tile.
    """
    dealt = cells(items, threshold, block).withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")}).drop("_other", "_blocks")
    group, id_ = (items.schema[c].dataType.simpleString() for c in ("group", "id"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by("id").combine_chunks()
        own, guest, lo, hi = np.asarray(t["_own"]), np.asarray(t["guest"]), t["_lo"][0].as_py(), t["_hi"][0].as_py()
        groups, ids = (t[c].combine_chunks() for c in ("group", "id"))
        for _, at, m in _by_dimension(t["vector"].combine_chunks()):
            left, right = np.flatnonzero(own[at] == lo), np.flatnonzero(own[at] == hi)
            a, b = m[left], m[right]
            left, right = at[left], at[right]
            for x in range(0, len(left), TILE):
                for y in range(x if lo == hi else 0, len(right), TILE):
                    one, two = left[x : x + TILE], right[y : y + TILE]
                    sims = a[x : x + TILE] @ b[y : y + TILE].T
                    near = sims >= threshold
                    if guest[one].any():
                        near &= ~(guest[one][:, None] & guest[two])
                    if lo == hi and x == y:
                        near = np.triu(near, 1)
                    found = np.flatnonzero(near)
                    if len(found):
                        one, two = one[found // len(two)], two[found % len(two)]
                        i, j = pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))
                        yield pa.RecordBatch.from_arrays([groups.take(i), ids.take(i), ids.take(j), pa.array(sims.ravel()[found])], ["group", "i", "j", "sim"])

    return dealt.groupBy("group", "cell", "_lo", "_hi").applyInArrow(similar, f"group {group}, i {id_}, j {id_}, sim double").where("i < j")


def text_classes(items: DataFrame) -> DataFrame:
    """group, id, rep and words: texts of equal words are a class, whose rep is its smallest id (D2). Without words each is its own.

    items: group, id, text.
    """
    rows = items.select("group", "id", F.regexp_extract_all(F.lower("text"), F.lit("(?U)\\b(\\w\\w+)\\b"), F.lit(1)).alias("words"))
    name = F.when(F.size("words") > 0, F.sha2(F.array_join("words", " "), 256)).otherwise(F.col("id").cast("string"))
    rows = cut(rows.withColumn("_name", name))
    reps = rows.groupBy("group", "_name").agg(F.min("id").alias("rep"), F.count("*").alias("_copies"))
    several = reps.where("_copies > 1").select("group", "_name", "rep")
    return rows.join(several, ["group", "_name"], "left").select("group", "id", F.coalesce("rep", "id").alias("rep"), "words")


def _class_weights(classes: DataFrame) -> DataFrame:
    """group, id, term and weight of each class; its copies count in n and df."""
    sizes = classes.groupBy("group", F.col("rep").alias("id")).agg(F.count("*").alias("copies"))
    w = F.col("words")
    pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda x, y: F.concat(x, F.lit(" "), y))).otherwise(F.array().cast("array<string>"))
    reps = classes.where("id = rep").join(sizes, ["group", "id"])
    tf = reps.select("group", "id", "copies", F.explode(F.concat(w, pairs)).alias("term")).groupBy("group", "id", "copies", "term").agg(F.count("*").alias("tf"))
    n = classes.groupBy("group").agg(F.count("*").alias("n"))
    df = tf.groupBy("group", "term").agg(F.sum("copies").alias("df"))
    raw = tf.join(df, ["group", "term"]).join(n, "group").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("group", "id")))
    return raw.select("group", "id", "term", (F.col("w") / norm).alias("weight"))


def tfidf(items: DataFrame) -> DataFrame:
    """group, id, term and weight: words and pairs of words, smooth idf, unit length (D2). items: group, id, text."""
    classes = cut(text_classes(items))
    weights = _class_weights(classes).withColumnRenamed("id", "rep")
    return classes.select("group", "id", "rep").join(weights, ["group", "rep"]).select("group", "id", "term", "weight")


#: Items with a term that meet in one task at most.
POSTINGS = 2048


def class_pairs(classes: DataFrame, threshold: float, postings: int = POSTINGS) -> DataFrame:
    """group, i < j and sim by TF-IDF between the reps of text_classes().

    With the terms of an item in the order of their rarity, a pair whose rarest common term is so far back that the
    rest of one vector is shorter than the threshold can't reach it. So pairs meet on the terms before that only. The
    items of a frequent term are dealt to pairs of blocks.
    """
    v = cut(_class_weights(classes))
    df = v.groupBy("group", "term").agg(F.count("*").alias("df"))
    back = Window.partitionBy("group", "id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    rare = v.join(df, ["group", "term"]).withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(back))
    rare = cut(rare.where(F.col("rest") >= (threshold - 1e-9) ** 2).select("group", "term", "id"))
    blocks = rare.groupBy("group", "term").agg(F.ceil(F.count("*") / postings).cast("int").alias("of")).where("of > 1")
    rare = rare.join(blocks, ["group", "term"], "left").withColumn("of", F.coalesce("of", F.lit(1)))
    rare = rare.withColumn("own", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    a = rare.select("group", "term", F.col("id").alias("a"), F.col("own").alias("lo"), F.explode(F.sequence("own", F.col("of") - 1)).alias("hi"))
    b = rare.select("group", "term", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("lo"), F.col("own").alias("hi"))
    met = a.join(b, ["group", "term", "lo", "hi"]).where("lo < hi and a <> b or a < b")
    met = met.select("group", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()
    x, y = (v.select("group", "term", F.col("id").alias(k), F.col("weight").alias(w)) for k, w in (("i", "x"), ("j", "y")))
    both = met.join(x, ["group", "i"]).join(y, ["group", "j", "term"])
    return both.groupBy("group", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("sim")).where(F.col("sim") >= threshold - 1e-12)


def text_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """group, i < j and sim of all similar items, copies too; class_pairs() has one pair for all copies of two texts."""
    classes = cut(text_classes(items))
    pairs = class_pairs(classes, threshold)
    of = lambda k: classes.select("group", F.col("rep").alias(k), F.col("id").alias(f"_{k}"))
    apart = pairs.join(of("i"), ["group", "i"]).join(of("j"), ["group", "j"]).select("group", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "sim")
    worded = classes.where("size(words) > 0").select("group", "rep", "id")
    equal = worded.withColumnRenamed("id", "i").join(worded.withColumnRenamed("id", "j"), ["group", "rep"]).where("i < j")
    return apart.unionByName(equal.select("group", "i", "j", F.lit(1.0).alias("sim")).where(F.col("sim") >= threshold - 1e-12))


#: Pairs of a group or component that one task folds at most.
FOLD = 5_000_000


def clusters(items: DataFrame, pairs: DataFrame, fold: int = FOLD) -> DataFrame:
    """group, id, leader for each item (D1). items: group, id in the order of the scan; pairs: group, i, j with i < j.

    The pairs of a group are folded in order of j, so what is known of earlier items decides the next one. A group with more
    than `fold` pairs is folded by its connected components, and a component with more in rounds of joins.
    """
    pairs = cut(pairs.select("group", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")))
    items = items.select("group", F.col("id").cast("long").alias("id"))
    large = cut(pairs.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > fold))
    first = _folded(pairs.join(large, "group", "left_anti").withColumn("part", F.lit(0).cast("long")))
    if not large.isEmpty():
        rows = pairs.join(large, "group", "left_semi")
        rows = cut(rows.join(components(rows).withColumnRenamed("node", "i"), ["group", "i"]))
        over = cut(rows.groupBy("group", "part").agg(F.count("*").alias("n")).where(F.col("n") > fold))
        first = first.unionByName(_folded(rows.join(over, ["group", "part"], "left_anti")))
        if not over.isEmpty():
            first = first.unionByName(_in_rounds(rows.join(over, ["group", "part"], "left_semi").select("group", "i", "j")))
    return items.join(first, ["group", "id"], "left").select("group", "id", F.coalesce("leader", "id").alias("leader"))


def _folded(pairs: DataFrame) -> DataFrame:
    """group, id and leader of the items that aren't leaders, from pairs of group, part, i and j. It holds the non-leaders of one part."""
    kind = pairs.schema["group"].dataType.simpleString()

    def fold(batches):
        part, led, now = None, set(), (None, None)  # led: items with a leader; now: the item at hand and its leader
        for b in batches:
            out = []
            for group, of, j, i in zip(*(b.column(c).to_pylist() for c in ("group", "part", "j", "i")), strict=True):
                if (group, of) != part:
                    part, led, now = (group, of), set(), (None, None)
                if j != now[0]:
                    now = j, None
                if now[1] is None and i not in led:
                    now = j, i
                    led.add(j)
                    out.append((group, j, i))
            names = ["group", "id", "leader"]
            types = [b.schema.field("group").type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    rows = pairs.repartition("group", "part").sortWithinPartitions("group", "part", "j", "i").select("group", "part", "j", "i")
    return rows.mapInArrow(fold, f"group {kind}, id long, leader long")


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """The same by rounds of joins: an item of which no earlier similar one is undecided leads those that are similar to it."""
    open_, leaders = cut(pairs), None
    while not open_.isEmpty():
        led = cut(open_.select("group", "i").distinct().join(open_.select("group", F.col("j").alias("i")), ["group", "i"], "left_anti"))
        leaders = led if leaders is None else leaders.unionByName(led)
        gone = open_.join(led, ["group", "i"], "left_semi").select("group", F.col("j").alias("i")).unionByName(led).distinct()
        open_ = open_.join(gone, ["group", "i"], "left_anti").join(gone.withColumnRenamed("i", "j"), ["group", "j"], "left_anti")
        open_ = cut(open_.select("group", "i", "j"))
    return pairs.join(leaders, ["group", "i"], "left_semi").groupBy("group", F.col("j").alias("id")).agg(F.min("i").alias("leader"))


#: Undecided vectors of a group, the first by id, that one task scans at a time, of up to 64 dimensions; and vectors that are compared with the leaders found.
HEAD, FOLLOWERS = 8192, 16384


def _scanned(vectors: pa.ListArray, ids: np.ndarray, threshold: float, leaders: tuple[pa.ListArray, np.ndarray] | None = None, step: int = 256) -> np.ndarray:
    """For each vector, in the order of ids, the row of its first similar leader, or -1.

    Without leaders it is the greedy scan itself. Rows of one id are one item, similar to what any of them is similar to.
    """
    dims, m = _padded(vectors)
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
    ends = np.append(starts[1:], len(ids))
    first = np.full(len(starts), -1)

    def near(rows, of, other):
        out = m[rows] @ other.T >= threshold
        return out if (dims[0] == of).all() and (dims[0] == dims[rows]).all() else out & (dims[rows][:, None] == of)

    by_id = lambda hit, at, axis: np.logical_or.reduceat(hit, at, axis)
    if leaders:
        of, other = _padded(leaders[0], m.shape[1])
        m, n = (np.pad(m, ((0, 0), (0, other.shape[1] - m.shape[1]))), len(other))
    else:
        of, other, n = dims.copy(), np.empty_like(m), 0
        rows_of = np.empty(len(ids), int)
    for k in range(0, len(starts), step):
        to = min(k + step, len(starts))
        lo, at, own = starts[k], starts[k:to] - starts[k], first[k:to]
        rows = slice(lo, ends[to - 1])
        for x in range(0, n, 16 * step):
            hit = by_id(near(rows, of[x : min(n, x + 16 * step)], other[x : min(n, x + 16 * step)]), at, 0)
            new = hit.any(1) & (own < 0)
            own[new] = hit.argmax(1)[new] + x
        if leaders:
            continue
        own[own >= 0] = rows_of[own[own >= 0]]
        hit = by_id(by_id(near(rows, dims[rows], m[rows]), at, 0), at, 1)
        for r in np.flatnonzero(own < 0):
            if own[r] < 0:
                new = hit[r] & (own < 0)
                new[: r + 1] = False
                own[new] = lo + at[r]
        led = np.concatenate([np.arange(starts[k + r], ends[k + r]) for r in np.flatnonzero(own < 0)] or [np.zeros(0, int)])
        of[n : n + len(led)], other[n : n + len(led)], rows_of[n : n + len(led)] = dims[led], m[led], led
        n += len(led)
    return np.repeat(first, ends - starts)


def _padded(vectors: pa.ListArray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and unit vectors, filled up with zeros to the longest one."""
    dims = np.diff(np.asarray(vectors.offsets))
    m = np.zeros((len(dims), max([least, *dims])))
    for d, at, rows in _by_dimension(vectors):
        m[at, :d] = rows
    return dims, m


def vector_clusters(items: DataFrame, threshold: float, head: int = HEAD, followers: int = FOLLOWERS) -> DataFrame:
    """group, id, leader as clusters() gives them from vector_pairs(), in work that grows with the leaders and without a list of pairs.

    The first undecided vectors of each group are scanned in a task. All later ones are compared with the leaders among these, in
    blocks: a leader that is similar is the first one, as those found later have larger ids. What is still undecided goes the
    same way, until the rest of each group is one task's. Without any similar vectors that takes a round for each head of a group.
    """
    rest, led = _usable(items), None
    group, id_, vector = (rest.schema[c].dataType.simpleString() for c in ("group", "id", "vector"))
    schema = f"group {group}, id {id_}, leader {id_}, vector {vector}"

    def told(t: pa.Table, at: np.ndarray, leaders: pa.Array) -> pa.Table:
        """Rows with their leaders, and the vectors of those that have none."""
        leader = leaders.take(pa.array(at, mask=at < 0))
        undecided = t["vector"].combine_chunks().take(pa.array(np.arange(len(at)), mask=at >= 0))
        return pa.table({"group": t["group"], "id": t["id"], "leader": leader, "vector": undecided})

    def scan(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        ids = t["id"].combine_chunks()
        return told(t, _scanned(t["vector"].combine_chunks(), ids.to_numpy(False), threshold), ids)

    def follow(t: pa.Table, leaders: pa.Table) -> pa.Table:
        t, leaders = (x.sort_by("id").combine_chunks() for x in (t, leaders))
        if not len(t) or not len(leaders):
            return told(t, np.full(len(t), -1), leaders["id"].combine_chunks())
        ids, other = (x["id"].combine_chunks() for x in (t, leaders))
        found = _scanned(t["vector"].combine_chunks(), ids.to_numpy(False), threshold, (leaders["vector"].combine_chunks(), other.to_numpy(False)))
        return told(t, found, other)

    def add(rows: DataFrame) -> None:
        nonlocal led
        rows = rows.where(F.col("leader").isNotNull()).select("group", "id", "leader")
        led = rows if led is None else led.unionByName(rows)

    while True:
        sizes, groups, most = _sizes(rest)
        if most <= head:
            add(rest.groupBy("group").applyInArrow(scan, schema))
            break
        rank = F.row_number().over(Window.partitionBy("group").orderBy("id"))
        heads = rest.select("group", "id").withColumn("_rn", rank).where(F.col("_rn") <= head)
        heads = heads.join(_small(sizes, groups), "group").where(F.col("_rn") <= F.greatest(F.lit(1.0), head * F.col("n") / F.col("weight")))
        bounds = heads.groupBy("group").agg(F.max("id").alias("_to"), F.first("weight").alias("weight"))
        bounds = _small(cut(bounds.select("group", "_to", F.ceil(F.col("weight") / followers).cast("int").alias("_of"))), groups)
        rows = rest.join(bounds, "group")
        scanned = cut(rows.where("id <= _to").select("group", "id", "vector").groupBy("group").applyInArrow(scan, schema))
        later = rows.where("id > _to").select("group", "id", "vector", F.pmod(F.xxhash64("id"), F.col("_of")).cast("int").alias("_block"))
        leaders = scanned.where("leader is null").select("group", "id", "vector").join(bounds, "group")
        leaders = leaders.select("group", "id", "vector", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_block"))
        followed = cut(later.groupBy("group", "_block").cogroup(leaders.groupBy("group", "_block")).applyInArrow(follow, schema))
        add(cut(scanned.where(F.col("leader").isNotNull()).select("group", "id", "leader")))
        add(cut(followed.where(F.col("leader").isNotNull()).select("group", "id", "leader")))
        rest = followed.where("leader is null").select("group", "id", "vector")
    led = led.groupBy("group", "id").agg(F.min("leader").alias("leader"))
    return items.select("group", "id").join(led, ["group", "id"], "left").select("group", "id", F.coalesce("leader", "id").alias("leader"))


def deduplicate(items: DataFrame, pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """The leaders in order, each shown by the longest text of its cluster, the earliest of equals.

    pairs are those of all items, or of the reps that members (group, id, rep) names: a copy has its rep's leader.
    """
    if members is None:
        members = items.select("group", "id", F.col("id").alias("rep"))
    reps = clusters(members.where("id = rep"), pairs).withColumnRenamed("id", "rep")
    told = members.select("group", F.col("id").cast("long").alias("id"), F.col("rep").cast("long").alias("rep")).join(reps, ["group", "rep"])
    c = told.join(items.select("group", F.col("id").cast("long").alias("id"), "text"), ["group", "id"])
    return c.groupBy("group", F.col("leader").alias("id")).agg(F.min_by("text", F.struct(-F.length("text"), F.col("id"))).alias("text"))


def _deduplicated(rows: DataFrame, threshold: float) -> DataFrame:
    classes = cut(text_classes(rows))
    return deduplicate(rows, class_pairs(classes, threshold), classes.select("group", "id", "rep"))


def prepared(items: DataFrame, collapse: bool = False) -> DataFrame:
    """Trimmed, blanks dropped; with collapse white space becomes one space."""
    text = strip(F.col("text"))
    text = F.regexp_replace(text, "[ \\t\\r\\n]+", " ") if collapse else text
    return items.withColumn("text", text).where("text <> ''")


def concepts(items: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Concepts as text."""
    rows = prepared(items)
    return _deduplicated(rows, threshold)


def formulas(items: DataFrame, threshold: float = 0.92) -> DataFrame:
    rows = prepared(items, collapse=True)
    return _deduplicated(rows, threshold)


def definitions(items: DataFrame, threshold: float = 0.88, richest: bool = False) -> DataFrame:
    """Terms deduplicated, each with its first definition, or with richest its longest (D4). items: group, id, text, definition."""
    rows = prepared(items)
    kept = _deduplicated(rows, threshold)
    order = Window.partitionBy("group", "text").orderBy(*([F.desc(F.length("definition"))] if richest else []), "id")
    one = rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("group", "text", "definition")
    return kept.join(one, ["group", "text"])


def exact(items: DataFrame) -> DataFrame:
    """First of equal texts in any case."""
    rows = prepared(items)
    order = Window.partitionBy("group", F.lower("text")).orderBy("id")
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("group", "id", "text")


def first_terms(items: DataFrame) -> DataFrame:
    """First of terms that are equal in any case, with its place."""
    return exact(items)


def first_formulas(items: DataFrame) -> DataFrame:
    """First of equal formulas, with its place; x and X are two."""
    order = Window.partitionBy("group", "text").orderBy("id")
    return prepared(items).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("group", "id", "text")
