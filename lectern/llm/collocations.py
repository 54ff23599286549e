"""Phrase collocations by pivot partitioning, as in MG-FSM.

1. Words are counted by language. The frequent ones, the commonest first, are the dictionary.
2. An n-gram belongs to its pivot, its rarest word by the order of the dictionary. Each occurrence of a word becomes
   a fragment: the words around it that an n-gram of MOST_WORDS reaches, cut where one is rarer (or infrequent, or a
   piece ends). To its left also an equal word cuts, so that an n-gram's leftmost pivot alone has it. Words are
   rewritten to short codes of their ranks. Equal fragments of a few megabytes of text are one with a count;
   fragments go to their pivot.
3. Pivot by pivot, n-grams around the pivot are counted; frequent ones are emitted, and no other task has any of them.
   A pivot with more than BLOCK occurrences is dealt to as many blocks, whose counts are added up.
4. Scores look up the parts of the few candidates among the candidates and words; parts that many ask for meet a broadcast.

The dictionary that is sent to the executors holds at most DICTIONARY words of at most WORD_BYTES bytes. Words beyond
it, if there are frequent ones, are no less whole: they rank after all others in the order of their bytes, and so are
pivots without a look at their counts. Only then are infrequent words routed, and they are dropped where n-grams are counted.

Defined cases: null texts are empty and null langs `und`; a text without words has no phrases; repeated rows count each; texts are read
in chunks, of any length; words may hold any character but the separators; ties are in order of UTF-8 bytes; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, weighted_lookup, written

LEAST, MOST_WORDS, TOP, NO_LANG = 100, 5, 2000, "und"
DICTIONARY, WORD_BYTES = 500_000, 64
#: Occurrences of a pivot that one group mines at most.
BLOCK = 1_000_000
#: Bytes of text whose fragments are counted together, and whose words are; rows that are mined together.
CHUNK, COUNTED, ROWS = 1 << 20, 8 << 20, 1 << 16

REACH = MOST_WORDS - 1
#: Parts pieces; the byte 0xFF is in no UTF-8 text and stands for these.
SEPARATORS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
_TABLE = bytes.maketrans(SEPARATORS + b"\t", END * len(SEPARATORS) + b" ")


def by_lang(batches, size: int):
    """(lang, texts as bytes) of about so many bytes each; one text may be longer."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    total = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            held.setdefault(lang, []).append(text)
            sizes[lang] += len(text) + 1
            total += len(text) + 1
            if sizes[lang] >= size:
                total -= sizes.pop(lang)
                yield lang, held.pop(lang)
            elif total >= 16 * size:  # of many languages
                yield from held.items()
                held, total = {}, 0
                sizes.clear()
    yield from held.items()


def chunks(texts: list[bytes]):
    """Lists of words in lower case, with END between pieces, of about CHUNK bytes."""
    flat = END.join(texts).lower().translate(_TABLE).replace(END, b" " + END + b" ")
    at = 0
    while at < len(flat):
        to = flat.find(b" ", at + CHUNK)
        to = len(flat) if to < 0 else to
        yield flat[at:to].split()
        at = to


def counted_words(docs: DataFrame) -> DataFrame:
    """lang, word and f, its occurrences."""

    def count(batches):
        for lang, texts in by_lang(batches, COUNTED):
            found: Counter = Counter()
            for words in chunks(texts):
                found.update(words)
            found.pop(END, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "f"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


#: Codes of ranks are strings of these bytes; a word outside the dictionary is its own code after the byte RAW.
DIGITS, RAW = bytes(x for x in range(255) if x != 32), b"\xff"
_codes: list[bytes] = []
_rank_of: dict[bytes, int] = {}


def codes(n: int) -> list[bytes]:
    """The codes of the ranks from 0 to n - 1, short ones first; more may follow."""
    while len(_codes) < n:
        r, code = len(_codes) + 1, b""
        while r:
            r, digit = divmod(r - 1, len(DIGITS))
            code = DIGITS[digit : digit + 1] + code
        _rank_of[code] = len(_codes)
        _codes.append(code)
    return _codes


class Dictionary:
    """For each language its words, the commonest first, with the key of their pivot's group and its number of blocks."""

    def __init__(self, rows: pa.Table, whole: bool):
        self.whole, self.langs, self.ranks = whole, {}, {}
        rows = rows.sort_by([("lang", "ascending"), ("f", "descending"), ("word", "ascending")])
        rows = rows.append_column("key", pa.array(np.arange(rows.num_rows)))
        for lang in pc.unique(rows["lang"]).to_pylist():
            own = rows.filter(pc.equal(rows["lang"], lang))
            self.langs[lang] = own["word"].combine_chunks().cast(pa.binary()), np.asarray(own["key"]), 1 + np.asarray(own["f"]) // BLOCK

    def __getstate__(self) -> dict:
        return {"whole": self.whole, "langs": self.langs, "ranks": {}}

    def rank(self, lang: str) -> dict[bytes, int]:
        if lang not in self.ranks:
            words = self.langs[lang][0].to_pylist() if lang in self.langs else []
            self.ranks[lang] = {w: i for i, w in enumerate(words)}
        return self.ranks[lang]

    def read(self, lang: str, words: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """The words' ranks, -1 for those that are in no candidate, and their codes; key and number of blocks by rank."""
        rank = self.rank(lang)
        _, key, blocks = self.langs.get(lang, (None, np.zeros(0, np.int64), np.zeros(0, np.int64)))
        ids = np.fromiter(map(rank.get, words, repeat(-1)), np.int64, len(words))
        short, others = codes(len(rank) + 1), []
        if not self.whole:
            others = sorted({words[i] for i in np.flatnonzero(ids < 0)} - {END})
            more = {w: len(rank) + i for i, w in enumerate(others)}
            for i in np.flatnonzero(ids < 0):
                ids[i] = more.get(words[i], -1)
            short = [*short[: len(rank)], *(RAW + w for w in others), b""]
            key, blocks = np.concatenate([key, other_keys(lang, others)]), np.concatenate([blocks, np.ones(len(others), np.int64)])
        return ids, list(map(short.__getitem__, ids.tolist())), key, blocks

    def phrase(self, lang: str, code: bytes) -> str:
        words = self.langs[lang][0] if lang in self.langs else None
        return b" ".join(c[1:] if c.startswith(RAW) else words[_rank_of[c]].as_py() for c in code.split(b" ")).decode("utf-8", "replace")


def other_keys(lang: str, words: list[bytes]) -> np.ndarray:
    """Keys of the groups of words outside the dictionary, below 0; words may share one."""
    return np.array([-1 - int.from_bytes(blake2b(w, digest_size=7, key=lang.encode()[:64]).digest(), "little") for w in words], np.int64)


def slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The slices of data."""
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    short = not len(ends) or ends[-1] < 1 << 31
    offsets = np.append(0, ends).astype(np.int32 if short else np.int64)
    return pa.Array.from_buffers(pa.binary() if short else pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))])


def extents(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left and to the right of each word its fragment takes."""
    n = len(ids)
    wide = np.concatenate([np.full(REACH, -1), ids, np.full(REACH, -1)])
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    to_left = to_right = ids >= 0
    for k in range(1, REACH + 1):
        before, after = wide[REACH - k : REACH - k + n], wide[REACH + k : REACH + k + n]
        to_left = to_left & (before >= 0) & (before < ids)
        to_right = to_right & (after >= 0) & (after <= ids)
        left += to_left
        right += to_right
    return left, right


def windows(lists):
    """(words, first, end): words from first to end are to be treated, those around them are their neighbours."""
    before: list[bytes] = []
    held: list[bytes] = []
    for words in lists:
        words = before + held + words
        a, z = len(before), max(len(before), len(words) - REACH)
        yield words, a, z
        before, held = words[max(0, z - REACH) : z], words[z:]
    yield before + held, len(before), len(before) + len(held)


#: A fragment's route is its pivot's key, of one of its blocks, in the bits above; IN_BLOCKS if the pivot has several; and
#: in the lowest bits the number of words left of the pivot.
SHIFT, IN_BLOCKS = 4, 8
#: Between the keys of a pivot's blocks; no dictionary has as many words.
NEXT_BLOCK = 1 << 32


def fragments(lang: str, texts: list[bytes], dictionary: Dictionary, turn: int) -> pa.Table:
    """route, fragment and n for the fragments of texts. turn: where dealing to blocks starts."""
    found = []
    for words, a, z in windows(chunks(texts)):
        ids, short, key, blocks = dictionary.read(lang, words)
        left, right = extents(ids)
        at = a + np.flatnonzero((left + right)[a:z] > 0)
        sizes = np.fromiter(map(len, short), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        data = np.frombuffer(b" ".join(short), np.uint8)
        first, last = at - left[at], at + right[at]
        text = slices(data, starts[first], starts[last] + sizes[last] - starts[first])
        routes = (key[ids[at]] << SHIFT) + IN_BLOCKS * (blocks[ids[at]] > 1) + left[at]
        rows = pa.table({"route": routes, "fragment": text}).group_by(["route", "fragment"], use_threads=False).aggregate([([], "count_all")])
        routes = np.asarray(rows["route"])
        many = np.flatnonzero(routes & IN_BLOCKS)  # their words are in the dictionary
        block = (many + turn) % blocks[(routes[many] >> SHIFT) - key[0]] if len(many) else many
        dealt = routes.copy()
        dealt[many] += block * NEXT_BLOCK << SHIFT
        found.append(pa.table({"route": dealt, "fragment": rows["fragment"], "n": rows["count_all"]}))
        turn += rows.num_rows
    return pa.concat_tables(found)


def mined(rows: pa.Table) -> pa.Table:
    """n for the phrases of fragments, by pivot (a route without its lowest bits), lang and phrase. rows: route, fragment, n, lang."""
    text = rows["fragment"].combine_chunks()
    offsets = np.frombuffer(text.buffers()[1], np.int32 if text.type == pa.binary() else np.int64)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[: offsets[-1]]
    blanks = offsets[0] + np.flatnonzero(data[offsets[0] :] == 32)
    starts, ends = np.sort(np.concatenate([offsets[:-1], blanks + 1])), np.sort(np.concatenate([offsets[1:], blanks]))
    size = np.diff(np.searchsorted(blanks, offsets)) + 1
    route = np.asarray(rows["route"])
    left = route % IN_BLOCKS
    right, place = size - 1 - left, np.cumsum(size) - size + left
    of, start, end = [], [], []
    for a in range(REACH + 1):
        for z in range(max(0, 1 - a), REACH + 1 - a):
            some = np.flatnonzero((left >= a) & (right >= z))
            of.append(some)
            start.append(starts[place[some] - a])
            end.append(ends[place[some] + z])
    of, start, end = map(np.concatenate, (of, start, end))
    names = rows["lang"].combine_chunks().dictionary_encode()
    flat = pa.table({"pivot": (route // IN_BLOCKS)[of], "lang": np.asarray(names.indices)[of], "phrase": slices(data, start, end - start), "n": np.asarray(rows["n"])[of]})
    flat = added(flat)
    return flat.set_column(1, "lang", names.dictionary.take(flat["lang"].combine_chunks()))


def added(*tables: pa.Table) -> pa.Table:
    if len({t["phrase"].type for t in tables}) > 1:
        tables = [t.set_column(2, "phrase", t["phrase"].cast(pa.large_binary())) for t in tables]
    return pa.concat_tables(tables).group_by(["pivot", "lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["pivot", "lang", "phrase", "n"])


def mine(batches, least: int, known: Dictionary):
    """Counts of the phrases of sorted rows; only those of parts or with least occurrences are kept. One pivot is held at a time."""
    held, n, open_ = [], 0, None

    def step() -> pa.Table:
        """Counts of the rows held, and those of the pivot before that isn't done."""
        rows = mined(pa.Table.from_batches(held))
        if open_ is None:
            return rows
        same = pc.equal(rows["pivot"], open_["pivot"][0])
        first, others = added(open_, rows.filter(same)), rows.filter(pc.invert(same))
        if first["phrase"].type != others["phrase"].type:
            others = others.set_column(2, "phrase", others["phrase"].cast(first["phrase"].type))
        return pa.concat_tables([first, others])

    def done(rows: pa.Table):
        parts = np.asarray(rows["pivot"]) % 2 == 1
        kept = parts | (np.asarray(rows["n"]) >= least)
        rows, parts = rows.filter(pa.array(kept)), parts[kept]
        words = [known.phrase(*r) for r in zip(rows["lang"].to_pylist(), rows["phrase"].to_pylist(), strict=True)]
        rows = pa.table({"lang": rows["lang"], "phrase": pa.array(words, pa.string()), "n": rows["n"], "parts": pa.array(parts)})
        return rows.to_batches(max_chunksize=10_000)

    codes(max((len(words) for words, _, _ in known.langs.values()), default=0))
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            rows = step()
            last = held[-1].column("route")[-1].as_py() // IN_BLOCKS
            held, n = [], 0
            same = pc.equal(rows["pivot"], last)
            yield from done(rows.filter(pc.invert(same)))
            open_ = rows.filter(same)
            open_ = open_ if open_.num_rows else None
    if held:
        yield from done(step())
    elif open_ is not None:
        yield from done(open_)


def candidates(docs: DataFrame, words: DataFrame, least: int = LEAST, most: int = DICTIONARY) -> DataFrame:
    """lang, phrase and a, its occurrences, for phrases of 2 to MOST_WORDS words. docs: lang, text; words: written, lang, word, f >= least."""
    rows = words.where(F.octet_length("word") <= WORD_BYTES).orderBy(F.desc("f"), "lang", "word").limit(most).toArrow()  # at most DICTIONARY short words
    dictionary = docs.sparkSession.sparkContext.broadcast(Dictionary(rows, rows.num_rows == words.count()))

    def route(batches):
        known, turn = dictionary.value, TaskContext.get().partitionId()
        for lang, texts in by_lang(batches, CHUNK):
            rows = fragments(lang, texts, known, turn)
            turn += rows.num_rows
            rows = rows.append_column("lang", pa.array([lang] * rows.num_rows, pa.string()))
            yield from rows.cast(pa.schema([("route", pa.int64()), ("fragment", pa.binary()), ("n", pa.int64()), ("lang", pa.string())])).to_batches(max_chunksize=50_000)

    routed = docs.select("lang", "text").mapInArrow(route, "route long, fragment binary, n long, lang string")
    found = routed.repartition(F.shiftright("route", SHIFT)).sortWithinPartitions("route").mapInArrow(lambda bs: mine(bs, least, dictionary.value), "lang string, phrase string, n long, parts boolean")
    found = written(found, "phrases-mined")
    sums = found.where("parts").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return found.where("not parts").select("lang", "phrase", F.col("n").alias("a")).unionByName(sums)


def _between(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("ws", first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, dictionary: int = DICTIONARY) -> DataFrame:
    """The first phrases of each language by score. docs: lang, text."""
    docs = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words = written(counted_words(docs), "phrase-words")
    totals = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    frequent = written(words.where(F.col("f") >= least), "phrase-frequent")
    found = written(candidates(docs, frequent, least, dictionary), "phrase-candidates")

    # a longer phrase has no more occurrences than what it holds, so one word more on either side decides
    longer = found.withColumn("ws", F.split("phrase", " ")).where("size(ws) > 2")
    size = F.size("ws")
    inside = longer.select("lang", F.explode(F.array(_between(1, size - 1), _between(2, size - 1))).alias("phrase"), "a").distinct()
    kept = found.join(inside, ["lang", "phrase", "a"], "left_anti").withColumn("ws", F.split("phrase", " "))

    cut = kept.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.posexplode(F.array(_between(1, F.col("k")), _between(F.col("k") + 1, size - F.col("k")))).alias("side", "part"))
    asked = cut.groupBy("lang", "part").agg(F.count("*").alias("asked"))
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(frequent.select("lang", F.col("word").alias("part"), "f"))
    cut = weighted_lookup(cut, written(asked.join(counts, ["lang", "part"]), "phrase-parts"), ["lang", "part"], "asked")
    sides = {f"{'lr'[s]}{k}": F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))) for k in range(1, MOST_WORDS) for s in (0, 1)}
    rows = lookup(cut.groupBy("lang", "phrase", "a").agg(*(c.alias(name) for name, c in sides.items())), totals, ["lang"])

    def scored(k: int) -> Column:  # exact, in 38 digits
        score = F.expr(f"(1000 * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l{k} as decimal(18,0)) * cast(r{k} as decimal(18,0)))")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    rows = rows.withColumn("best", F.array_min(F.array(*map(scored, range(1, MOST_WORDS))))).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(documents: str = "documents", least: int = LEAST, top: int = TOP) -> str:
    """DuckDB SQL for the rows of query(): it counts every n-gram and compares every phrase with all inside it."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with pieces as (
  select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') as ws
  from (select coalesce(lang, '{NO_LANG}') as lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as t from {documents})),
totals as (select lang, sum(len(ws))::bigint as n from pieces group by 1),
grams as (
  select lang, size, array_to_string(ws[i:i + size - 1], ' ') as phrase
  from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from pieces, unnest(range(1, {MOST_WORDS + 1})) as s(size))),
f as (select lang, size, phrase, count(*) as a from grams group by all having count(*) >= {least}),
candidates as (select *, string_split(phrase, ' ') as ws from f where size > 1),
inside as (
  select distinct lang, a as a_longer, array_to_string(ws[i:i + part - 1], ' ') as phrase
  from (
    select *, unnest(range(1, size - part + 2)) as i
    from candidates, unnest(range(2, {MOST_WORDS})) as p(part)
    where part < size)),
kept as (
  select * from candidates c
  where not exists (select 1 from inside i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.a_longer >= 100 * c.a)),
cuts as (
  select lang, phrase, a, k, array_to_string(ws[:k], ' ') as first, array_to_string(ws[k + 1:], ' ') as rest
  from kept, unnest(range(1, {MOST_WORDS})) as c(k) where k < size),
scores as (
  select c.*, x.a as l, y.a as r, n, (1000 * c.a::hugeint * n::hugeint) // (x.a::hugeint * y.a::hugeint) as score
  from cuts c
  join f x on x.lang = c.lang and x.phrase = c.first
  join f y on y.lang = c.lang and y.phrase = c.rest
  join totals t on t.lang = c.lang),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a, l, r, n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
where rank <= {top}"""
