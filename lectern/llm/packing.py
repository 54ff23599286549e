"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Documents become token ids; those longer than a sequence are cut. Only the number of pieces of each length goes
to the driver, at most `capacity` rows whatever the corpus. Best fit decreasing runs over those counts: a whole
run of equal pieces is put into a whole run of equal sequences in one step. The plan comes back as runs of
slots (length, first rank, sequences, offset), is spread into one row a slot on the executors, and each piece
takes the slot of its rank among the pieces of its length, by an equality join on (length, rank).

Ranks are counted without a task that sees all pieces of a length: pieces are numbered within buckets of a hash
of their key, and the buckets' sizes are summed up. A length has a bucket for each BUCKET_ROWS of its pieces, as
counted, so that the whole sequences of long texts don't meet in few tasks.

Defined cases: a null text is an empty one, which is the single id 1; equal rows are packed each; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

CAPACITY, END_ID, BUCKET_ROWS = 4096, 1, 2_000
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker keeps; beyond that it starts anew.
KEPT = 200_000

#: The tokenizer's pre-split, for the lower-case letters and the numbers below U+0180.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿā-ſ", "0-9²³¹¼½¾"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
#: Outside of these characters lower case, normal form or white space need the tokenizer itself.
_ODD = re.compile("[^\x00-ſ]|İ")

_tokenizers: dict[str, Ids] = {}


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases and never merges across white space or its pre-split, so in plain texts each word
    is tokenized once and then looked up. Texts with other characters go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x180)}

    def _new(self, run: str) -> bytes:
        """Ids of a run without white space that isn't known yet."""
        known = self.known
        if run.isalpha():
            found = known[run] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(run.translate(self.letters))])
            return found
        if run[-1] in ".," and (stem := run[:-1]).isalpha():
            return (known.get(stem) or self._new(stem)) + known[run[-1]]
        found = b"".join([known.get(w) or self._word(w) for w in _SPLIT.findall(run)])
        if len(run) < 8:
            known[run] = found
        return found

    def _word(self, word: str) -> bytes:
        found = self.known[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word.translate(self.letters))])
        return found

    def _plain(self, text: str) -> bool:
        if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not _ODD.search(text)

    def __call__(self, text: str) -> bytes:
        if not self._plain(text):
            return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        if len(self.known) > KEPT or not self.known:
            self.known.clear()
            for mark in ".,":
                self._word(mark)
        get, new = self.known.get, self._new
        return b"".join([get(r) or new(r) for r in text.lower().split()])


def tokenizer(path: str) -> Ids:
    if path not in _tokenizers:
        _tokenizers[path] = Ids(path)
    return _tokenizers[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 and, if asked for, ids (bytes, 4 for each id)."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def cut(batches):
        encode = tokenizer(path or default_path())
        for batch in small(batches):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            take, cols = [], ([], [], [], [], [])
            for row, text in enumerate(texts):
                raw = encode(text or "") + end_id.to_bytes(4, "little")
                for k, b in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[b : b + 4 * capacity]
                    take.append(row)
                    for c, v in zip(cols, (k, b // 4, len(part) // 4, zlib.crc32(part), part if ids else None), strict=True):
                        c.append(v)
            arrays = [keys.take(pa.array(take, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            names = [id_column, "piece", "start", "length", "ids_crc32"]
            if ids:
                arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_column}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over counts: runs (length, first rank, n, first sequence, offset).

    The pieces of a length with ranks from the first rank on, n of them, lie at the offset of n sequences from
    the first sequence on. Open sequences are kept as runs by the space left in them.
    """
    open_runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left: (first sequence, how many)
    spaces: list[int] = []
    runs, fresh = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if not open_runs[space]:
                bisect.insort(spaces, space)
            heapq.heappush(open_runs[space], (first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit in {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = heapq.heappop(open_runs[space])
                used = min(n, left)
                if not open_runs[space]:
                    spaces.pop(at)
                put(space, first + used, n - used)
                runs.append((length, rank, used, first, capacity - space))
                put(space - length, first, used)
            else:
                each = capacity // length
                full, more = divmod(left, each)
                for first, n, k in ((fresh, full, each), (fresh + full, min(more, 1), more)):
                    for i in range(k if n else 0):
                        runs.append((length, rank, n, first, i * length))
                        rank += n
                    put(capacity - k * length, first, n)
                fresh += full + min(more, 1)
                break
            left, rank = left - used, rank + used
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id") -> DataFrame:
    """cut (a written table of pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    sizes = cut.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in sizes.toLocalIterator()}  # at most capacity rows
    runs = plan(counts, capacity)
    schema = "length long, rank0 long, n long, sequence0 long, offset long"
    slots = written(spark.createDataFrame(runs, schema).repartition(8), "pack-plan") if runs else spark.createDataFrame([], schema)
    slots = slots.select("length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("_i", "_n"), "rank0", "sequence0", "offset")
    slots = slots.select("length", (F.col("rank0") + F.col("_n")).alias("_rank"), (F.col("sequence0") + F.col("_n")).alias("sequence_id"), "offset")

    buckets = spark.createDataFrame([(k, -(-n // BUCKET_ROWS)) for k, n in counts.items()], "length long, _of long")  # at most capacity rows
    # With a number of the row, so that repeats of one row are spread too; written, as the number is read twice.
    keyed = cut.join(F.broadcast(buckets), "length").withColumn("_b", F.pmod(F.xxhash64(id_column, "piece", "ids_crc32", F.monotonically_increasing_id()), F.col("_of"))).drop("_of")
    keyed = written(keyed, "pack-buckets")
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(keyed.groupBy("length", "_b").count().select("length", "_b", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first")), "pack-ranks")
    within = Window.partitionBy("length", "_b").orderBy(id_column, "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1)
    # The window has dealt the pieces by the same keys already, and no bucket is large.
    ranked = ranked.join(firsts, ["length", "_b"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    # As many slots as pieces: never broadcast.
    return ranked.join(slots.hint("merge"), ["length", "_rank"]).select(*cut.columns, "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(written(pieces(docs), "pack-pieces"))
