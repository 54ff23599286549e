"""Chat formatting: typed content parts become text with placeholders, a loss mask and attachment records.

A turn's content is a plain text, or parts in a JSON array: {"type": "text", "text": ..}, {"type": "image", "ref": ..,
"width": .., "height": ..}, {"type": "audio", "ref": .., "seconds": ..}, {"type": "document", "ref": .., "pages": ..} or a
document with "parts" of its own, to any depth. A visitor flattens them in order: texts are escaped, and each image,
audio or document becomes the placeholder `<|image:0|>`, numbered within its turn, and a record of its reference, the
tokens that the model will put in its place, and where the placeholder stands. A document's own parts follow its placeholder.

A turn is written `<|turn|>role<|content|>`, the content, `<|end|>` and a line feed. Every control string begins
with `<|`, and no other one holds `<`. In texts and roles a backslash becomes two and `<|` becomes `<\\|`; so an escaped text
holds no control string, also not together with what follows it, and a backslash always stands for the character after
it. The loss mask covers the texts of assistants, from the content's start to its end without the closing mark.

Turns are formatted one by one, so a conversation is never gathered: its output is its pieces in the order of its rows. What goes over all of it
(digest() here) streams through sorted pieces and holds one of them at a time.

Defined cases: a null text is empty; a null role is an empty role; content that is no JSON array of parts is plain
text; parts of unknown type are texts of their JSON; null, missing or wrong sizes count as 0 and give 1 token; a null conv_id is a
conversation; turns of equal number are in order of role and piece, nulls first; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

TURN, CONTENT, END, LEARNED = "<|turn|>", "<|content|>", "<|end|>", "assistant"
KINDS = ("image", "audio", "document")
#: Side in pixels of what an image token covers, audio tokens a second, tokens of a document's page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
#: Larger sizes are wrong ones.
LARGEST = 1 << 30

PIECES = "role string, piece string, loss array<struct<start:int,stop:int>>, attachments array<struct<ordinal:int,kind:string,ref:string,tokens:long,at:int>>, expanded_tokens long"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _size(part: dict, name: str) -> float:
    value = part.get(name)
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value <= LARGEST else 0


def _valid(text: str) -> str:
    """With replacement characters for halves of surrogate pairs, which JSON can hold and UTF-8 can't."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Visitor:
    """Flattens parts: text collects the pieces, attachments the records."""

    def __init__(self):
        self.text: list[str] = []
        self.length = 0
        self.attachments: list[tuple] = []

    def add(self, text: str) -> None:
        self.text.append(text)
        self.length += len(text)

    def attach(self, kind: str, part: dict, tokens: float) -> None:
        ref, at, ordinal = part.get("ref"), self.length, len(self.attachments)
        self.attachments.append((ordinal, kind, None if ref is None else _valid(ref) if isinstance(ref, str) else json.dumps(ref), max(1, math.ceil(tokens)), at))
        self.add(f"<|{kind}:{ordinal}|>")

    def visit(self, parts: list) -> None:
        open_ = [iter(parts)]  # instead of recursion, for any depth
        while open_:
            part = next(open_[-1], None)
            if part is None:
                open_.pop()
                continue
            kind = part.get("type") if isinstance(part, dict) else None
            inner = getattr(self, f"visit_{kind if kind in ('text', *KINDS) else 'other'}")(part)
            if inner:
                open_.append(iter(inner))

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        self.add(escaped("" if text is None else _valid(text) if isinstance(text, str) else json.dumps(text)))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil(_size(part, "width") / PATCH) * math.ceil(_size(part, "height") / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, _size(part, "seconds") * AUDIO_RATE)

    def visit_document(self, part: dict) -> list | None:
        self.attach("document", part, _size(part, "pages") * PAGE_TOKENS)
        inner = part.get("parts")
        return [p for p in inner if p is not None] if isinstance(inner, list) else None

    def visit_other(self, part) -> None:
        self.add(escaped(_valid(part) if isinstance(part, str) else json.dumps(part)))


def parts_of(content: str) -> list | None:
    """The parts of a content, or None for plain text."""
    try:
        found = json.loads(content)
    except (ValueError, RecursionError):
        return None
    return [p for p in found if p is not None] if isinstance(found, list) and any(isinstance(p, dict) and "type" in p for p in found) else None


def format_turn(role: str | None, text: str | None, content: str | None = None) -> tuple[str, list[dict], list[tuple], int]:
    """The piece, the loss spans in code points, the attachments, and the tokens that placeholders expand to.

    content holds parts; without any, text is the turn's plain text.
    """
    role, visitor = role or "", Visitor()
    visitor.add(f"{TURN}{escaped(role)}{CONTENT}")
    start = visitor.length
    parts = parts_of(content) if content else None
    visitor.visit(parts) if parts is not None else visitor.add(escaped(text or content or ""))
    loss = [{"start": start, "stop": visitor.length}] if role == LEARNED and visitor.length > start else []
    visitor.add(f"{END}\n")
    return "".join(visitor.text), loss, visitor.attachments, sum(a[3] for a in visitor.attachments)


def formatted(rows: DataFrame, content: str | None = None) -> DataFrame:
    """Each turn as a piece. rows: conv_id, turn, role, text; content names a column of parts in JSON, if there is one.

    Returns conv_id, turn, role, piece, loss (spans in the piece), attachments and expanded_tokens.
    """
    keys = rows.select("conv_id", "turn").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", " + PIECES

    def run(batches):
        loss_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        record = pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("at", pa.int32())])
        for b in small(batches):
            done = [format_turn(*r) for r in zip(*(b.column(c).to_pylist() for c in ("role", "text", "_content")), strict=True)]
            names = [f.name for f in record]
            columns = [
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1] for d in done], loss_type),
                pa.array([[dict(zip(names, a, strict=True)) for a in d[2]] for d in done], pa.list_(record)),
                pa.array([d[3] for d in done], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), *columns], ["conv_id", "turn", "role", "piece", "loss", "attachments", "expanded_tokens"])

    parts = F.col(content).cast("string") if content else F.lit(None).cast("string")
    return rows.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), parts.alias("_content")).mapInArrow(run, schema)


def read(text: str) -> list[tuple[str, str]]:
    """Role and content of the turns of a formatted text; placeholders stay in the content."""
    found, at = [], 0
    while at < len(text):
        body = text.find(CONTENT, at)
        stop = text.find(END, body)
        if not text.startswith(TURN, at) or body < 0 or stop < 0 or text[stop + len(END) : stop + len(END) + 1] != "\n":
            raise ValueError(f"no turn at {at}")
        found.append((unescaped(text[at + len(TURN) : body]), unescaped(text[body + len(CONTENT) : stop])))
        at = stop + len(END) + 1
    return found


def learned(piece: str, loss: list[dict]) -> str:
    """The text under the mask."""
    return "".join(unescaped(piece[s["start"] : s["stop"]]) for s in loss or [])


class _Digest:
    """What a conversation adds up to, piece by piece."""

    def __init__(self, key):
        self.key, self.turns, self.loss, self.n, self.loss_chars, self.chars = key, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, piece: str, loss: list[dict]) -> None:
        for role, text in read(piece):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        under = learned(piece, loss)
        self.loss.update(under.encode())
        self.loss_chars += len(under)
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(pieces: DataFrame) -> DataFrame:
    """A row a conversation with turns, characters and SHA-256 digests, read back from formatted()'s pieces."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches):
        open_ = None
        for b in small(batches):
            done = []
            for key, piece, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "loss")), strict=True):
                if open_ is None or open_.key != key:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Digest(key)
                open_.add(piece, loss)
            if done:
                yield batch(done, b.schema.field("conv_id").type)
            last = b.schema.field("conv_id").type
        if open_ is not None:
            yield batch([open_.row()], last)

    def batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        types = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    in_order = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece").select("conv_id", "piece", "loss")
    return in_order.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts hold what other templates use as control strings.
HOSTILE = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, LEARNED, HOSTILE)], "conv_id long, turn long, role string, text string")
    return digest(formatted(rows.unionByName(more)))


def sql(conversations: str = "conversations") -> str:
    """DuckDB SQL for the rows of query()."""
    marks = len(TURN) + len(CONTENT) + len(END) + 1

    def escaped_length(column: str) -> str:
        return f"length(replace(replace({column}, '\\', '\\\\'), '<|', '<\\|'))"

    return f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from {conversations}
  union all select -7, 0, 'user', '{HOSTILE}'
  union all select -7, 1, '{LEARNED}', '{HOSTILE}')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = '{LEARNED}'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = '{LEARNED}'), '')) as loss_sha256,
       sum({escaped_length('role')} + {escaped_length('text')} + {marks})::bigint as formatted_chars
from turns group by conv_id"""
