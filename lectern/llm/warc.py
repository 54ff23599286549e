"""WARC archives: written with revisits, segments and chunked framing, and read back.

Writing: pages of equal payloads of at least LEAST bytes are one response, the page with the largest id, and
revisit records that refer to it. A response block is an HTTP response with chunked transfer framing; a block of
more than SEGMENT bytes is cut into a first record and continuation records. Each record is a gzip member of its
own, as the format's standard layout is, and a file begins with a warcinfo record. Files hold about FILE_BYTES.
Spark's text sink writes them, one row a file, to any file system that Spark reaches; it puts one zero byte at a
file's end, which gzip takes as padding. With gzip=False the files are plain, with their records in a row.

Reading: plain files and files of any number of gzip members, from this or another writer, are decompressed in
pieces, so a task holds a file as it is stored and one record; Spark's binaryFile takes files of up to 2 GB.
Continuations are grouped by the identifier of their origin, ordered by segment number and put together; their
numbers and the total length are verified, the chunked framing is decoded and SHA-1 payload digests are verified.
A revisit gets the length and the page of the response whose record it refers to. Records of other kinds, as
requests and metadata, have no rows.

Defined cases: a null html is an empty payload; a null page_id is written as none and read as null, as are those of
other writers; repeated rows of one id and payload are all responses if their id is the largest; characters that may
not stand in a header are percent-encoded; a revisit whose response isn't in the archive is kept, without a length;
a broken record, a file cut off or a missing segment raises an error, or with keep_broken is a row of the type
"broken" with its error; an empty table and an empty folder give an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, grouped, new_path, parts, small, weighted_lookup, written

SEGMENT, CHUNK, FILE_BYTES, LEAST = 8192, 2048, 16 << 20, 0
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_JOINED = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its length says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, without its framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\s*$", head) else body


def record_id(*of) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, of)))}>"


def record(kind: str, id_: str, uri: str | None, block: bytes, **fields) -> bytes:
    """A record without the two line ends after it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", f"WARC-Date: {DATE}"] + [f"WARC-Target-URI: {uri}"] * (uri is not None)
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _uri(url: str | None, page_id) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def responses(page_id, url: str | None, payload: bytes, segment: int = SEGMENT) -> list[bytes]:
    """The response record of a page, and its continuations."""
    block, own, uri = _HTTP + chunked(payload), digest(payload), _uri(url, page_id)
    id_, pieces = record_id(page_id, own), [block[at : at + segment] for at in range(0, len(block), segment)]
    fields = {"WARC_Payload_Digest": f"sha1:{own}", "X_Page_Id": page_id, "Content_Type": "application/http; msgtype=response"}
    out = [record("response", id_, uri, pieces[0], **fields, WARC_Segment_Number=1 if len(pieces) > 1 else None)]
    for n, piece in enumerate(pieces[1:], 2):
        out.append(record("continuation", record_id(page_id, own, n), uri, piece, WARC_Segment_Origin_ID=id_, WARC_Segment_Number=n, WARC_Segment_Total_Length=len(block) if n == len(pieces) else None))
    return out


def write(pages: DataFrame, path: str, least: int = LEAST, gzip: bool = True) -> None:
    """Archives of pages (page_id, url, html) at path."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    keys = written(rows.select("page_id", "url", "sha", F.octet_length("payload").alias("size")), "warc-keys")
    origins = written(keys.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("origin"), F.count("*").alias("n")).where("n > 1"), "warc-origins")
    revisits = written(weighted_lookup(keys, origins, ["sha"], "n").where(~F.col("page_id").eqNullSafe(F.col("origin"))).select("page_id", "url", "sha", "origin"), "warc-revisits")
    gone = revisits.select(F.col("page_id").alias("_p"), F.col("sha").alias("_s")).distinct()
    gone = F.broadcast(gone) if revisits.count() <= BROADCAST_ROWS else gone
    first = rows.join(gone, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("sha") == F.col("_s")), "left_anti").select("page_id", "url", "payload")

    def page_records(batches):
        for b in small(batches):
            for p, u, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                yield from responses(p, u, payload)

    def revisit_records(batches):
        for b in small(batches):
            for p, u, sha, o in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                own = base64.b32encode(bytes.fromhex(sha)).decode()
                yield record("revisit", record_id(p, own), _uri(u, p), b"HTTP/1.1 200 OK\r\n\r\n", WARC_Profile=PROFILE, WARC_Refers_To=record_id(o, own), WARC_Payload_Digest=f"sha1:{own}", X_Page_Id=p, X_Refers_To_Page_Id=o)

    def files(records):
        return lambda batches: (pa.RecordBatch.from_arrays([pa.array([f], pa.binary())], ["file"]) for f in archives(records(batches), gzip))

    made = first.mapInArrow(files(page_records), "file binary").unionByName(revisits.mapInArrow(files(revisit_records), "file binary"))
    made.select(F.col("file").cast("string")).write.option("lineSep", "\0" if gzip else "\n").option("maxRecordsPerFile", 1).text(path)


def member(record_: bytes) -> bytes:
    """A record and its two line ends as a gzip member."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(record_ + _END) + c.flush()


def archives(records, gzip: bool = True):
    """Contents of files of about FILE_BYTES, each begun by a warcinfo record whose id its first record decides."""
    held, size = [], 0
    for r in records:
        if not held:
            info = record("warcinfo", record_id("info", hashlib.sha1(r).hexdigest()), None, b"format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields")
            held = [member(info) if gzip else info + _END]
        held.append(member(r) if gzip else r + _END)
        size += len(held[-1])
        if size >= FILE_BYTES:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def pieces(data, size: int = 1 << 18):
    """The uncompressed bytes of a file, plain or of any number of gzip members, in pieces."""
    data = memoryview(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[at : at + size]) for at in range(0, len(data), size))
        return
    at = 0
    while at < len(data):
        if not data[at]:  # padding between or after members
            at += 1
            continue
        d, step = zlib.decompressobj(31), 1 << 12  # members are often small, and what is left over is copied
        while not d.eof:
            if at >= len(data):
                raise ValueError("the file ends inside a gzip member")
            some = data[at : at + step]
            step = min(4 * step, size)
            out = d.decompress(some, 4 * size)
            at += len(some) - len(d.unconsumed_tail) - len(d.unused_data)
            yield out


def parse(given):
    """(fields, block) of each record of an archive, given as bytes or in pieces."""
    source, held, at = iter([given] if isinstance(given, bytes) else given), bytearray(), 0

    def more() -> bool:
        some = next(source, None)
        held.extend(some or b"")
        return some is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if bytes(held).strip(b"\r\n\0"):
                raise ValueError(f"no whole record at byte {at}: {bytes(held[:40])!r}")
            return
        head = held[:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}: {head[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        if not fields.get("content-length", "").isdigit() or not {"warc-type", "warc-record-id"} <= fields.keys():
            raise ValueError(f"the record at byte {at} has no type, identifier or length")
        start = end + 4
        end = start + int(fields["content-length"])
        while len(held) < end + 4 and more():
            pass
        if len(held) < end:
            raise ValueError(f"the record at byte {at} is cut off")
        if held[end : end + 4] != _END:
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield fields, bytes(held[start:end])
        del held[: end + 4]
        at += end + 4


def _verified(block: bytes, expected: str | None, http: bool = True) -> tuple[int, str, bytes]:
    payload = payload_of(block) if http else block
    own = digest(payload)
    if expected is not None and expected.lower().startswith("sha1:") and len(expected) == 37 and expected[5:].upper() != own:
        raise ValueError(f"payload digest {own} instead of {expected}")
    return len(payload), own, payload


_PARSED = "kind string, key string, segment int, total long, page_id long, refers string, refers_to long, size long, digest string, http boolean, block binary"
_ROW = pa.schema([("kind", pa.string()), ("key", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("refers", pa.string()), ("refers_to", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("http", pa.bool_()), ("block", pa.binary())])


def read(spark: SparkSession, path: str, payloads: bool = False, keep_broken: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; with payloads the payloads of responses.

    keep_broken: a broken record, and what can't be read after it in its file, is a row with its error.
    """

    def row(f: dict, block: bytes) -> dict:
        whole = lambda k: int(f[k]) if k in f else None
        out = {"kind": f["warc-type"], "key": f.get("warc-segment-origin-id", f["warc-record-id"]), "segment": whole("warc-segment-number"), "total": whole("warc-segment-total-length")}
        out |= {"page_id": whole("x-page-id"), "refers": f.get("warc-refers-to", ""), "refers_to": whole("x-refers-to-page-id"), "size": None, "digest": f.get("warc-payload-digest"), "block": None}
        out["http"] = f.get("content-type", "application/http").lower().startswith("application/http")
        if out["segment"] is not None:
            out["block"] = block
        elif out["kind"] == "response":
            out["size"], own, payload = _verified(block, out["digest"], out["http"])
            out |= {"digest": f"sha1:{own}", "block": payload if payloads else None}
        return out

    def records(batches):
        for b in batches:
            for content in b.column("content"):
                rows, held = [], 0
                try:
                    for f, block in parse(pieces(content.as_buffer())):
                        if f["warc-type"] in ("response", "revisit", "continuation"):
                            rows.append(row(f, block))
                            held += len(rows[-1]["block"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ROW)
                            rows, held = [], 0
                except (ValueError, zlib.error) as e:
                    if not keep_broken:
                        raise
                    rows.append({"kind": "broken", "digest": str(e)})
                yield pa.RecordBatch.from_pylist(rows, _ROW)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    parsed = written(found.select("content").mapInArrow(records, _PARSED), "warc-parsed")
    cut = parsed.where("segment is not null").repartition(parts(spark), "key").sortWithinPartitions("key", "page_id", "segment")

    def join(batches):
        for t in grouped(batches, ["key"]):
            number, blocks, totals = t["segment"].to_pylist(), t["block"].to_pylist(), t["total"].to_pylist()
            order = sorted(range(len(number)), key=number.__getitem__)
            copies = max(number.count(1), 1)  # equal pages repeated, with equal segments
            order, number = order[::copies], sorted(number)[::copies]
            block = b"".join(blocks[i] for i in order)
            total = next((x for x in totals if x is not None), None)
            try:
                if number != list(range(1, len(order) + 1)) or total != len(block):
                    raise ValueError(f"segments {number} with {len(block)} of {total} bytes for {t['key'][0]}")
                size, own, payload = _verified(block, t["digest"][order[0]].as_py(), t["http"][order[0]].as_py())
                error = None
            except ValueError as e:
                if not keep_broken:
                    raise
                size, own, payload, copies, error = None, None, None, 1, str(e)
            page = t["page_id"][order[0]].as_py()
            yield pa.RecordBatch.from_pylist([{"key": t["key"][0].as_py(), "page_id": page, "payload_bytes": size, "payload_digest": own, "payload": payload if payloads else None, "error": error}] * copies, _JOINED)

    segmented = cut.select("key", "segment", "total", "page_id", "digest", "http", "block").mapInArrow(join, "key string, page_id long, payload_bytes long, payload_digest string, payload binary, error string")
    whole = parsed.where("segment is null and kind = 'response'").select("key", "page_id", F.col("size").alias("payload_bytes"), F.expr("substring(digest, 6)").alias("payload_digest"), F.col("block").alias("payload"), F.lit(None).cast("string").alias("error"))
    response = written(whole.unionByName(segmented), "warc-responses")
    revisit = parsed.where("kind = 'revisit'").select("page_id", "refers", F.col("refers_to").alias("named"), F.expr("substring(digest, 6)").alias("payload_digest"))
    asked = revisit.groupBy("refers").agg(F.count("*").alias("n"))
    sizes = response.where("error is null").groupBy(F.col("key").alias("refers")).agg(F.min(F.struct("page_id", "payload_bytes")).alias("r"))
    asked = written(asked.join(sizes, "refers", "left").select("refers", "n", "r.payload_bytes", F.col("r.page_id").alias("found")), "warc-referred")
    revisit = weighted_lookup(revisit, asked, ["refers"], "n").withColumn("refers_to", F.coalesce("found", "named"))
    none, columns = lambda kind, name: F.lit(None).cast(kind).alias(name), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    columns += ["payload"] * payloads + ["error"] * keep_broken
    out = response.select("*", F.when(F.col("error").isNull(), "response").otherwise("broken").alias("record_type"), none("long", "refers_to")).select(*columns)
    out = out.unionByName(revisit.select("*", F.lit("revisit").alias("record_type"), none("binary", "payload"), none("string", "error")).select(*columns))
    if keep_broken:
        broken = parsed.where("kind = 'broken'").select("page_id", none("long", "payload_bytes"), none("string", "payload_digest"), F.lit("broken").alias("record_type"), none("long", "refers_to"), none("binary", "payload"), F.col("digest").alias("error"))
        out = out.unionByName(broken.select(*columns))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read(spark, path)


def sql() -> str:
    """DuckDB SQL for the rows of query()."""
    base32 = "array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || sha[(i // 8) * 10 + 1:(i // 8) * 10 + 10])::bigint >> (35 - 5 * (i % 8))::bigint) & 31) + 1]), '')"
    return f"""
with p as (select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as sha from pages),
o as (select *, max(page_id) over (partition by sha) as origin from p)
select page_id, octet_length(payload) as payload_bytes, {base32} as payload_digest, case when octet_length(payload) < {LEAST} or page_id = origin then 'response' else 'revisit' end as record_type, case when octet_length(payload) < {LEAST} or page_id = origin then null else origin end as refers_to from o"""
