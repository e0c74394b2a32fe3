"""WARC archives: writing records in segments with chunked transfer framing, and putting them together again.

``write_archives`` makes one record for each row. Of equal payloads one row is the response;
the others become revisit records that refer to it. A block longer than ``segment_bytes``
goes on in continuation records. Files are gzip-compressed text of Spark's own writer, with
``records_per_file`` records of at most ``segment_bytes`` each, so a file has a size bound.

``read_archives`` parses the files, groups the segments of one record by the id of its
origin, orders them by number, compares their length with the stated total and decodes the
chunked framing. Records in one segment are decoded where they are parsed and not shuffled.

Defined results: a null payload is empty; rows that share the largest id of a payload are
all responses; a null id sorts below all others and a payload that only such rows hold is
a response each time; a record with a missing segment, a wrong total or broken framing
keeps its row, with a null payload and ``fault`` set (without its first segment, the row has the origin's id only), as does one of
which two segments of one number differ; records of other kinds (warcinfo, request, metadata) are passed over; an archive may be plain or have
any number of gzip members; a file that is cut off or no WARC file gives its records before that place and one row with nothing but ``fault``; an
empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import frugal, new_path, stash

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
_FIELDS = "record_type string, record_id string, uri string, stated_digest string, refers_to string, segment long, origin string, total long, block binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    hexed = F.sha1(payload)
    out = []
    for k in range(8):  # five hexadecimal digits are four letters
        bits = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("a chunk's size is not hexadecimal")
        n = int(size, 16)
        at = end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk's end is missing")
        parts.append(body[at : at + n])
        at += n + 2


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _records(kind, record_id, uri, digest, refers_to, payload: bytes, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", (uri or "").replace("\r", "%0D").replace("\n", "%0A")), ("Content-Type", "application/http; msgtype=response")]
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *common, ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        yield _head([*fields, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{refers_to}>"), ("Content-Length", len(_HTTP))]) + _HTTP
        return
    block = _HTTP + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield _head([*fields, ("Content-Length", len(block))]) + block
        return
    for k, at in enumerate(range(0, len(block), segment_bytes)):
        part = block[at : at + segment_bytes]
        if k == 0:
            own = [*fields, ("WARC-Segment-Number", 1)]
        else:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{k + 1}>"), *common, ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", k + 1)]
            if at + segment_bytes >= len(block):
                own.append(("WARC-Segment-Total-Length", len(block)))
        yield _head([*own, ("Content-Length", len(part))]) + part


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, segment_bytes: int = 1 << 16, chunk_bytes: int = 1 << 13, records_per_file: int = 4000) -> None:
    """Archive every row; payloads of ``min_revisit_bytes`` or more that are equal are stored once, at the largest id."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "n": F.octet_length("payload").cast("long")})
    # as many groups as there are digests; equal payloads are counted before the shuffle
    # written first: Spark splits the hot keys of a join of tables, not those of a join with an aggregate
    largest = stash(rows.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("response_id")), "responses")
    placed = rows.join(largest, "digest", "left").select("id", "uri", "digest", "payload", F.when(F.col("n") >= min_revisit_bytes, F.col("response_id")).alias("response_id"))

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for id_, uri, digest, payload, response in zip(*[batch.column(c) for c in ("id", "uri", "digest", "payload", "response_id")], strict=True):
                id_, digest, response = id_.as_py(), digest.as_py(), response.as_py()
                revisit = response is not None and response != id_
                refers = f"urn:page:{response}:{digest}" if revisit else None
                for record in _records("revisit" if revisit else "response", f"urn:page:{id_}:{digest}", uri.as_py(), digest, refers, payload.as_py(), segment_bytes, chunk_bytes):
                    out.append(record)
                    held += len(record)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = placed.mapInArrow(frame, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class BrokenArchive(ValueError):
    """What is wrong with a file from some place on."""


#: Bytes that are decompressed at a time, and of a record's header at most.
_PIECE, _LONGEST_HEADER = 1 << 16, 1 << 20


class _Bytes:
    """The text of an archive, gzip-compressed in any number of members or plain, read on little by little."""

    def __init__(self, content: bytes):
        self.content, self.at, self.buffer = memoryview(content), 0, bytearray()
        self.undo = None if bytes(content[:5]) == b"WARC/" else zlib.decompressobj(31)

    def fill(self, upto: int) -> bool:
        """Whether the buffer holds ``upto`` bytes, after reading on as far as it takes."""
        while len(self.buffer) < upto and self.at < len(self.content):
            piece = self.content[self.at : self.at + _PIECE]
            self.at += len(piece)
            if self.undo is None:
                self.buffer += piece
                continue
            try:
                self.buffer += self.undo.decompress(piece)
            except zlib.error as e:
                raise BrokenArchive("not gzip") from e
            if self.undo.eof:  # another member may follow, from where this one ended
                self.at -= len(self.undo.unused_data)
                self.undo = zlib.decompressobj(31)
        return len(self.buffer) >= upto


def _parse(content: bytes) -> Iterator[dict]:
    """The records of one file, in time that grows with its length; BrokenArchive where it can't be read on."""
    text, at = _Bytes(content), 0
    buffer = text.buffer
    while True:
        if at > 1 << 22:
            del buffer[:at]
            at = 0
        seen = at
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0:
            seen = max(at, len(buffer) - 3)
            if len(buffer) - at > _LONGEST_HEADER:
                raise BrokenArchive("header")
            if not text.fill(len(buffer) + 1):
                if buffer[at:].strip():
                    raise BrokenArchive("cut off")
                return
        record, n = _header(bytes(buffer[at:end]))
        start = end + 4
        if not text.fill(start + n + 4):
            raise BrokenArchive("cut off")
        if buffer[start + n : start + n + 4] != b"\r\n\r\n":
            raise BrokenArchive("block length")
        yield record | {"block": bytes(buffer[start : start + n])}
        at = start + n + 4


def _header(head: bytes) -> tuple[dict, int]:
    """A record's named fields, and the length of its block."""
    first, *lines = io.BytesIO(head).readlines()
    fields = {}
    for line in lines:
        name, _, value = line.decode(errors="replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    number = lambda name: int(fields[name]) if fields.get(name, "").isdecimal() else None
    n = number("content-length")
    if not first.startswith(b"WARC/") or n is None or not fields.get("warc-record-id") or not fields.get("warc-type"):
        raise BrokenArchive("header")
    return {
        "record_type": fields["warc-type"],
        "record_id": fields["warc-record-id"].strip("<>"),
        "uri": fields.get("warc-target-uri"),
        "stated_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": (fields.get("warc-refers-to") or "").strip("<>") or None,
        "segment": number("warc-segment-number"),
        "origin": (fields.get("warc-segment-origin-id") or fields["warc-record-id"]).strip("<>"),
        "total": number("warc-segment-total-length"),
    }, n


def _payload(block: bytes) -> tuple[bytes | None, str | None]:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None, "no header"
    if b"transfer-encoding: chunked" not in head.lower():
        return body, None
    try:
        return dechunked(body), None
    except ValueError:
        return None, "framing"


def _whole(segments: list[dict]) -> tuple[bytes | None, str | None]:
    by_number: dict[int, tuple] = {}
    for s in segments:
        if by_number.setdefault(s["segment"], (s["total"], s["block"])) != (s["total"], s["block"]):
            return None, "segments differ"
    order = sorted(by_number)
    if order != list(range(1, len(order) + 1)):
        return None, "segment missing"
    block = b"".join(by_number[k][1] for k in order)
    if by_number[order[-1]][0] != len(block):
        return None, "total length"
    return _payload(block)


_DECODED = "record_type string, record_id string, uri string, stated_digest string, refers_to string, n_segments long, payload binary, fault string"


def _decoded(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["record_type", "record_id", "uri", "stated_digest", "refers_to", "n_segments", "payload", "fault"]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * 8
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response and revisit record, with its decoded payload (null for a revisit) and ``fault`` where it can't be decoded."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out, held = [], 0
                records = _parse(content.as_py())
                while True:
                    try:
                        r = next(records, None)
                    except BrokenArchive as e:
                        out.append({"n_segments": 0, "fault": str(e)})
                        break
                    if r is None:
                        break
                    if r["record_type"] not in _KINDS:
                        continue
                    block = r.pop("block")
                    if r["segment"] is None:
                        payload, fault = (None, None) if r["record_type"] == "revisit" else _payload(block)
                        out.append(r | {"n_segments": 1, "payload": payload, "fault": fault})
                    else:
                        out.append(r | {"block": block})
                    held += len(block)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(out, _PARSED)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, _PARSED)

    # written, so that the files are parsed once for both kinds of records
    parsed = stash(files.mapInArrow(frugal(parse), f"{_FIELDS}, n_segments long, payload binary, fault string"), "warc-records")
    single = parsed.where("segment is null").select("record_type", "record_id", "uri", "stated_digest", "refers_to", "n_segments", "payload", "fault")
    segments = parsed.where("segment is not null")
    # all segments of one record, which is one payload, meet in one row; repeated records are counted
    first = F.col("segment") == 1
    whole = segments.groupBy("origin").agg(
        F.min(F.when(first, F.struct("record_type", "record_id", "uri", "stated_digest", "refers_to"))).alias("head"),
        F.sum(first.cast("long")).alias("copies"),
        F.collect_list(F.struct("segment", "total", "block")).alias("segments"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, head, copies, parts in zip(*[batch.column(c) for c in ("origin", "head", "copies", "segments")], strict=True):
                head, parts = head.as_py(), parts.as_py()
                if head is None:
                    yield from _decoded([(None, origin.as_py(), None, None, None, len({p["segment"] for p in parts}), None, "segment missing")])
                    continue
                payload, fault = _whole(parts)
                n = len({p["segment"] for p in parts})
                for _ in range(copies.as_py()):
                    yield from _decoded([(head["record_type"], head["record_id"], head["uri"], head["stated_digest"], head["refers_to"], n, payload, fault)])

    return single.unionByName(whole.mapInArrow(join, _DECODED))


#: Records that carry payloads, whole or in part; others (warcinfo, request, metadata) are passed over.
_KINDS = ("response", "revisit", "continuation")
_PARSED = pa.schema([
    *[(c, pa.string()) for c in ("record_type", "record_id", "uri", "stated_digest", "refers_to")],
    *[("segment", pa.int64()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary())],
    *[("n_segments", pa.int64()), ("payload", pa.binary()), ("fault", pa.string())],
])


def with_payload_facts(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` and ``payload_digest`` of the full payload; revisits take them from the response they refer to."""
    facts = records.select("record_type", "record_id", "refers_to", "n_segments", "fault", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    facts = stash(facts, "payload-facts")
    responses = facts.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload_bytes").alias("of_bytes"), F.first("payload_digest").alias("of_digest"))
    responses = stash(responses, "responses")  # so that Spark can split a response with very many revisits
    joined = facts.join(responses, "refers_to", "left")
    return joined.select("record_type", "record_id", "refers_to", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "of_digest").alias("payload_digest"), "n_segments", "fault")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Per page, as read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    page_of = lambda c: F.try_to_number(F.split(F.col(c), ":")[2], F.lit("S9999999999999999999")).cast("long")
    return with_payload_facts(read_archives(spark, path)).select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


def python_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
