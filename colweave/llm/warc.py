"""WARC archives: writing with segments and revisits, and segment reassembly on reading.

Records are gzip members.  A block longer than a segment is cut: the first record
carries segment 1, ``continuation`` records carry the others and name it as their
origin; the last one gives the total length.  HTTP bodies use chunked framing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.llm import store
from colweave.session import materialise, ready_workers

SEGMENT_BYTES = 16 << 10
HTTP_CHUNK_BYTES = 8 << 10
MIN_REVISIT_BYTES = 100
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


class ArchiveError(ValueError):
    """A record whose segments, lengths or framing do not fit together."""


def chunked(body: bytes, size: int = HTTP_CHUNK_BYTES) -> bytes:
    """``body`` in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(part), part) for part in (body[i:i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The body of chunked framing; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ArchiveError("chunk without a size line")
        size = int(data[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        part = data[line + 2:line + 2 + size]
        if len(part) != size or data[line + 2 + size:line + 4 + size] != b"\r\n":
            raise ArchiveError("chunk shorter than its size")
        parts.append(part)
        at = line + 4 + size


def http_body(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ArchiveError("HTTP head without an end")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member with one record."""
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(source) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one at a time."""
    unpacker, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or source.read(1 << 20)
        rest = b""
        if not data:
            if parts:
                raise ArchiveError("archive ends within a record")
            return
        parts.append(unpacker.decompress(data))
        if unpacker.eof:
            yield b"".join(parts)
            rest, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ArchiveError("not a WARC record")
    fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ArchiveError("record shorter than its length")
    return fields, rest[:length]


def page_records(page_id, url, payload: bytes, digest: str, number: str, refers_to, revisit: bool, segment_bytes: int):
    """``(is_continuation, member)`` for the records of one page."""
    name = f"<urn:page:{'' if page_id is None else page_id}:{number}>"
    fields = [("WARC-Record-ID", name), ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("Content-Type", "application/http;msgtype=response"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        fields += [("WARC-Type", "revisit"), ("WARC-Refers-To", f"<urn:page:{refers_to}:>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield False, record(fields, HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        yield False, record([*fields, ("WARC-Type", "response")], block)
        return
    yield False, record([*fields, ("WARC-Type", "response"), ("WARC-Segment-Number", "1")], block[:segment_bytes])
    starts = range(segment_bytes, len(block), segment_bytes)
    for k, low in enumerate(starts, 2):
        more = [("WARC-Record-ID", f"{name[:-1]}:{k}>"), ("WARC-Type", "continuation"), ("WARC-Segment-Origin-ID", name),
                ("WARC-Segment-Number", str(k))]
        if low + segment_bytes >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield True, record(more, block[low:low + segment_bytes])


def _write(folder: str, segment_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams: dict[bool, tuple] = {}
        stem = store.attempt_name("pages", "")
        count = 0
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to, revisit = (c[i].as_py() for c in columns)
                for later, data in page_records(page_id, url, payload, digest, f"{stem[6:]}-{count}", refers_to, revisit, segment_bytes):
                    if later not in streams:
                        streams[later] = store.open_output(folder, f"{stem}{'-more' if later else ''}.warc.gz")
                    streams[later][0].write(data)
                count += 1
        for stream, _ in streams.values():
            stream.close()
        if streams:
            yield pa.RecordBatch.from_pydict({"uri": [uri for _, uri in streams.values()]})

    return run


def write_pages(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES,
                segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One record per row of ``pages(page_id, url, html)``; the manifest ``(uri)`` of the archives comes back.

    The payload is the html in UTF-8, null being empty.  Of equal payloads of at least
    ``min_revisit_bytes`` the smallest page_id is written in full and the others as
    revisits; rows that repeat that page_id and payload are written in full too.  Rows
    without a page_id revisit a page that has one, and are in full if there is none.
    Line ends and other odd characters of a URL are percent-encoded, a null URL is empty.

    The first page of a payload is found by a combined aggregate, so a payload that very
    many pages share is one row of the other side of a join that AQE can split.
    Archives are named in the manifest only when their task has ended.
    """
    folder = folder or store.new_folder(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (rows.where(F.length("payload") >= min_revisit_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("first_id")))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    marked = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.col("first_id"), revisit.alias("revisit"))
    return materialise(ready_workers(marked).mapInArrow(_write(folder, segment_bytes), "uri string"))


_RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])
_PARSED = pa.schema([*_RESULT, ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])


def _page_of(name: str) -> int | None:
    """The page_id in a record id; None where it has none."""
    number = name.removeprefix("<urn:page:").split(":")[0]
    return int(number) if number else None


def _payload_row(page_id, block: bytes, declared: str) -> dict:
    body = http_body(block)
    digest = sha256(body).hexdigest()
    if declared != f"sha256:{digest}":
        raise ArchiveError(f"payload of page {page_id} does not have its digest")
    return {"page_id": page_id, "payload_bytes": len(body), "payload_digest": digest, "record_type": "response"}


def _parsed_row(fields: dict[str, str], block: bytes) -> dict:
    kind = fields["warc-type"]
    if kind == "continuation":
        total = fields.get("warc-segment-total-length")
        return {"origin": fields["warc-segment-origin-id"], "segment": int(fields["warc-segment-number"]),
                "total": int(total) if total else None, "block": block}
    page_id = _page_of(fields["warc-record-id"])
    if kind == "revisit":
        return {"page_id": page_id, "payload_bytes": int(fields["x-payload-length"]),
                "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"), "record_type": kind,
                "refers_to": _page_of(fields["warc-refers-to"])}
    if "warc-segment-number" in fields:
        return {"page_id": page_id, "payload_digest": fields["warc-payload-digest"], "origin": fields["warc-record-id"],
                "segment": int(fields["warc-segment-number"]), "block": block}
    return _payload_row(page_id, block, fields["warc-payload-digest"])


def _in_batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("block") or b"")
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with store.open_input(uri) as source:
                    for data in members(source):
                        yield _parsed_row(*parse(data))

    return _in_batches(rows(), _PARSED)


def assembled(segments: list[dict]) -> dict:
    """The page of segments of one origin in ascending order; raises where one is missing."""
    first, last = segments[0], segments[-1]
    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or last["total"] is None:
        raise ArchiveError(f"segments of {first['origin']} are missing")
    block = b"".join(s["block"] for s in segments)
    if len(block) != last["total"]:
        raise ArchiveError(f"segments of {first['origin']} do not have their total length")
    return _payload_row(first["page_id"], block, first["payload_digest"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["origin"] != held[0]["origin"]:
                    yield assembled(held)
                    held = []
                held.append(row)
        if held:
            yield assembled(held)

    return _in_batches(rows(), _RESULT)


def read_pages(manifest: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, one row per page record.

    Whole records are decoded where they are read.  Segments are grouped by origin,
    ordered by number, checked against their total length, decoded from chunked
    framing and checked against their digest; a fault raises :class:`ArchiveError`.
    Payloads of responses are hashed anew; a revisit gives what it declares.
    """
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    parsed = materialise(ready_workers(manifest).select("uri").repartition(tasks)
                         .mapInArrow(_read, f"{kinds}, origin string, segment long, total long, block binary"))
    names = [f.name for f in _RESULT]
    whole = parsed.where("origin IS NULL").select(names)
    cut = (parsed.where("origin IS NOT NULL").repartition(tasks, "origin").sortWithinPartitions("origin", "segment")
           .mapInArrow(_assemble, kinds))
    return whole.unionByName(cut)
