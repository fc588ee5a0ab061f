"""WARC archives: writing one gzip member per record, and a splittable reader.

Writing: of records with equal payloads the one with the largest id becomes a
response, the others revisits that name it. Each task writes its records as one
archive under a temporary name and renames it; the rows it returns say which
archives count, so a lost or repeated task leaves no half archive behind them.

Reading: a task gets a byte range of an archive. It scans for the gzip magic,
takes a candidate as a member only if it decodes and its text opens with a WARC
version line, and owns the members that start inside its range; the last one may end beyond it.

Archives lie in the shared folder; any folder that Arrow's filesystems open by URI will do.

Defined cases: a null payload is empty; equal payloads below ``least`` bytes are all responses; records
that share the largest id of their payload are all responses; a null id never
becomes the response of others unless all ids are null; no rows, no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import land
from faultscope.sources.tables import shared_folder

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range of the reader, of one read, and of a header.
RANGE, STEP = 8 << 20, 1 << 20
LEVEL = 3
#: Reading tasks, as long as there are as many ranges (more where the cluster has more cores).
TASKS = 64
CONTROL = re.compile(r"[\x00-\x20\x7f]")
DIGEST = re.compile(rb"sha1:([A-Z2-7]{32})")


def _open(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url: str | None, payload: bytes, sha1: str, refers_to) -> bytes:
    """One WARC record. A revisit carries the size and digest of the payload it leaves out."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {CONTROL.sub(lambda m: quote(m[0]), url or '')}", f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Full-Payload-Length: {len(payload)}",
    ]
    body = b""
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    else:
        body = payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def with_kinds(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html, kind, refers_to``: which payloads are stored and which only referred to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("keep")).where("n > 1").drop("n")
    joined = rows.join(groups, "digest", "left")
    alone = F.col("digest").isNotNull() & (F.octet_length("html") < least) | F.col("keep").isNull() | F.col("page_id").eqNullSafe(F.col("keep"))
    return joined.select("page_id", "url", "html", F.when(alone, "response").otherwise("revisit").alias("kind"), F.when(~alone, F.col("keep")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``page_id, url, html, kind, refers_to`` as archives; ``(file, size, records)`` of those that count."""
    target = f"{folder or shared_folder(rows.sparkSession)}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]):
        name, out, files, path = uuid.uuid4().hex, None, None, ""
        size = count = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("kind", "page_id", "url", "html", "refers_to")]
            for kind, page_id, url, html, refers_to in zip(*columns, strict=True):
                if out is None:
                    files, base = _open(target)
                    files.create_dir(base, recursive=True)
                    path = f"{base}/{name}"
                    out = files.open_output_stream(path + ".tmp")
                payload = html.as_py().encode()
                data = record(kind.as_py(), page_id.as_py(), url.as_py(), payload, digest(payload), refers_to.as_py())
                press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                packed = press.compress(data) + press.flush()
                out.write(packed)
                size += len(packed)
                count += 1
        if out is not None:
            out.close()
            files.move(path + ".tmp", path + ".warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([f"{target}/{name}.warc.gz"]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["file", "size", "records"])

    return land(rows.mapInArrow(write, "file string, size long, records long"), "archives")


def _member(stream, at: int, size: int, first: bytes) -> tuple[bytes, int] | None:
    """The decoded member at ``at`` and its end, or None if it is no WARC record."""
    inflate, out, offset, data = zlib.decompressobj(31), [], at, first
    have, checked = 0, False
    while True:
        if not data:
            if offset >= size:
                return None
            stream.seek(offset)
            data = stream.read(min(STEP, size - offset))
        try:
            got = inflate.decompress(data)
        except zlib.error:
            return None
        offset += len(data)
        data = b""
        out.append(got)
        have += len(got)
        if not checked and have >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            checked = True
        if inflate.eof:
            return (b"".join(out), offset - len(inflate.unused_data)) if checked else None


def members(stream, size: int, start: int, end: int) -> Iterator[bytes]:
    """The decoded records whose members start in ``[start, end)``."""
    at, buffer, base = start, b"", start
    while at < end:
        # Look for the next magic from `at`; the buffer holds the bytes from `base` on.
        if at < base or at - base + len(MAGIC) > len(buffer):
            stream.seek(at)
            buffer, base = stream.read(min(STEP, size - at)), at
            if len(buffer) < len(MAGIC):
                return
        found = buffer.find(MAGIC, at - base)
        if found < 0:
            at = base + len(buffer) - len(MAGIC) + 1
            if base + len(buffer) >= size:
                return
            continue
        at = base + found
        if at >= end:
            return
        got = _member(stream, at, size, buffer[found:])
        if got is None:
            at += 1
            continue
        yield got[0]
        at = got[1]


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = [x.partition(b":") for x in head.split(b"\r\n")[1:]]
    fields = {k.strip().lower(): v.strip() for k, _, v in lines}
    return {"fields": fields, "body": rest[: int(fields.get(b"content-length", b"0"))]}


RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_archives(archives: DataFrame, chunk: int = RANGE) -> DataFrame:
    """All records of ``(file, size)`` rows, each read by the task whose byte range it starts in."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(chunk).cast("long"))).alias("start")
    # A range row is a few bytes, so their number and not their size has to decide how many tasks read: given
    # outright, it is not merged afterwards.
    count = archives.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk)))).first()[0] or 1
    tasks = min(int(count), max(TASKS, 8 * archives.sparkSession.sparkContext.defaultParallelism))
    ranges = archives.select("file", "size", starts).repartition(tasks)

    def number(value: bytes | None):
        digits = re.sub(rb"^<urn:page:|>$", b"", value or b"")
        return int(digits) if digits else None

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, path = _open(row["file"])
                rows, held = [], 0
                with files.open_input_file(path) as stream:
                    for data in members(stream, row["size"], row["start"], min(row["start"] + chunk, row["size"])):
                        parsed = parse(data)
                        fields, body = parsed["fields"], parsed["body"]
                        kind = fields.get(b"warc-type", b"").decode()
                        sha1 = DIGEST.fullmatch(fields.get(b"warc-payload-digest", b""))
                        known = int(fields.get(b"warc-full-payload-length", b"%d" % len(body)))
                        if kind == "response" and (len(body) != known or sha1 is None or digest(body) != sha1[1].decode()):
                            raise ValueError(f"damaged record in {row['file']}")
                        rows.append((number(fields.get(b"warc-record-id")), fields.get(b"warc-target-uri", b"").decode(), kind,
                                     number(fields.get(b"warc-refers-to")), sha1[1].decode() if sha1 else None, known, body))
                        held += len(body)
                        if held > 4 << 20:
                            yield _table(rows)
                            rows, held = [], 0
                if rows:
                    yield _table(rows)

    def _table(rows):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])

    return ranges.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, least: int = 0, chunk: int = RANGE) -> DataFrame:
    """One row per page, read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    archives = write_archives(with_kinds(pages, least))
    return read_archives(archives, chunk).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
