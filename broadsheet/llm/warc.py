"""WARC archives as a Spark data source in Python: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans a partition per file, takes record-type and header predicates down (spark.sql.python.filterPushdown.enabled must be on; the
option ``types`` names record types, too), parses a record's headers before its block, and skips the blocks that nobody wants: those of records that fail a
predicate, and all with option ``payload`` = false. Archives are compressed record by record; the skip-lengths field of a record's
gzip header tells where the next begins.

Writing: of records with equal payloads of at least LEAST_BYTES bytes, that of the largest page_id is a response and the others are revisits of it;
smaller ones are all responses. Null html is an empty payload. Rows that repeat a page_id with its payload are responses alike. A null page_id
yields to any other. A null url leaves its header out. Only files that a manifest names count, so a task that ran twice leaves nothing behind. An empty
table makes an archive without records; other columns don't matter. Records are held whole, one at a time, and no longer than a string can be.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from broadsheet.storage import materialise, new_path

LEAST_BYTES = 1000
#: A file ends after the record that brings it to so many bytes; a file is a unit of reading.
FILE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
MANIFEST = "_manifest.json"
VERSION = b"WARC/1.1"
#: Fixed value: the profile of revisits with an identical payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(row: dict, date: str) -> bytes:
    """One record, uncompressed."""
    size, digest = row["payload_bytes"], base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (row["payload"] or b"" if row["record_type"] == "response" else b"")
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _record_id(row["page_id"])), ("WARC-Date", date)]
    if row["target_uri"] is not None:
        head.append(("WARC-Target-URI", quote(row["target_uri"], safe=":/?#[]@!$&'()*+,;=%-._~")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if row["page_id"] is not None:
        head.append(("Page-ID", str(row["page_id"])))
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(row["refers_to"])), ("Refers-To-Page-ID", str(row["refers_to"]))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head), b"", block, b"", b""])


def member(data: bytes) -> bytes:
    """A gzip member whose header names its own length and that of its content (skip-lengths)."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head, tail = struct.pack("<4BI2BH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, 24 + len(body) + 8, len(data) & 0xFFFFFFFF), struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return head + body + tail


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:20]!r}")
    whole: list[bytes] = []
    for x in lines[1:]:
        if x[:1] in (b" ", b"\t") and whole:  # a folded line goes on with the one before
            whole[-1] += b" " + x.strip()
        elif x:
            whole.append(x)
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in whole)}


class _Window:
    """Bytes of a file from a position on, read on demand."""

    def __init__(self, f: BinaryIO, step: int = 1 << 16):
        self.f, self.step, self.held = f, step, b""
        here = f.tell()
        self.left = f.seek(0, 2) - here
        f.seek(here)

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.f.read(max(self.step, n - len(self.held)))):
            self.held += more
        return self.held[:n]

    def skip(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise EOFError("a record is cut off")
        if n > len(self.held):
            self.f.seek(n - len(self.held), 1)
            self.held = b""
        else:
            self.held = self.held[n:]


def records(f: BinaryIO, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers of every record, with its block where wanted(headers) says so. Plain files and files of gzip members; one that is cut off is an error."""
    w = _Window(f)
    while start := w.peek(24):
        if start[:2] != b"\x1f\x8b":
            if start[:1] in b"\r\n":  # more empty lines than there should be
                w.skip(1)
                continue
            at, n = -1, 1 << 12
            while (at := w.peek(n).find(b"\r\n\r\n")) < 0:
                if len(w.peek(n)) < n:
                    raise EOFError("a record is cut off")
                n *= 2
            head = _headers(w.peek(at))
            w.skip(at + 4)
            size = int(head["content-length"])
            block = w.peek(size) if wanted(head) else None
            w.skip(size + 4)  # the block's end, too, has to be there
            yield head, block
            continue
        known = struct.unpack_from("<I", start, 16)[0] if start[3] == 4 and start[12:14] == b"sl" else None
        inflate, at, seen, text = zlib.decompressobj(31), -1, 0, b""
        while at < 0 and not inflate.eof:  # as much as holds the headers
            piece = w.peek(seen + w.step)[seen:] if not inflate.unconsumed_tail else b""
            if not piece and not inflate.unconsumed_tail:
                raise EOFError("a record is cut off")
            seen += len(piece)
            text += inflate.decompress(inflate.unconsumed_tail + piece, 1 << 12)
            at = text.find(b"\r\n\r\n")
        head = _headers(text[:at])
        size = int(head["content-length"])
        take = wanted(head)
        if take or known is None:
            parts = [text]
            while not inflate.eof:
                piece = w.peek(seen + w.step)[seen:] if not inflate.unconsumed_tail else b""
                if not piece and not inflate.unconsumed_tail:
                    raise EOFError("a record is cut off")
                seen += len(piece)
                more = inflate.decompress(inflate.unconsumed_tail + piece, 1 << 20)
                if take:
                    parts.append(more)
            block = b"".join(parts)[at + 4 : at + 4 + size] if take else None
            w.skip(seen - len(inflate.unused_data))
        else:
            block = None
            w.skip(known)
        yield head, block


def sha1_of(labelled: str) -> str | None:
    """The lower-case hex of a labelled SHA-1 digest in base 32 or 16, of either case; None for other digests."""
    label, _, value = labelled.partition(":")
    if label.strip().lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip()
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def row(head: dict[str, str], block: bytes | None) -> dict:
    """The columns of a record: of HTTP messages the payload is what follows their headers, of all else it is the block.

    A revisit's size is that of the full payload, as its HTTP headers state it, or null. A payload that doesn't have its SHA-1 digest is an error,
    unless it is in a transfer encoding; records without such a digest get it worked out.
    """
    out = {
        "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"),
        "page_id": int(head["page-id"]) if "page-id" in head else None, "refers_to": int(head["refers-to-page-id"]) if "refers-to-page-id" in head else None,
        "payload_digest": sha1_of(head.get("warc-payload-digest", "")), "payload_bytes": None, "payload": None,
    }
    if block is None:
        return out
    http, payload = b"", block
    if head.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    if out["record_type"] == "revisit":
        out["payload_bytes"] = int(said[b"content-length"]) if said.get(b"content-length", b"").isdigit() else None
        return out
    digest = hashlib.sha1(payload).hexdigest()
    if out["payload_digest"] not in (None, digest) and b"transfer-encoding" not in said:
        raise ValueError(f"the payload of {out['record_id']} doesn't have its digest")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": out["payload_digest"] or digest}


@dataclass
class ArchiveFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


#: Columns that predicates can be tested on before a block is read, and their headers.
_HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "page_id": "page-id", "refers_to": "refers-to-page-id"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, tuple[str, ...] | None]] = []
        if options.get("types"):
            self.tests.append(("warc-type", tuple(options["types"].split(","))))

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            header = _HEADER_OF.get(name)
            if header and isinstance(f, IsNotNull):
                self.tests.append((header, None))
            elif header and isinstance(f, EqualTo):
                self.tests.append((header, (str(f.value),)))
            elif header and isinstance(f, In):
                self.tests.append((header, tuple(map(str, f.value))))
            else:
                yield f

    def partitions(self):
        fs, path = _filesystem(self.path)
        if fs.get_file_info(path).is_file:
            return [ArchiveFile(path)]
        manifest = fs.get_file_info(f"{path}/{MANIFEST}")
        if manifest.is_file:
            with fs.open_input_stream(manifest.path) as f:
                return [ArchiveFile(f"{path}/{x}") for x in json.loads(f.read())]
        return [ArchiveFile(x.path) for x in fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True)) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]

    def _passes(self, head: dict[str, str]) -> bool:
        return all(h in head if values is None else head.get(h) in values for h, values in self.tests)

    def read(self, partition: ArchiveFile | None):
        if partition is None:
            return
        fs, _ = _filesystem(self.path)
        rows, size = [], 0
        with fs.open_input_file(partition.path) as f:
            for head, block in records(f, lambda h: self.payload and self._passes(h)):
                if self._passes(head):
                    rows.append(row(head, block))
                    size += 500 + len(block or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator):
        fs, path = _filesystem(self.path)
        task, files, out, size = TaskContext.get(), [], None, 0
        fs.create_dir(path, recursive=True)
        try:
            for batch in iterator:
                for k in range(0, batch.num_rows, 64):
                    for r in batch.slice(k, 64).to_pylist():
                        if out is None:
                            files.append(f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files):04d}.warc.gz")
                            out, size = fs.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                        data = member(record(r, self.date))
                        out.write(data)
                        size += len(data)
                        if size >= FILE_BYTES:
                            out.close()
                            out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages):
        fs, path = _filesystem(self.path)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(f"{path}/{x}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def with_revisits(pages: DataFrame) -> DataFrame:
    """The rows to write: SCHEMA without record_id, payloads of revisits left out. Only digests are grouped, never payloads."""
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    p = p.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    copies = p.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = materialise(copies, "copies")  # its size is known then: a small table is broadcast and payloads stay where they are
    joined = p.join(copies, "payload_digest", "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.lit(None).cast("string").alias("record_id"), "page_id", "target_uri",
        "payload_digest", "payload_bytes", F.when(again, F.col("keeper")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str | None = None) -> str:
    """Archive pages under path (a new one in the shared folder by default), which it returns."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    path = path or new_path(spark, "warc")
    with_revisits(pages).write.format("warc").mode("append").save(path)
    return path


def read(spark, path: str, **options: str) -> DataFrame:
    """Records under path. The source takes predicates down, which needs the session's setting for it; this turns it on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)
