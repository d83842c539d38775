"""WARC archives: one gzip member per record, written by tasks and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import open_uri, shared_folder
from plumbline.session import stage

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 18
BATCH_BYTES = 8 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the HTTP head of its response but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=URI_SAFE)}"] if url is not None else []),
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"] if kind == "revisit" else []),
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


URI_SAFE = "!#$%&'()*+,/:;=?@[]~"  # what may stand in a URI; all else is percent-encoded, line ends included


@dataclass
class _Member:
    """The record that is being decompressed: framed by Content-Length, block digest on the way."""

    head: bytearray = field(default_factory=bytearray)
    fields: dict | None = None
    left: int = 0
    block: bytearray = field(default_factory=bytearray)
    tail: bytearray = field(default_factory=bytearray)
    sha: object = field(default_factory=hashlib.sha1)

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            version, *lines = bytes(self.head[:end]).decode().split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            self.fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            self.left = int(self.fields["content-length"])
            data = bytes(self.head[end + 4:])
        now = data[:self.left]
        self.left -= len(now)
        self.sha.update(now)
        self.block += now
        self.tail += data[len(now):]

    def finish(self) -> dict:
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("a record's length does not match its Content-Length")
        if self.fields["warc-block-digest"] != "sha1:" + base64.b32encode(self.sha.digest()).decode():
            raise ValueError(f"block digest of {self.fields['warc-record-id']} does not match")
        http, _, payload = bytes(self.block).partition(b"\r\n\r\n")
        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        kind = self.fields["warc-type"]
        digest = self.fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
            raise ValueError(f"payload of {self.fields['warc-record-id']} does not match its length or digest")
        number = lambda k: int(self.fields[k]) if k in self.fields else None
        return {
            "page_id": number("x-page-id"), "url": self.fields.get("warc-target-uri"), "record_id": self.fields["warc-record-id"],
            "record_type": kind, "payload_bytes": size, "payload_digest": digest,
            "refers_to": number("x-refers-to-page-id"), "payload": payload if kind == "response" else None,
        }


def read_records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """The records of one archive in order: one gzip member each, decompressed piece by piece, lengths and digests checked."""
    unzip, member, data = zlib.decompressobj(31), _Member(), b""
    begun = pending = False
    while pending or data or (data := stream.read(chunk)):
        begun = True
        piece = unzip.decompress(data, CHUNK)
        pending = len(piece) == CHUNK  # more output may wait although the input is used up
        member.feed(piece)
        data = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
        if unzip.eof:
            yield member.finish()
            unzip, member, begun, pending = zlib.decompressobj(31), _Member(), False, False
    if begun:
        raise ValueError("the archive ends inside a record")


SCHEMA = "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]


def write_warc(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write a record per page to archives under ``folder`` and return their list ``(path, records, bytes)``.

    Payload: the html in UTF-8 (null: empty). Of records with equal payloads of at least ``min_bytes`` bytes, that
    with the largest id is a response and the others are revisits of it; smaller ones are all responses. Equal payloads
    meet by digest: the largest id is aggregated per task first and joined back, so a payload that a third of the
    pages share is split like any skewed join. A task streams its rows into one archive, named by attempt and listed
    only if the task succeeds; a repeated task writes another file, so readers that go by the list see every record once.

    Defined cases: rows that repeat both the largest id and the payload are all responses; null ids revisit the
    largest id, and where all ids are null all are responses; a null url leaves out the target; an empty table gives
    no archives.
    """
    data = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), data.alias("payload"), F.sha1(data).alias("digest"))
    # Staged, so that this side has a shuffle of its own and a digest with very many pages can be split.
    last = stage(pages.select(F.col(id).cast("long").alias("page_id"), F.sha1(data).alias("digest"), F.octet_length(data).alias("size"))
            .where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last")), "digests")
    joined = rows.join(last, "digest", "left").select("page_id", "url", "payload", "last")
    target = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        path = f"{target}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            for page_id, link, payload, last_id in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system, name = open_uri(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(name, compression=None)
                kind = "response" if last_id is None or page_id == last_id else "revisit"
                item = record(kind, page_id, link, payload, sha1_base32(payload), last_id, date)
                out.write(item)
                n, size = n + 1, size + len(item)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return stage(joined.mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_warc(archives: DataFrame) -> DataFrame:
    """The records of the listed archives, payloads included; each archive is one sequential task-local read.

    Rows leave in batches of bounded size. A truncated member, a wrong length or a wrong digest is an error.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, TYPES)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = open_uri(path)
                held, size = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream):
                        held.append(r)
                        size += 500 + len(r["payload"] or b"")
                        if size >= BATCH_BYTES:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    paths = archives.select("path")
    return paths.repartition(max(1, archives.count()), F.xxhash64("path")).mapInArrow(read, SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "warc")
