"""WARC archives: a writer with revisit records, and a sequential reader.

An archive is a file of gzip members, one a record. The reader takes a file as a stream: it inflates a member piece by
piece, finds the header's end, frames the block by Content-Length, checks that the record ends with two line ends and the
member with the record, and holds block and payload digests against what it has read. A record in memory is the most that
reader and writer keep.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_AT_A_TIME = 1 << 18


class WarcError(ValueError):
    """A stream that isn't framed as WARC records in gzip members."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head; empty for a revisit."""
        return self.block.partition(END)[2]

    @property
    def http(self) -> dict[str, str]:
        return _headers(self.block.partition(END)[0].partition(b"\r\n")[2])

    def verified(self) -> bool:
        """Whether the digests in the header are those of the block and, in a response, of the payload."""
        fine = self.headers.get("warc-block-digest") == f"sha1:{digest(self.block)}"
        return fine and (self.kind != "response" or self.headers.get("warc-payload-digest") == f"sha1:{digest(self.payload)}")


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def member(headers: Iterable[tuple[str, str]], block: bytes, level: int = 3) -> bytes:
    """A record as a gzip member of its own."""
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n".encode()
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(END) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> list:
    """Headers and block of a response, or of a revisit of the response of page refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", " ".join(url.split())))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return [headers, block]


def read(stream: BinaryIO) -> Iterator[Record]:
    """The records of an archive, one after another."""
    rest = b""
    while rest or (rest := stream.read(READ_AT_A_TIME)):
        z, data = zlib.decompressobj(31), bytearray()

        def more() -> bool:
            """Inflates some more of this member; False at its end."""
            nonlocal rest
            if z.eof:
                return False
            if not rest and not (rest := stream.read(READ_AT_A_TIME)):
                raise WarcError("the stream ends within a member")
            try:
                data.extend(z.decompress(rest))  # noqa: B023
            except zlib.error as e:
                raise WarcError(str(e)) from e
            rest = z.unused_data  # noqa: B023
            return True

        seen = 0
        while (end := data.find(END, max(seen - 3, 0))) < 0:
            seen = len(data)
            if not more():
                raise WarcError("a record without the end of its header")
        first, _, lines = bytes(data[:end]).partition(b"\r\n")
        headers = _headers(lines)
        if not first.startswith(b"WARC/") or not headers.get("content-length", "").isdigit():
            raise WarcError(f"no WARC record: {first[:40]!r}")
        start, size = end + 4, int(headers["content-length"])
        while more():
            if len(data) > start + size + 4:
                raise WarcError("a record longer than its Content-Length")
        if bytes(data[start + size :]) != END:
            raise WarcError("a record that doesn't end where its Content-Length says")
        yield Record(headers, bytes(data[start : start + size]))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, gs) or of a local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(pages: DataFrame, folder: str, least: int = 0, roll: int = 1 << 30, date: str = "2024-01-01T00:00:00Z", level: int = 3, shares: int = 10_000) -> DataFrame:
    """Writes a record per row of pages(page_id, url, html) into archives in folder; returns (path, records, bytes).

    The payload is html in UTF-8, null being empty. Among equal payloads of `least` bytes or more, the rows of the
    smallest page_id are responses and others revisit them; smaller payloads are responses all. A null page_id comes
    after all others; where a payload has null ids alone, all are responses. A task writes archives of about `roll`
    bytes under names of their own, and what counts is the returned list: a task that fails or runs twice leaves
    files that nothing reads.

    Payloads that make up one row in `shares` or more, of which there are `shares` at most, are looked up in a broadcast,
    and their rows are dealt by page; so no task gets more than that share of the rows for the sake of one payload.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body")).withColumn("sha", F.sha1("body"))
    first = pages.select("page_id", F.sha1(body).alias("sha"), F.length(body).alias("n")).filter(F.col("n") >= least)
    first = first.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    often = F.col("n") * shares >= pages.count()
    hot = first.filter(often).select("sha", F.col("first").alias("hot"), F.lit(True).alias("is_hot"))
    rows = rows.join(F.broadcast(hot), "sha", "left")
    alone = F.concat("sha", F.lit(" "), F.xxhash64("page_id", "url").cast("string"))  # meets nothing
    rows = rows.withColumn("key", F.when(F.col("is_hot") | (F.length("body") < least), alone).otherwise(F.col("sha")))
    rows = rows.join(first.filter(~often).select(F.col("sha").alias("key"), "first"), "key", "left").withColumn("first", F.coalesce("hot", "first"))
    revisit = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "body", revisit.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, done, name, n = None, None, [], "", 0
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    at, base = opened(folder)
                    at.create_dir(base, recursive=True)
                    name, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = at.open_output_stream(name, compression=None)
                out.write(member(*page_record(page_id, url, payload, refers_to, date), level))
                n += 1
                if out.tell() >= roll:
                    done.append((name, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, n, out.tell()))
            out.close()
        if done:
            paths = [f"{folder}/{p.rpartition('/')[2]}" for p, _, _ in done]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return stored(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, verified boolean, payload binary"


def scan(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives(path), in RECORD's columns; payload null unless asked for, and for revisits.

    payload_bytes and payload_digest are of the full payload, for a revisit as its HTTP head and header have them.
    A file that isn't framed as WARC fails the query; a record whose digests differ has verified false.
    """
    n = max(archives.count(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_()), ("payload", pa.binary())])
        for b in batches:
            for path in b.column(0).to_pylist():
                at, name = opened(path)
                rows, size = [], 0
                with at.open_input_stream(name, compression=None) as f:
                    for r in read(f):
                        number = lambda key: int(v) if (v := r.headers.get(key, "").removeprefix("<urn:page:").rstrip(">")).lstrip("-").isdigit() else None  # noqa: E731, B023
                        body = r.payload if r.kind == "response" else None
                        length = len(body) if body is not None else int(r.http.get("content-length", 0))
                        rows.append((number("warc-record-id"), r.headers.get("warc-target-uri"), r.kind, length, r.headers.get("warc-payload-digest", "").removeprefix("sha1:"), number("warc-refers-to"), r.verified(), body if payload else None))
                        size += length
                        if size >= 1 << 24 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("path").repartition(n).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """The records of pages, written to archives in the shared folder and read back."""
    return scan(write(pages, shared_dir(pages.sparkSession, "warc"), least), payload=False)
