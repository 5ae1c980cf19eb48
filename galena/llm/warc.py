"""WARC archives: a writer and a sequential reader, one gzip member per record."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_path

#: Equal payloads from this many bytes on are stored once.
LEAST_SHARED = 1000
#: A task begins another archive when one has as many bytes.
ARCHIVE_BYTES = 64 << 20
#: Groups of equal payloads up to this number (a few MB) are broadcast; more of them are joined by a shuffle.
BROADCAST_GROUPS = 50_000
#: Compression, and bytes read at once.
LEVEL, CHUNK = 5, 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URI_SAFE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")


class WarcError(ValueError):
    """A record that breaks the format or does not match its digest."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """The body of a stored HTTP response; empty for a revisit."""
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


def digest_header(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def digest_hex(header: str | None) -> str | None:
    return base64.b32decode(header.partition(":")[2]).hex() if header else None


def encode_record(headers: Iterable[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of one gzip member after the other; no more than one member and one chunk are held."""
    data = stream.read(chunk)
    while data:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                raise WarcError("the archive ends within a gzip member")
            try:
                parts.append(z.decompress(data))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            data = z.unused_data if z.eof else stream.read(chunk)
        yield b"".join(parts)
        data = data or stream.read(chunk)


def parse_record(raw: bytes, verify: bool = True) -> Record:
    """Header lines, then as many bytes as Content-Length says, then two line ends."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not headers.get("content-length", "").isdigit():
        raise WarcError("no Content-Length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the member has {len(rest) - 4}")
    out = Record(headers, rest[:n])
    if verify:
        for name, data in (("warc-block-digest", out.block), ("warc-payload-digest", None if headers.get("warc-type") == "revisit" else out.payload)):
            if data is not None and name in headers and headers[name] != digest_header(hashlib.sha1(data).digest()):
                raise WarcError(f"{name} does not match")
    return out


def read_records(stream, verify: bool = True, chunk: int = CHUNK) -> Iterator[Record]:
    for raw in members(stream, chunk):
        yield parse_record(raw, verify)


def open_uri(uri: str, mode: str):
    """A file in a folder that all machines share, or in a store that pyarrow knows."""
    if uri.startswith(("file:", "/")):
        path = "/" + uri.removeprefix("file:").lstrip("/")
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if mode == "wb" else store.open_input_stream(path)


def _page_records(batch: pa.RecordBatch) -> Iterator[bytes]:
    for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
        payload = html or b""
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        kind, block = ("response", head + payload) if refers is None else ("revisit", head)
        name = f"page/{page_id}"
        headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
        headers += [("WARC-Target-URI", quote(url, safe=URI_SAFE))] if url is not None else []
        headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest_header(hashlib.sha1(payload).digest())), ("WARC-Block-Digest", digest_header(hashlib.sha1(block).digest()))]
        headers += [("Page-Id", str(page_id))] * (page_id is not None)
        if refers is not None:
            other = uuid.uuid5(uuid.NAMESPACE_URL, f"page/{refers}")
            headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{other}>"), ("Refers-To-Page-Id", str(refers)), ("Payload-Length", str(len(payload)))]
        yield encode_record(headers, block)


def write_archives(pages: DataFrame, folder: str, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) into archives under folder; gives their list: path,
    records, bytes.

    Of rows whose payloads are equal and have least_shared bytes or more, that with the largest page_id is a response,
    the others revisit it; rows that share that page_id are all responses. A null html is an empty payload, a null
    page_id or url has no header, and a row without page_id is always a response. An attempt of a task writes files of
    its own, and the list, itself a table that Spark commits, names those of the attempt that counted.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    digest = F.sha1("html")
    shared = rows.where(F.octet_length("html") >= least_shared).groupBy(digest.alias("_digest")).agg(F.max("page_id").alias("_last"), F.count("page_id").alias("_n"))
    shared = materialize(shared.where("_n > 1").drop("_n"), "warc-shared")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_GROUPS else shared
    rows = rows.withColumn("_key", F.when(F.octet_length("html") >= least_shared, digest)).join(shared, F.col("_key") == F.col("_digest"), "left")
    rows = rows.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("_last"), F.col("_last")).alias("refers_to"))

    def write(batches):
        task, k, out = TaskContext.get(), 0, None
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for data in _page_records(batch):
                if out is None:
                    path, n, size = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{k}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
                    out = open_uri(path, "wb")
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out, k = None, k + 1
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_pydict({"path": pa.array([x[0] for x in done], pa.string()), "records": pa.array([x[1] for x in done], pa.int64()), "bytes": pa.array([x[2] for x in done], pa.int64())})

    return materialize(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-list")


def read_archives(archives: DataFrame, payloads: bool = True, verify: bool = True) -> DataFrame:
    """A row per record of the archives (column path): page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (hex), and payload unless payloads is false. A revisit's payload is null, its size and digest are
    those of the full payload. A broken record raises WarcError, which names the fault."""
    n = archives.count()
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_uri(path, "rb") as f:
                    for r in read_records(f, verify):
                        h, again = r.headers, r.headers["warc-type"] == "revisit"
                        data = None if again else r.payload
                        number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                        url = unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None
                        size = number("payload-length") if again else len(data)
                        hexed = digest_hex(h.get("warc-payload-digest")) if again or verify else hashlib.sha1(data).hexdigest()
                        rows.append((number("page-id"), url, h["warc-type"], number("refers-to-page-id"), size, hexed) + (data,) * payloads)
                        held += len(data or b"") if payloads else 100
                        if held >= 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
        if rows:
            yield pack(rows)

    return archives.select("path").repartition(max(1, n)).mapInArrow(read, schema)


def query(pages: DataFrame) -> DataFrame:
    folder = shared_path(pages.sparkSession, "warc")
    out = read_archives(write_archives(pages.select("page_id", "url", "html"), folder), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id < last THEN last END AS refers_to FROM m
"""
