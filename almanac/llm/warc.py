"""WARC archives: written in gzip members, read back by byte ranges.

Writing: each page is a record, a gzip member of its own, in an archive file of
each task. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes,
that with the largest page_id is a response and the others revisit it.

Reading: the archives are split into byte ranges, a row each. A task scans its
range for the gzip magic, takes a place for a member only if its first bytes
inflate to a WARC version line, and owns the records that start in its range,
also where they end beyond it. So ranges need no index, and no member is read
twice or left out.

Files are reached through the file system of the folder's URI; the folder is in
the shared folder, and a task that is run again writes a file of another name,
of which only that of the committed attempt is listed.

Defined results: a null html is an empty payload; of repeated rows with the
largest page_id of equal payloads all are responses; a null page_id is kept as
such, and revisits where another page with its payload has an id; columns
other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import cut, shared_dir, table

REVISIT_BYTES = 1000
#: Bytes of an archive in a range; most tasks that the ranges are shared out to.
RANGE = 16 << 20
MOST_TASKS = 20_000
#: Up to so many repeated digests (about 60 bytes each) are broadcast; beyond, the payloads are shuffled to join them.
BROADCAST_DIGESTS = 200_000
_CHUNK = 1 << 20
_PIECE = 1 << 16
_MAGIC = b"\x1f\x8b\x08"
_DATE = "2024-01-01T00:00:00Z"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (SHA-1), refers_to: which page each page revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    size = F.octet_length("payload")
    first = rows.select("page_id", "digest", size.alias("size")).where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = cut(first)
    first = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    revisits = (size >= REVISIT_BYTES) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(revisits, F.col("first")).alias("refers_to"))


def _id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(said: str) -> int | None:
    number = said.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write the archives; path and size of each."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        path, out = f"{root}/{uuid.uuid4().hex}.warc.gz", None
        for batch in batches:
            if batch.num_rows and out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(path, compression=None, buffer_size=_CHUNK)
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                out.write(_member(record(*row)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [store.get_file_info(path).size]}, schema=pa.schema([("path", pa.string()), ("size", pa.int64())]))

    return planned.mapInArrow(written, "path string, size long")


class _Reader:
    """Bytes of a file by place, a chunk at a time."""

    def __init__(self, file: pa.NativeFile, at: int, size: int):
        self.file, self.start, self.size, self.data = file, at, size, b""

    def more(self) -> bool:
        end = self.start + len(self.data)
        if end >= self.size:
            return False
        self.file.seek(end)
        self.data += self.file.read(min(_CHUNK, self.size - end))
        return True

    def drop(self, at: int) -> None:
        """Forget what is before a place."""
        self.data, self.start = self.data[at - self.start :], at

    def pieces(self, at: int) -> Iterator[tuple[bytes, int]]:
        """(bytes, place of their end) from a place on; what is not held is read and not kept."""
        for lo in range(at - self.start, len(self.data), _PIECE):
            piece = self.data[lo : lo + _PIECE]
            yield piece, self.start + lo + len(piece)
        at = max(at, self.start + len(self.data))
        while at < self.size:
            self.file.seek(at)
            piece = self.file.read(min(_CHUNK, self.size - at))
            at += len(piece)
            yield piece, at


def _inflated(r: _Reader, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the member at a place; None if none with a WARC record starts there."""
    z, out, checked = zlib.decompressobj(31), bytearray(), False
    for piece, end in r.pieces(at):
        try:
            out += z.decompress(piece)
        except zlib.error:
            return None
        if not checked and len(out) >= 5:
            if out[:5] != b"WARC/":
                return None
            checked = True
        if z.eof:
            return (bytes(out), end - len(z.unused_data)) if checked else None
    return None


def members(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """The content of each member with a WARC record that starts in [start, end)."""
    r, at = _Reader(file, start, size), start
    while at < end:
        found = r.data.find(_MAGIC, at - r.start)
        if found < 0:
            at = max(at, r.start + len(r.data) - len(_MAGIC) + 1)
            r.drop(min(at, r.start + len(r.data)))
            if not r.more():
                return
            continue
        at = r.start + found
        if at >= end:
            return
        got = _inflated(r, at)
        if got is None:
            at += 1
            continue
        content, at = got
        yield content
        r.drop(at)


def parse(content: bytes) -> dict:
    """The fields of a record; the payload (None for a revisit) without HTTP headers."""
    head, _, rest = content.partition(b"\r\n\r\n")
    said = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(said["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = said["warc-type"]
    return {
        "page_id": _page(said["warc-record-id"]),
        "url": said.get("warc-target-uri"),
        "payload_bytes": length if kind == "revisit" else len(payload),
        "payload_digest": said["warc-payload-digest"].partition(":")[2] if kind == "revisit" else hashlib.sha1(payload).hexdigest(),
        "record_type": kind,
        "refers_to": _page(said["warc-refers-to"]) if kind == "revisit" else None,
        "payload": None if kind == "revisit" else payload,
    }


def read(files: DataFrame, folder: str, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """All records of the archives (path, size): a task's rows come from its byte ranges.

    Every response's digest is that of the payload as read.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    n = files.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 0
    # a number of partitions of its own: tasks that adaptive execution would put together are small only in bytes
    ranges = files.select("path", "size", F.explode(starts).alias("start")).repartition(int(min(max(n, 1), MOST_TASKS)))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as file:
                    out: list[dict] = []
                    held = 0
                    for content in members(file, row["size"], row["start"], min(row["size"], row["start"] + range_bytes)):
                        got = parse(content)
                        if not payloads:
                            got["payload"] = None
                        out.append(got)
                        held += len(content) if payloads else 200
                        if held > 8 * _CHUNK:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ranges.mapInArrow(scanned, READ)


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """The pages' records as they are read back from the written archives."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(cut(write(plan(pages), folder)), folder, payloads=payloads)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back."""
    return round_trip(table(spark, sf_dir, "pages"), payloads=False).drop("payload", "url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT body, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY body)
SELECT p.page_id AS page_id, n AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON n >= 1000 AND p.body = f.body
"""
