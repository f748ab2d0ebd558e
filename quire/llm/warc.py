"""WARC 1.1 writing and sequential reading.

Archives hold one gzip member per record.  The reader streams: it inflates a chunk at a time,
frames each block by its Content-Length, and verifies block and payload digests on the way, so
its memory does not grow with the record or the archive.

Equal payloads of `least` bytes or more are stored once: the record of the largest page_id is the
response, the others are revisits that refer to it.  Archive files lie under spark.checkpoint.dir
and carry the task attempt in their names; a manifest, committed by Spark, names those that count,
so retried or speculative tasks leave no double records.

Defined cases: null html is an empty payload; a row with a null page_id is always a response and
never referred to; rows that share the largest page_id of a payload are all responses; a null or
odd url is written as an escaped URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import new_path, staged

LEAST = 1000
CHUNK = 1 << 16
#: An archive is closed beyond this many compressed bytes.
ARCHIVE_BYTES = 256 << 20
MANIFEST = "path string, records bigint, bytes bigint"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, not compressed.  A revisit keeps the HTTP header, whose length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    urn = "null" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{urn}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._') if url else f'urn:page:{urn}'}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_sha1_label(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: {_sha1_label(hashlib.sha1(block).digest())}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class WarcError(ValueError):
    """A record that is cut, wrongly framed or fails a digest."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_length: int
    payload_digest: bytes
    payload: bytes | None = field(default=None, repr=False)


class _Members:
    """Inflated bytes of one gzip member at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.left, self.inflate = stream, b"", None

    def start(self) -> bool:
        """Moves to the next member; False at the end of the file."""
        if not self.left:
            self.left = self.stream.read(CHUNK)
        self.inflate = zlib.decompressobj(31)
        return bool(self.left)

    def read(self) -> bytes:
        """Some more bytes; b"" at the member's end."""
        while not self.inflate.eof:
            data = self.left or self.stream.read(CHUNK)
            if not data:
                raise WarcError("the archive ends inside a record")
            out = self.inflate.decompress(data, CHUNK)
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                return out
        return b""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(stream, keep_payload: bool = False) -> Iterator[Record]:
    """Records of an archive in order.  stream needs read(n) alone."""
    members = _Members(stream)
    while members.start():
        buffer = b""
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not (more := members.read()):
                raise WarcError("a record without a header's end")
            buffer += more
        headers, buffer = _fields(buffer[:end]), buffer[end + 4 :]
        if "content-length" not in headers:
            raise WarcError("a record without Content-Length")
        length = int(headers["content-length"])
        block, payload = hashlib.sha1(), hashlib.sha1()
        http: dict[str, str] | None = None
        head, kept, seen, size = b"", [], 0, 0
        while seen < length:
            if not buffer and not (buffer := members.read()):
                raise WarcError("a block shorter than its Content-Length")
            part, buffer = buffer[: length - seen], buffer[length - seen :]
            seen += len(part)
            block.update(part)
            if http is None:
                head += part
                if (end := head.find(b"\r\n\r\n")) < 0:
                    continue
                http, part = _fields(head[:end]), head[end + 4 :]
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        while more := members.read():
            buffer += more
        if buffer != b"\r\n\r\n":
            raise WarcError("a record that does not end after its block")
        if headers.get("warc-block-digest", "") != _sha1_label(block.digest()):
            raise WarcError(f"block digest of {headers.get('warc-record-id')}")
        label = headers.get("warc-payload-digest", "")
        if headers.get("warc-type") == "response" and label != _sha1_label(payload.digest()):
            raise WarcError(f"payload digest of {headers.get('warc-record-id')}")
        full = int((http or {}).get("content-length", size))
        if headers.get("warc-type") == "response" and full != size:
            raise WarcError(f"payload length of {headers.get('warc-record-id')}")
        yield Record(headers, http or {}, full, base64.b32decode(label.removeprefix("sha1:")), b"".join(kept) if keep_payload else None)


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, kind, refers_to.  Only payloads that occur twice are on the join's small
    side; the larger side is split by adaptive execution where one payload is frequent."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("_digest"))
    keys = pages.select("page_id", F.sha1(html.cast("binary")).alias("_digest"), F.octet_length(html).alias("_n"))
    twice = (
        keys.filter(F.col("_n") >= least)
        .groupBy("_digest")
        .agg(F.max("page_id").alias("_last"), F.count("*").alias("_c"))
        .filter("_c > 1 AND _last IS NOT NULL")
        .select("_digest", "_last")
    )
    revisit = F.col("_last").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("_last"))
    return rows.join(twice, "_digest", "left").select(
        "page_id",
        "url",
        "html",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("_last")).alias("refers_to"),
    )


def write_archives(plan: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the planned records and returns the committed manifest."""

    def written(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        attempt, number, out, done = TaskContext.get().taskAttemptId(), 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/part-{attempt:010d}-{number:05d}.warc.gz"
                    out, count, size, number = store.open_output_stream(path, compression=None), 0, 0, number + 1
                data = member(record(row["page_id"], row["url"], row["html"].encode(), row["kind"], row["refers_to"]))
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        paths, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"]
        )

    return staged(plan.mapInArrow(written, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the manifest's archives, each read by one task from start to end."""

    def rows(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                out, count = [], 0
                with store.open_input_stream(row["path"], compression=None) as stream:
                    for r in read_records(stream):
                        count += 1
                        h = r.headers
                        out.append({"page_id": _page(h.get("warc-record-id")), "payload_bytes": r.payload_length, "payload_digest": r.payload_digest.hex(), "record_type": h.get("warc-type"), "refers_to": _page(h.get("warc-refers-to"))})
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                if count != row["records"]:
                    raise WarcError(f"{row['path']} has {count} records, its manifest {row['records']}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    spread = manifest.repartition(max(1, min(manifest.count(), 10_000)), F.col("path"))
    return spread.mapInArrow(rows, READ)


def query(pages: DataFrame) -> DataFrame:
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(planned(pages), folder), folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha1(h) AS s FROM p),
m AS (SELECT s, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY s)
SELECT page_id, n AS payload_bytes, d.s AS payload_digest,
 CASE WHEN last IS NOT NULL AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN last IS NOT NULL AND page_id <> last THEN last END AS refers_to
FROM d LEFT JOIN m ON d.s = m.s AND d.n >= 1000
"""
