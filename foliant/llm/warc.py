"""WARC archives: writing pages as gzip members, and a splittable reader over byte ranges."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, shared_path, small_or_shuffled

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range that one task scans, bytes read at a time, least payload that a revisit stands for.
RANGE, CHUNK, LEAST_PAYLOAD = 8 << 20, 1 << 20, 100


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; executors reach the shared folder by it whatever store it is in."""
    uri = re.sub(r"^file:/+", "/", uri)
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def _line(value: object) -> str:
    """A value as header text: line breaks and other control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC 1.1 record: response with an HTTP block and payload, or revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{url}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else _line(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "X-Page-Id": page_id,
        "X-Refers-To-Page-Id": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def plan_revisits(pages: DataFrame, scratch: Scratch, least: int = LEAST_PAYLOAD) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the smallest page_id of an equal payload of at least `least` bytes.

    It is null for the rows that carry that smallest id, for smaller payloads and for rows with a null page_id.
    Only (digest, page_id) is shuffled, summed on the map side first; what comes back holds the revisits alone.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    slim = scratch.table(pages.where(F.octet_length(html) >= least).select("page_id", F.sha2(html, 256).alias("digest")), "digests")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = scratch.table(slim.join(first, "digest").where("page_id > refers_to").select(F.col("page_id").alias("_id"), "refers_to", F.col("digest").alias("_digest")).distinct(), "revisits")
    on = (F.col("page_id") == F.col("_id")) & (F.sha2(html, 256) == F.col("_digest"))
    return pages.join(small_or_shuffled(again, 96), on, "left").drop("_id", "_digest")


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, level: int = 5) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) to folder, a gzip member per record; returns the archives (path, size).

    A task writes one file under a name of its own and returns it; the returned table is what counts, so files of
    attempts that failed are never read. html is written in UTF-8 (null: empty).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        path, size = f"{base}/part-{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(path, compression=None) as out:
            for b in batches:
                for page_id, url, html, ref in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                    data = member(record(page_id.as_py(), url.as_py(), payload, hashlib.sha256(payload).hexdigest(), ref.as_py(), ref.as_py() is not None), level)
                    out.write(data)
                    size += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], ["path", "size"])

    return scratch.table(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, size long"), "archives")


class RangeReader:
    """Records of the gzip members that start in [start, end) of a file.

    The range is searched for gzip magic; a candidate counts only if it inflates to a WARC header block. Once a
    member is found the next one starts where it ends. A member may end past the range; its bytes are read on.
    """

    def __init__(self, file, size: int, start: int, end: int):
        self.file, self.size, self.end = file, size, end
        self.base, self.data, self.start = start, b"", start

    def _fill(self, upto: int) -> bool:
        """Whether the byte before `upto` has been read, which is done if the file has it."""
        while self.base + len(self.data) < min(upto, self.size):
            at = self.base + len(self.data)
            got = self.file.read_at(min(CHUNK, self.size - at), at)
            if not got:
                break
            self.data += got
        return self.base + len(self.data) >= upto

    def _drop(self, upto: int) -> None:
        self.data, self.base = self.data[upto - self.base :], upto

    def _header_at(self, at: int) -> bool:
        """Whether a member that inflates to a WARC header block, however long, starts at a position."""
        z, out, k, end = zlib.decompressobj(31), bytearray(), at, -1
        try:
            while end < 0 and not z.eof:
                if not self._fill(k + 1):
                    return False
                part = self.data[k - self.base : k - self.base + 4096]
                seen = max(0, len(out) - 3)
                out += z.decompress(part)
                k += len(part)
                if not b"WARC/1.".startswith(out[:7]):
                    return False
                end = out.find(b"\r\n\r\n", seen)
        except zlib.error:
            return False
        return end >= 0 and b"\nContent-Length:" in out

    def _member(self, at: int) -> tuple[bytes, int]:
        """The data of the member at a position and where the next begins."""
        z, out, k = zlib.decompressobj(31), [], at
        while not z.eof:
            if not self._fill(k + 1):
                raise EOFError(f"member at {at} is cut short")
            part = self.data[k - self.base : k - self.base + CHUNK]
            out.append(z.decompress(part))
            k += len(part)
        return b"".join(out), k - len(z.unused_data)

    def records(self) -> Iterator[bytes]:
        at = self.start
        while at < self.end:
            self._drop(at)
            if not self._fill(at + 3):
                return
            if self.data[:3] != MAGIC or not self._header_at(at):
                found = self.data.find(MAGIC, 1)
                at = self.base + (found if found >= 0 else max(1, len(self.data) - 2))
                continue
            data, at = self._member(at)
            yield data


def parse(data: bytes) -> dict:
    """Fields of a record: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    The payload's digest and size are computed from it; a revisit has none, so its headers tell them.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1]) if revisit else len(payload)
    digest = fields["WARC-Payload-Digest"].partition(":")[2] if revisit else hashlib.sha256(payload).hexdigest()
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-Id")}


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True, width: int = RANGE) -> DataFrame:
    """Records of the archives (path, size): a row each, a task per byte range of about `width` bytes."""
    ranges = archives.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(width).cast("long"))).alias("start"))
    n = max(1, ranges.count())
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields], [k for k, _ in fields])

        for b in batches:
            for path, size, start in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                fs, own = open_fs(path)
                with fs.open_input_file(own) as file:
                    rows, held = [], 0
                    for data in RangeReader(file, size, start, min(size, start + width)).records():
                        rows.append(parse(data))
                        held += len(data)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return ranges.repartition(min(n, 100_000), "path", "start").mapInArrow(run, schema)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = write_archives(plan_revisits(pages, scratch), shared_path(spark, "warc"), scratch)
    return read_archives(spark, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select *, min(page_id) over (partition by digest) as first from p)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id > first then first end as refers_to
from f
"""
