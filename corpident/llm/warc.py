"""WARC archives as a chunked record table.

Writing. Payloads are cut into chunks of at most CHUNK bytes; each chunk becomes a WARC
record (the first a response, further ones continuations, with segment numbers) and carries
the digest of the payload up to its end. Spark's text sink writes them: a WARC record ends in
two line breaks, which is the sink's line separator, so any file system that Spark knows
will do, and the commit protocol covers lost executors. Files are gzip-compressed and so
never split.

Reading. Spark's text source hands over what stands between double line breaks, in file
order. A parser puts the byte stream together again, follows Content-Length, and emits chunk
rows while it keeps one running digest; it holds one chunk at most.

Equal payloads of at least `min_revisit` bytes: the row with the largest id is the response,
the others are revisits of it, with the full payload's size and digest in their headers.

Nulls and edge cases: a null payload is empty; rows with a null id are always responses and
are never referred to; rows of the largest id among equal payloads are all responses when
they repeat; repeated rows are records of their own; a null url is written as an empty one; an
empty table writes no record; other columns are ignored. Payloads may hold anything, also
text that looks like a WARC header.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join

CHUNK = 1 << 20
MIN_REVISIT = 1000
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, chunk_no int, last boolean, payload_bytes long, payload_digest string, chunk binary"


def duplicates(pages: DataFrame, id_col: str, payload: Column, min_revisit: int) -> DataFrame:
    """(_page, _digest, refers_to) of the rows whose payload another row of larger id has."""
    rows = pages.select(F.col(id_col).cast("long").alias("_page"), F.sha1(payload).alias("_digest"), F.octet_length(payload).alias("n")).where((F.col("n") >= min_revisit) & F.col("_page").isNotNull())
    rows = rows.select("_page", "_digest").distinct()  # repeated rows once
    top = rows.groupBy("_digest").agg(F.max("_page").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1")
    return spread_join(rows, top, "_digest", "rows", "_page").where("_page <> refers_to").select("_page", "_digest", "refers_to")


def record_id(page: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}/{nth}')}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def records(page: int | None, url: str | None, payload: memoryview, digest: str, refers_to: int | None, chunk: int) -> Iterator[bytes]:
    """The WARC records of one page, without the two line breaks that end each."""
    uri = "".join(c for c in url or "" if c > " ")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-Id", page)]
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page, digest, 1)), *common]
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest, 1)), ("X-Refers-To-Page-Id", refers_to)]
        yield _header([*fields, ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(HTTP))]) + HTTP
        return
    running, n = hashlib.sha1(), max(1, -(-len(payload) // chunk))
    for i in range(n):
        part = payload[i * chunk : (i + 1) * chunk]
        running.update(part)
        block = len(part) + (len(HTTP) if i == 0 else 0)
        kind = [("WARC-Type", "response" if i == 0 else "continuation"), ("WARC-Record-ID", record_id(page, digest, i + 1)), *common]
        segment = [("WARC-Segment-Number", i + 1)] if n > 1 else []
        if i:
            segment.append(("WARC-Segment-Origin-ID", record_id(page, digest, 1)))
        if n > 1 and i == n - 1:
            segment.append(("WARC-Segment-Total-Length", len(payload) + len(HTTP)))
        fields = [*kind, *segment, ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Digest-So-Far", f"sha1:{running.hexdigest()}"), ("X-Last-Segment", int(i == n - 1)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", block)]
        yield b"".join([_header(fields), HTTP if i == 0 else b"", part])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, chunk: int = CHUNK) -> None:
    """Writes one record per row, or more for payloads over chunk bytes, as gzip WARC files under path."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    refers = duplicates(pages, id_col, payload, min_revisit)
    rows = rows.join(refers, (F.col("page") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            pages_, urls, digests, to = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i in range(batch.num_rows):
                for r in records(pages_[i], urls[i], memoryview(batch.column(2)[i].as_buffer()), digests[i], to[i], chunk):
                    out.append(r)
                    size += len(r)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


class Parser:
    """Takes the pieces between double line breaks, gives chunk rows."""

    def __init__(self) -> None:
        self.rest, self.fields, self.running, self.total = b"", None, None, 0

    def feed(self, piece: bytes) -> Iterator[tuple]:
        self.rest = b"".join([self.rest, piece, END]) if self.rest else piece + END
        while True:
            if self.fields is None:
                head = self.rest.find(END)
                if head < 0:
                    return
                lines = self.rest[:head].decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
                self.fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                self.rest = self.rest[head + 4 :]
            n = int(self.fields["content-length"])
            if len(self.rest) < n + 4:
                return
            yield self._row(self.rest[:n])
            self.rest, self.fields = self.rest[n + 4 :], None
            # a file's last payload ended in a line break: its last piece had no separator after it
            if piece == b"\r\n" and self.rest == END:
                self.rest = b""

    def _row(self, block: bytes) -> tuple:
        f = self.fields
        page, to = f.get("x-page-id"), f.get("x-refers-to-page-id")
        page, to = (None if x is None else int(x) for x in (page, to))
        if f["warc-type"] == "revisit":
            return (f["warc-record-id"], page, "revisit", to, 1, True, int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha1:"), b"")
        nth = int(f.get("warc-segment-number", 1))
        if nth == 1:
            self.running, self.total, block = hashlib.sha1(), 0, block[block.index(END) + 4 :]
        self.running.update(block)
        self.total += len(block)
        now = self.running.hexdigest()
        if f"sha1:{now}" != f["x-digest-so-far"]:
            raise ValueError(f"damaged payload in {f['warc-record-id']}")
        origin = f.get("warc-segment-origin-id", f["warc-record-id"])
        return (origin, page, "response", None, nth, f["x-last-segment"] == "1", self.total, now, block)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives under path, see CHUNKS. payload_bytes and payload_digest
    run up to the chunk's end; in the last chunk they are the whole payload's."""
    names = ["record_id", "page_id", "record_type", "refers_to", "chunk_no", "last", "payload_bytes", "payload_digest", "chunk"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser()
        for batch in batches:
            out, size = [], 0
            for piece in batch.column(0):
                for row in parser.feed(piece.as_py()):
                    size += len(row[-1])
                    out.append(row if payloads else (*row[:-1], None))
                    if size > 1 << 23:
                        yield table(out)
                        out, size = [], 0
            yield table(out)
        if parser.rest or parser.fields:
            raise ValueError("an archive ends inside a record")

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    lines = spark.read.option("lineSep", END.decode()).schema("value string").text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, CHUNKS)
