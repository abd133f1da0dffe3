"""Operator 2: WARC archives, written from and read as chunked record tables.

A payload travels as rows (record, chunk number, bytes), so neither the writer
nor the reader ever holds more than a chunk of it; both carry the SHA-1 digest
on from chunk to chunk. Every record is a gzip member of its own. Archives lie
in a folder that all executors share, under names that hold the task attempt;
only the files of attempts that succeeded are in the list of ranges that the
writer returns, so a lost executor leaves no half archive in a later read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeops.llm.shared import Scratch, importable, table

CHUNK = 1 << 20
#: Bytes of an archive file, and of a range that one reading task takes, about.
FILE, RANGE = 1 << 30, 8 << 20
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RANGES = "file string, start bigint, end bigint, records bigint"
CHUNKS = "row_id string, record_type string, refers_to string, uri string, chunk_no bigint, data binary, last boolean, payload_bytes bigint, payload_digest string"


def record_id(file: str, at: int) -> str:
    """An id that no other record has, since no other begins there; rows may share theirs."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}:{at}')}>"


def told(text: str | None) -> str | None:
    """A text as the value of a header: whatever would break its line is quoted."""
    return None if text is None else quote(text, safe="!#$&'()*+,/:;=?@[]~^|{}`\"<>\\")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunked(records: DataFrame, payload: str, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk, ``chunk_no`` and ``data`` in the place of the payload; an empty payload has one empty chunk.

    Chunks of a record stay in one partition and in order.
    """
    last = F.greatest(F.ceil(F.octet_length(payload) / F.lit(chunk)) - 1, F.lit(0)).cast("int")
    rows = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    data = F.substring(F.col(payload), F.col("chunk_no") * chunk + 1, F.lit(chunk))
    return rows.select(*(c for c in records.columns if c != payload), F.col("chunk_no").cast("bigint").alias("chunk_no"), data.alias("data"))


def address(uri: str | None) -> str | None:
    return None if uri is None else quote(uri, safe="!#$%&'()*+,/:;=?@[]~^|{}`\"<>\\")


def header(record: str, row_id: str | None, uri: str | None, size: int, digest: bytes, refers_to: str | None, refers_uri: str | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {size}\r\n\r\n"
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record,
        "WARC-Date": date,
        "WARC-Target-URI": address(uri),
        "WARC-Payload-Digest": f"sha1:{base32(digest)}",
        "WARC-Profile": IDENTICAL if revisit else None,
        "WARC-Refers-To-Target-URI": address(refers_uri) if revisit else None,
        "WARC-Refers-To-Date": date if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + (0 if revisit else size),
        "X-Row-ID": told(row_id),
        "X-Refers-To-Row-ID": told(refers_to) if revisit else None,
    }
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None), "\r\n", http]).encode()


class Archive:
    """Writes records to files of about FILE bytes and keeps the ranges between records."""

    def __init__(self, folder: str, level: int):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root)
        ctx = TaskContext.get()
        self.name, self.n, self.level, self.out = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}", 0, level, None
        self.ranges: list[tuple[str, int, int, int]] = []
        self.start = self.at = self.records = 0

    def begin(self) -> None:
        if self.out is None:
            self.file = f"{self.name}-{self.n:04d}.warc.gz"
            self.out, self.at, self.start, self.records = self.fs.open_output_stream(f"{self.root}/{self.file}", compression=None), 0, 0, 0
            self.n += 1
        self.gzip = zlib.compressobj(self.level, zlib.DEFLATED, 31)

    def put(self, data: bytes) -> None:
        self._write(self.gzip.compress(data))

    def end(self) -> None:
        self._write(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
        self.records += 1
        if self.at - self.start >= RANGE:
            self._mark()
        if self.at >= FILE:
            self.close()

    def _write(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.at += len(data)

    def _mark(self) -> None:
        if self.records:
            self.ranges.append((self.file, self.start, self.at, self.records))
            self.start, self.records = self.at, 0

    def close(self) -> None:
        if self.out is not None:
            self._mark()
            self.out.close()
            self.out = None


def _write(folder: str, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive: Archive | None = None
        sha, want, revisit, open_ = hashlib.sha1(), b"", False, False

        def finish() -> None:
            if not revisit and sha.digest() != want:
                raise ValueError("the chunks of a record don't make up its payload")
            archive.end()

        for batch in batches:
            ids, uris, sizes, digests, refers, refers_uris, revisits, numbers = (batch.column(k).to_pylist() for k in range(8))
            data = batch.column(8)
            for k, no in enumerate(numbers):
                archive = archive or Archive(folder, level)
                if no == 0:
                    if open_:
                        finish()
                    sha, want, revisit, open_ = hashlib.sha1(), digests[k], bool(revisits[k]), True
                    archive.begin()
                    archive.put(header(record_id(archive.file, archive.at), ids[k], uris[k], sizes[k], want, refers[k], refers_uris[k], revisit, date))
                if not revisit:
                    chunk = data[k].as_py()
                    sha.update(chunk)
                    archive.put(chunk)
        if archive:
            if open_:
                finish()
            archive.close()
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*archive.ranges, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["file", "start", "end", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, scratch: Scratch, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0, chunk: int = CHUNK, level: int = 1, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row and returns the ranges (file, start, end, records) that hold them.

    The payload is the text in UTF-8 or the bytes, null counting as empty. Of
    records with equal payloads of ``least`` bytes or more, that with the
    smallest id is a response and the others revisit it; a row that shares
    its id is a response too. Rows without id revisit a row with one, or are
    responses. Repeated rows have a record each, also where they share an id.
    Ids of any type are texts in the archive; records have ids of their own,
    which no two share. A payload of any length is written chunk by chunk, that
    of a revisit not at all. Without rows there is no archive; other columns are not looked at.
    """
    importable(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload"))
    rows = rows.select("id", "uri", "payload", F.octet_length("payload").alias("size"), F.unhex(F.sha1("payload")).alias("digest"))
    groups = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("keep"), F.min_by("uri", "id").alias("keep_uri"), F.count(F.lit(1)).alias("n"))
    # Written, so that its size is known where the join is planned: small, it spares the payloads their shuffle.
    groups = scratch.write(groups.filter("n > 1 and keep is not null").select("digest", "keep", "keep_uri"), "copies")
    rows = rows.join(groups, "digest", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("id"))
    rows = rows.select(F.col("id").cast("string").alias("row_id"), "uri", F.col("size").cast("bigint").alias("size"), "digest", F.col("keep").cast("string").alias("refers_to"), F.col("keep_uri").alias("refers_uri"), revisit.alias("revisit"), F.when(~revisit, F.col("payload")).otherwise(F.lit(b"")).alias("payload"))
    return scratch.write(chunked(rows, "payload", chunk).mapInArrow(_write(folder, level, date), RANGES), "ranges")


class Reader:
    """Payload chunks of the records in a range of an archive, a chunk in memory at a time."""

    def __init__(self, stream, size: int, chunk: int):
        self.stream, self.left, self.chunk = stream, size, chunk
        self.raw, self.text, self.gzip = b"", b"", None

    def more(self) -> bool:
        """Adds some text; false at the end of the range."""
        if not self.raw:
            self.raw = self.stream.read(min(self.left, 1 << 18))
            self.left -= len(self.raw)
            if not self.raw:
                return False
        if self.gzip is None:
            self.gzip = zlib.decompressobj(31)
        self.text += self.gzip.decompress(self.raw, 1 << 18)
        self.raw = self.gzip.unconsumed_tail
        if self.gzip.eof:
            self.raw, self.gzip = self.gzip.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes:
        at, seen = -1, 0
        while (at := self.text.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.text)
            if not self.more():
                raise ValueError("an archive ends within a record")
        out, self.text = self.text[:at], self.text[at + len(mark) :]
        return out

    def records(self) -> Iterator[tuple[dict[str, str], dict[str, str], Iterator[bytes]]]:
        while self.text or self.more():
            if not self.text:
                continue
            fields = parse(self.until(b"\r\n\r\n"), "WARC/")
            http_raw = self.until(b"\r\n\r\n")
            left = int(fields["content-length"]) - len(http_raw) - 4
            body = self.body(left)
            yield fields, parse(http_raw, "HTTP/"), body
            for _ in body:
                pass
            if self.until(b"\r\n\r\n"):
                raise ValueError("a record is longer than it says")

    def body(self, left: int) -> Iterator[bytes]:
        first = True
        while left or first:
            want = min(left, self.chunk)
            while len(self.text) < want:
                if not self.more():
                    raise ValueError("an archive ends within a record")
            out, self.text = self.text[:want], self.text[want:]
            left -= want
            first = False
            yield out


def parse(head: bytes, begins: str) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith(begins):
        raise ValueError(f"no {begins} line where a record should begin: {lines[0][:80]!r}")
    return {m[1].lower(): m[2] for line in lines[1:] if (m := re.match(r"([^:]+):\s*(.*)$", line, re.S))}


def known(told: str | None) -> str | None:
    return None if told is None else unquote(told)


def _read(folder: str, chunk: int, data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        schema = pa.schema([("row_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for file, start, end in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, size = [], 0
                with fs.open_input_file(f"{root}/{file}") as stream:
                    stream.seek(start)
                    for fields, http, body in Reader(stream, end - start, chunk).records():
                        revisit = fields["warc-type"] == "revisit"
                        total, sha, want = int(http["content-length"]), hashlib.sha1(), fields["warc-payload-digest"].removeprefix("sha1:")
                        done = 0
                        for no, part in enumerate(body):
                            sha.update(part)
                            done += len(part)
                            last = revisit or done >= total
                            digest = want if revisit else base32(sha.digest())
                            if last and digest != want:
                                raise ValueError(f"a payload doesn't have its digest {want}")
                            rows.append((known(fields.get("x-row-id")), fields["warc-type"], known(fields.get("x-refers-to-row-id")), fields.get("warc-target-uri"), no, part if data else None, last, total if revisit else done, digest))
                            size += len(part) if data else 200
                            if size >= 4 * chunk:
                                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                                rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read_warc(ranges: DataFrame, folder: str, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of archives: CHUNKS, one row for each chunk of each record.

    ``payload_bytes`` and ``payload_digest`` run up to the chunk's end, so the
    row with ``last`` has those of the payload; a revisit has one row, with
    those of the payload it revisits. A digest that doesn't match raises. An
    empty payload has one empty chunk, a table without ranges gives no rows,
    and other columns of ``ranges`` than file, start and end are not looked at.
    Without ``data`` the bytes are read and digested but not returned.
    """
    importable(ranges.sparkSession)
    # A task for a few ranges, so that a lost executor costs little.
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, -(-ranges.count() // 4))
    dealt = ranges.repartition(tasks)
    return dealt.mapInArrow(_read(folder, chunk, data), CHUNKS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    pages = table(spark, sf_dir, "pages")
    ranges = write_warc(pages, folder, scratch)
    records = read_warc(ranges, folder, data=False).filter("last")
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("row_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(t) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM g
"""
