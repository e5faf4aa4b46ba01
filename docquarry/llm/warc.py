"""WARC files: a writer, and a reader that splits gzip files by byte ranges and reads plain ones.

Every record is a gzip member of its own.  A reading task scans its byte range for the gzip magic, takes a
candidate for a member only if its header is sound, its data begin with a WARC header and it decodes to the end
with a right checksum; the magic turns up inside compressed data now and then.  From there members follow one
another.  A task owns the records that start inside its range and reads on beyond the range to finish the last, so every
record is read once, wherever the ranges are cut.  A file that is not compressed can't be split, since a payload may hold what
looks like a record: the task of its first range follows its records from length to length, and where a length leads to no
record, on to the next version line behind an empty line.  Files are opened through pyarrow's file systems, which read ranges of local
and distributed stores alike.

Defined cases: an empty file or one without a record gives no rows; a damaged member is left out and the
scan resumes behind its start; a sound member counts whatever follows it; a member that holds several records gives all
of them; records other than responses are left out by ``pages_of``; null urls and null html come back null, empty ones
empty; bytes of a payload that are no UTF-8 come back as replacement characters; repeated pages are repeated records;
extra columns of pages are not written.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import shared_dir, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
RANGE_BYTES = 8 << 20
#: Bytes of the headers of an uncompressed record at most; a version line before more is none.
MOST_HEADER = 1 << 20
_READ = 1 << 18
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", re.IGNORECASE)
_DATE = "2024-01-01T00:00:00Z"


def record(kind: str, block: bytes, headers: dict[str, str]) -> bytes:
    """One WARC record, uncompressed."""
    lines = [f"WARC-Type: {kind}", f"WARC-Date: {_DATE}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 5) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    headers = {"WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "Content-Type": "application/http; msgtype=response"}
    if url is not None:
        plain = url.isascii() and url.isprintable() and url == url.strip()
        headers["WARC-Target-URI"] = url if plain else quote(url, safe="")
        if not plain:
            headers["X-Quoted-URI"] = "yes"
    body = (html or "").encode("utf-8", "surrogatepass")
    if html is None:
        headers["X-No-Payload"] = "yes"
    return record("response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body, headers)


def write_warc(pages: DataFrame, directory: str) -> DataFrame:
    """Write pages as WARC files below ``directory``; returns ``(path, size, records)`` of the files that count.

    Each attempt of a task writes a file of its own; the table lists those of the attempts that succeeded.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(directory)
        system.create_dir(path, recursive=True)
        name, out, n, size = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if out is None:
                    out = system.open_output_stream(name, compression=None)
                    size += out.write(member(record("warcinfo", b"software: docquarry\r\nformat: WARC File Format 1.0\r\n", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"})))
                size += out.write(member(page_record(page_id, url, html)))
                n += 1
        if out is not None:
            out.close()
            uri = f"{directory}/{name.rpartition('/')[2]}"
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "size", "records"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return written(chosen.mapInArrow(apply, "path string, size long, records long"), "warc-files")


class Source:
    """Random access to a file, a window at a time."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.at, self.data = 0, b""

    def read(self, start: int, n: int) -> bytes:
        """``n`` bytes from ``start``, or as many as there are."""
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.data)):
            self.at, self.data = start, self.file.read_at(max(n, min(_READ * 4, self.size - start)), start)
        return self.data[start - self.at : start - self.at + n]


def member_at(source: Source, start: int) -> tuple[bytes, int] | None:
    """Data and end of the gzip member at ``start`` if there is a whole one that begins with a WARC header."""
    head = source.read(start, 10)
    if len(head) < 10 or head[:3] != MAGIC or head[3] & 0xE0:
        return None
    unpacker, out, at = zlib.decompressobj(31), [], start
    seen = b""
    try:
        while not unpacker.eof:
            piece = source.read(at, _READ)
            if not piece:
                return None
            got = unpacker.decompress(piece)
            at += len(piece)
            out.append(got)
            if len(seen) < 5:
                seen += got[:5]
                if not b"WARC/".startswith(seen[:5]) and seen[:5] != b"WARC/":
                    return None
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, at - len(unpacker.unused_data)) if data.startswith(b"WARC/") else None


def members(source: Source, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the members that start in ``[start, stop)``."""
    at = start
    while at < min(stop, source.size):
        got = member_at(source, at)
        if got is not None:
            yield at, got[0]
            at = got[1]
            continue
        at = at + 1 if source.read(at, 3) == MAGIC else at
        while at < min(stop, source.size):  # the next magic; a window overlaps the last by two bytes
            block = source.read(at, _READ)
            found = block.find(MAGIC)
            if found >= 0:
                at += found
                break
            at += max(1, len(block) - 2)


def plain_at(source: Source, start: int) -> tuple[bytes, int] | None:
    """Data and end of the uncompressed record at ``start`` if a whole one begins there behind an empty line or the file's start."""
    if source.read(start, len(VERSION)) != VERSION or start and source.read(start - 4, 4) != b"\r\n\r\n":
        return None
    n, end = _READ, -1
    while end < 0:
        head = source.read(start, n)
        end = head.find(b"\r\n\r\n")
        if end < 0 and (len(head) < n or n >= MOST_HEADER):
            return None
        n *= 2
    length = _LENGTH.search(head[: end + 2])
    if length is None:
        return None
    last = start + end + 4 + int(length[1])
    while source.read(last, 2) == b"\r\n":
        last += 2
    if last < source.size and source.read(last, len(VERSION)) != VERSION or last > source.size:
        return None
    return source.read(start, last - start), last


def plain_records(source: Source) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the records of an uncompressed file."""
    at = 0
    while at < source.size:
        got = plain_at(source, at)
        if got is not None:
            yield at, got[0]
            at = got[1]
            continue
        at += 1
        while at < source.size:
            block = source.read(at, _READ)
            found = block.find(VERSION)
            if found >= 0:
                at += found
                break
            at += max(1, len(block) - len(VERSION) + 1)


def found_in(source: Source, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of what a range of either kind of file owns."""
    if source.read(0, len(VERSION)) != VERSION:
        return members(source, start, stop)
    return plain_records(source) if start == 0 else iter(())


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with lower-case names, and blocks of the records of a member."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        try:
            n = int(headers["content-length"])
        except (KeyError, ValueError):
            return
        if n < 0 or end + 4 + n > len(data):
            return
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        while data.startswith(b"\r\n", at):
            at += 2


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, offset, kind, record_id, url, payload)`` of every record of ``files`` (path, size)."""
    ranges = files.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = max(1, files.select(F.coalesce(F.sum(F.ceil(F.col("size") / range_bytes)), F.lit(0))).first()[0])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                source, rows, held = Source(path), [], 0
                for offset, data in found_in(source, start, start + range_bytes):
                    for headers, block in records_in(data):
                        kind, url, payload = headers.get("warc-type"), headers.get("warc-target-uri"), block
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2] if "x-no-payload" not in headers else None
                        if url is not None and "x-quoted-uri" in headers:
                            url = unquote(url)
                        rows.append((path, offset, kind, headers.get("warc-record-id"), url, None if payload is None else payload.decode("utf-8", "replace")))
                        held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.repartition(int(n)).mapInArrow(apply, "path string, offset long, kind string, record_id string, url string, payload string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "offset", "kind", "record_id", "url", "payload"])


def pages_of(records: DataFrame) -> DataFrame:
    """The pages that ``write_warc`` wrote."""
    page_id = F.regexp_extract("record_id", "^<urn:page:(-?[0-9]+)>$", 1)
    return records.where("kind = 'response'").select(F.when(page_id != "", page_id.cast("long")).alias("page_id"), "url", F.col("payload").alias("html"))


def round_trip(spark: SparkSession, pages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pages written as WARC files to the shared folder and read from them by ranges."""
    return pages_of(read_warc(write_warc(pages, shared_dir(spark, "warc")), range_bytes))


ORACLE_SQL = "select page_id, url, html from pages"
