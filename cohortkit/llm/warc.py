"""WARC archives: one gzip member for each record, written by tasks and read back in splittable byte ranges.

Writing: every task writes its pages to files of its own in the shared
folder and returns their names and sizes; only the names that Spark has
committed are ever read, so a lost or repeated task leaves no trace in the
result.  Pages with equal payloads are stored once: the others are revisit
records without payload.

Reading: files are cut into byte ranges that are read on their own.  A task
looks for the bytes that start a gzip member, and takes a place for a member
only if it inflates to its end with the right checksum and begins with WARC
headers whose length fits.  A task owns the members that start in its range
and reads past the range's end to finish the last.  What looks like a member
inside another one (an archive stored in a payload) is told apart afterwards:
it starts before the end of a member that started earlier.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import new_table_path, prepare, staged

#: A task begins a new file beyond this size.
FILE_BYTES = 64 << 20
#: Size of the ranges that are read on their own.
RANGE_BYTES = 4 << 20
#: Records whose payload is smaller are never stored as revisits.
MIN_REVISIT_BYTES = 0
#: Tasks that read ranges, at most; a task then reads several ranges.
MAX_READ_TASKS = 100_000

MAGIC = b"\x1f\x8b\x08"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 16 << 10

_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("warc_type", pa.string()),
                     ("headers", pa.map_(pa.string(), pa.string())), ("http_headers", pa.map_(pa.string(), pa.string())),
                     ("payload", pa.binary())])
_RECORD_DDL = ("path string, offset long, end long, warc_type string, headers map<string,string>, "
               "http_headers map<string,string>, payload binary")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column as 32 upper-case base32 characters."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _header_value(value: str) -> str:
    """Line breaks and other control characters cannot stand in a header: percent-encode them (and percent signs)."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(page_id, url, payload: bytes, digest: str, first_id, revisit: bool) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:x-page:{digest}:{name}{':revisit' if revisit else ''}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:x-page:{digest}:{first_id}>", f"Refers-To-Page-Id: {first_id}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _writer(folder: str, file_bytes: int):
    def write(batches):
        target, base = _filesystem(folder)
        target.create_dir(base, recursive=True)
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, names, sizes, counts = None, [], [], []
        try:
            for batch in batches:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for i in range(batch.num_rows):
                    record = _record(*(c[i].as_py() for c in columns))
                    if out is not None and sizes[-1] >= file_bytes:
                        out.close()
                        out = None
                    if out is None:
                        name = f"part-{task}-{len(names)}.warc.gz"
                        out = target.open_output_stream(f"{base}/{name}", compression=None)
                        names.append(f"{folder}/{name}")
                        sizes.append(0)
                        counts.append(0)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record) + packer.flush()
                    out.write(member)
                    sizes[-1] += len(member)
                    counts[-1] += 1
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                                         names=["path", "bytes", "records"])
    return write


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_revisit_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record for each page to ``folder`` and return the files (path, bytes, records).

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes the
    one with the smallest id is a response and the others revisit it; rows
    that share that smallest id are all responses.  Pages without id come
    last: they revisit a page that has one, and are responses where none has.
    A null payload is empty; a null url or id is left out of the headers.
    Other columns are ignored.  An empty table gives no files.
    """
    prepare(pages.sparkSession)
    slim = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
                        F.coalesce(pages[payload_col].cast("binary"), F.lit(b"")).alias("payload"))
    named = slim.withColumn("digest", base32_sha1(F.col("payload")))
    # only payloads that occur more than once and can be revisited have a row here
    first = (named.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest")
             .agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).where("n > 1 and first_id is not null").drop("n"))
    ready = named.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", "first_id",
        F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False)).alias("revisit"))
    return staged(ready.mapInArrow(_writer(folder, file_bytes), "path string, bytes long, records long"), "warc-files")


class _Bytes:
    """A file's bytes, one range of them in memory."""

    def __init__(self, source, lo: int, hi: int, size: int) -> None:
        self.source, self.lo, self.size = source, lo, size
        self.held = source.read_at(min(hi + len(MAGIC) - 1, size) - lo, lo)
        self.view = memoryview(self.held)

    def chunk(self, at: int):
        """Some bytes from ``at`` on; none at the file's end."""
        if at - self.lo < len(self.held):
            return self.view[at - self.lo:at - self.lo + _CHUNK]
        return self.source.read_at(max(0, min(_CHUNK, self.size - at)), at)

    def magic(self, at: int) -> int:
        """The first place at or after ``at`` where a member may start in the range; -1 if there is none."""
        found = self.held.find(MAGIC, at - self.lo)
        return -1 if found < 0 else found + self.lo


def _parse_headers(lines: list[str]) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines if line)]


def _head(start: bytes) -> tuple[int, list[tuple[str, str]], int] | None:
    """Length of the WARC headers, the headers, and the block's length; None if they are not WARC headers."""
    stop = start.find(b"\r\n\r\n")
    if stop < 0 or not start.startswith(b"WARC/"):
        return None
    headers = _parse_headers(start[:stop].decode("utf-8", "replace").split("\r\n")[1:])
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    return (stop + 4, headers, int(length)) if length.isascii() and length.isdigit() else None


def _inflate(data: _Bytes, at: int, keep: bool):
    """(end, record bytes if kept) of the member at ``at``; None if there is no whole WARC member."""
    unzip = zlib.decompressobj(31)
    place, kept, seen, head = at, [], 0, None
    try:
        while not unzip.eof:
            chunk = data.chunk(place)
            if not len(chunk):
                return None
            place += len(chunk)
            text = unzip.decompress(chunk)
            seen += len(text)
            if keep or head is None:
                kept.append(text)
            if head is None and seen >= 5:
                start = b"".join(kept)
                if not start.startswith(b"WARC/") or (seen > 1 << 20 and b"\r\n\r\n" not in start):
                    return None
                head = _head(start)
                kept = [start] if keep or head is None else []
    except zlib.error:
        return None
    if head is None or seen != head[0] + head[2] + 4:
        return None
    return place - len(unzip.unused_data), b"".join(kept)


def _ranges(batch):
    for row in batch.to_pylist():
        source, path = _filesystem(row["path"])
        with source.open_input_file(path) as opened:
            yield row, _Bytes(opened, row["lo"], row["hi"], row["bytes"])


def _find_members(batches):
    for batch in batches:
        found = []
        for row, data in _ranges(batch):
            at = data.magic(row["lo"])
            while at >= 0:
                inflated = _inflate(data, at, keep=False)
                if inflated:
                    found.append((row["path"], row["lo"], row["hi"], row["bytes"], at, inflated[0]))
                at = data.magic(inflated[0] if inflated else at + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), *(pa.array([f[i] for f in found], pa.int64()) for i in range(1, 6))],
            names=["path", "lo", "hi", "bytes", "offset", "end"])


def _decode(path: str, at: int, end: int, record: bytes) -> dict:
    start, headers, _ = _head(record)
    named = {k.lower(): v for k, v in headers}
    block, http = record[start:-4], []
    if named.get("content-type", "").startswith("application/http"):
        stop = block.find(b"\r\n\r\n")
        http = _parse_headers(block[:stop].decode("utf-8", "replace").split("\r\n")[1:]) if stop >= 0 else []
        block = block[stop + 4:] if stop >= 0 else block
    kind = named.get("warc-type", "")
    return {"path": path, "offset": at, "end": end, "warc_type": kind, "headers": list(dict(headers).items()),
            "http_headers": list(dict(http).items()), "payload": None if kind == "revisit" else block}


def _read_members(batches):
    for batch in batches:
        for row, data in _ranges(batch):
            rows, size = [], 0
            for at in row["offsets"]:
                end, record = _inflate(data, at, keep=True)
                rows.append(_decode(row["path"], at, end, record))
                size += len(record)
                if size > 4 << 20 or len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RECORD)


def member_index(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members of ``files`` (path, bytes): one row for each byte range (path, lo, hi, bytes) with their offsets.

    A window over one file drops members inside members; files hold
    ``FILE_BYTES`` and a record at most where this module wrote them.
    """
    total = files.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, min(-(-total // range_bytes), MAX_READ_TASKS))
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = (files.where("bytes > 0").select("path", "bytes", begins.alias("lo"))
              .select("path", "lo", F.least(F.col("lo") + range_bytes, "bytes").alias("hi"), "bytes").repartition(tasks, "path", "lo"))
    found = staged(ranges.mapInArrow(_find_members, "path string, lo long, hi long, bytes long, offset long, end long"), "warc-members")
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    outer = found.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0))).where("offset >= reached")
    owned = outer.groupBy("path", "lo", "hi", "bytes").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    return owned.repartition(tasks, "path", "lo")


def read_warc(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of ``files`` (path, bytes): place, type, headers and payload (null for a revisit).

    Bytes between members that are no WARC member are skipped.  Headers that
    repeat have their last value.  No files, or files without records, give
    no rows.
    """
    prepare(spark)
    return member_index(files, range_bytes).mapInArrow(_read_members, _RECORD_DDL)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages' records to the shared folder and read them back."""
    spark = pages.sparkSession
    return read_warc(spark, write_warc(pages, new_table_path(spark, "warc"), **options))
