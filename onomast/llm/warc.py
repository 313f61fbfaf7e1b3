"""WARC as a PySpark data source, and a writer.

``spark.read.format("warc").load(folder)`` plans a partition for each file.
Larger files are read in parallel by an exact index: :func:`plan_splits` walks
each file once, without keeping payloads, and notes where records start, so a
compressed or plain WARC file that is itself a payload is never taken for
records of the outer one.  Predicates on
the record's type and on its other named headers are pushed into the reader:
it parses a record's headers first, and only where they pass does it keep,
split and decode the payload; other payloads are skipped over (by seeking in
plain files, by inflating without keeping anything in compressed ones).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from onomast.llm.files import open_read, open_write, sizes
from onomast.llm.shared import new_folder

SCHEMA = (
    "path string, offset bigint, record_id string, warc_type string, target_uri string, warc_date string, content_type string, content_length bigint, "
    "headers map<string,string>, http_status int, http_headers map<string,string>, payload binary"
)
_ARROW = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
        ("content_type", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()),
        ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ]
)
#: Column: the header that it holds.
_HEADER = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type", "content_length": "content-length"}
SPLIT_BYTES = 64 << 20
CHUNK = 1 << 18
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
DATE = "2024-01-01T00:00:00Z"


# Predicates


def supported(f: ds.Filter) -> bool:
    """Whether the reader can decide this predicate from a record's headers."""
    if isinstance(f, ds.Not):
        return supported(f.child)
    if len(f.attribute) != 1 or f.attribute[0] not in _HEADER:
        return False
    kinds = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)
    return isinstance(f, kinds)


def _utf8(x):
    return x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x


def holds(f: ds.Filter, row: dict) -> bool | None:
    """The predicate over the named headers of a record; None is SQL's unknown."""
    if isinstance(f, ds.Not):
        x = holds(f.child, row)
        return None if x is None else not x
    x = row[f.attribute[0]]
    if isinstance(f, ds.IsNull):
        return x is None
    if isinstance(f, ds.IsNotNull):
        return x is not None
    if isinstance(f, ds.EqualNullSafe):
        return x == f.value
    if x is None or f.value is None:
        return None
    if isinstance(f, ds.EqualTo):
        return x == f.value
    if isinstance(f, ds.In):
        return True if x in f.value else None if None in f.value else False
    if isinstance(f, ds.StringStartsWith):
        return x.startswith(f.value)
    if isinstance(f, ds.StringEndsWith):
        return x.endswith(f.value)
    if isinstance(f, ds.StringContains):
        return f.value in x
    a, b = _utf8(x), _utf8(f.value)  # Spark compares strings by their bytes
    if isinstance(f, ds.GreaterThan):
        return a > b
    if isinstance(f, ds.GreaterThanOrEqual):
        return a >= b
    if isinstance(f, ds.LessThan):
        return a < b
    return a <= b


# Reading


class _Bytes:
    """The bytes of a file from ``start`` on, inflated member by member; ``at`` is where the current member starts."""

    def __init__(self, f, start: int, packed: bool):
        f.seek(start)
        self.f, self.packed, self.at = f, packed, start
        self.raw, self.raw_end = b"", start  # read from the file but not inflated; where reading goes on
        self.buf, self.pos = b"", 0
        self.inflate = zlib.decompressobj(31) if packed else None

    def fill(self) -> bool:
        """Get more bytes of the current member, or the first ones of the next; False at the end of the file."""
        while True:
            if self.packed and self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
                self.at = self.raw_end - len(self.raw)
            if not self.raw:
                self.raw = self.f.read(CHUNK)
                self.raw_end += len(self.raw)
                if not self.raw:
                    return False
            more = self.inflate.decompress(self.raw, 4 * CHUNK) if self.packed else self.raw
            self.raw = self.inflate.unconsumed_tail if self.packed else b""
            if more:
                self.buf, self.pos = self.buf[self.pos :] + more, 0
                return True
            if self.packed and not self.inflate.eof and not self.raw and not self.inflate.unconsumed_tail:
                continue

    def offset(self) -> int:
        return self.at if self.packed else self.raw_end - (len(self.buf) - self.pos)

    def line(self) -> bytes | None:
        while (end := self.buf.find(b"\n", self.pos)) < 0:
            if not self.fill():
                return None
        out, self.pos = self.buf[self.pos : end + 1], end + 1
        return out

    def take(self, n: int, keep: bool) -> bytes | None:
        """The next n bytes; b"" if they aren't to be kept, None if there are fewer."""
        out = []
        while n > 0:
            here = min(n, len(self.buf) - self.pos)
            if keep and here:
                out.append(self.buf[self.pos : self.pos + here])
            self.pos += here
            n -= here
            if n and not keep and not self.packed:
                self.buf, self.pos, self.raw = b"", 0, b""
                self.f.seek(self.raw_end + n)
                self.raw_end, n = self.raw_end + n, 0
                return b"" if self.raw_end <= self.f.size() else None
            if n:
                self.buf, self.pos = b"", 0
                if not self.fill():
                    return None
        return b"".join(out)


def _is_member(f, at: int) -> bool:
    """Whether a compressed record starts here."""
    f.seek(at)
    try:
        return zlib.decompressobj(31).decompress(f.read(4096), 64).startswith(b"WARC/")
    except zlib.error:
        return False


def _first_member(f, start: int, end: int) -> int | None:
    """Where the first compressed record at or after ``start`` and before ``end`` starts."""
    at = start
    while at < end:
        f.seek(at)
        block = f.read(CHUNK + 2)
        i = block.find(b"\x1f\x8b\x08")
        while i >= 0 and at + i < end:
            if i < CHUNK and _is_member(f, at + i):
                return at + i
            i = block.find(b"\x1f\x8b\x08", i + 1)
        at += CHUNK
    return None


def _fields(lines: Iterable[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a repeated field's values are joined with a comma, a folded line goes on."""
    out: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if colon:
            last, value = name.strip().lower(), value.strip()
            out[last] = f"{out[last]}, {value}" if last in out else value
    return out


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return body if not out else b"".join(out)


def split_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, header fields and decoded body of an HTTP message; a body that can't be decoded stays as it is."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, found, body = block.partition(b"\n\n")
    lines = head.split(b"\n")
    first = lines[0].split()
    if not found or not first or not (first[0].startswith(b"HTTP/") or first[-1].startswith(b"HTTP/")):
        return None, {}, block
    fields = _fields(lines[1:])
    status = int(first[1]) if first[0].startswith(b"HTTP/") and len(first) > 1 and first[1].isdigit() and len(first[1]) < 5 else None
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    kind = fields.get("content-encoding", "").strip().lower()
    if kind in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompress(body, 47 if kind != "deflate" else 15)
        except zlib.error:
            pass
    return status, fields, body


@dataclass
class Split(ds.InputPartition):
    path: str
    start: int
    end: int
    packed: bool


def records(path: str, start: int, end: int, packed: bool, filters: list[ds.Filter], payload: bool = True) -> Iterator[dict]:
    """The records that start in [start, end) and pass ``filters``; a record starts at ``start``.

    A damaged stretch of a compressed file is skipped up to what looks like
    the next record; a record that the file's end cuts off is left out.
    """
    f = open_read(path)
    with f:
        at: int | None = start
        while at is not None and at < end:
            stream = _Bytes(f, at, packed)
            try:
                yield from _walk(stream, path, end, filters, payload)
                return
            except zlib.error:
                at = _first_member(f, stream.at + 1, end)


def _walk(stream: _Bytes, path: str, end: int, filters: list[ds.Filter], payload: bool) -> Iterator[dict]:
    while True:
        if stream.pos >= len(stream.buf) and not stream.fill():
            return
        offset = stream.offset()
        if offset >= end:
            return
        line = stream.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            continue
        lines = []
        while (line := stream.line()) is not None and line.strip():
            lines.append(line)
        if line is None:
            return
        fields = _fields(lines)
        row = {c: fields.get(h) for c, h in _HEADER.items()}
        n = row["content_length"]
        if n is None or not n.isdigit():
            continue
        row["content_length"] = n = int(n)
        wanted = all(holds(x, row) is True for x in filters)
        block = stream.take(n, wanted and payload)
        if block is None:
            return
        if wanted:
            status, http, body = None, {}, block
            if payload and (row["content_type"] or "").lower().startswith("application/http"):
                status, http, body = split_http(block)
            yield row | {"path": path, "offset": offset, "headers": list(fields.items()), "http_status": status, "http_headers": list(http.items()), "payload": body if payload else None}


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.filters = options["path"], []
        self.splits = json.loads(options["splits"]) if options.get("splits") else None
        self.payload = str(options.get("payload", "true")).lower() != "false"

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if supported(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Split]:
        found = self.splits if self.splits is not None else [(path, 0, size) for path, size in sizes(self.path, (".warc", ".warc.gz"))]
        out = [Split(path, a, b, path.endswith(".gz")) for path, a, b in found]
        return out or [Split("", 0, 0, False)]  # Spark reads one partition where none are planned

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        if partition.start >= partition.end:
            return
        for row in records(partition.path, partition.start, partition.end, partition.packed, self.filters, self.payload):
            held.append(row)
            size += len(row["payload"] or b"") + 500
            if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(held, _ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def plan_splits(spark: SparkSession, uri: str, split_bytes: int = SPLIT_BYTES) -> list[tuple[str, int, int]]:
    """(file, start, end) stretches of about ``split_bytes`` that start where a record does, for :func:`read_warc`: some for each file, however many records it has."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                starts = [0]
                for row in records(path, 0, size, path.endswith(".gz"), [], False):
                    if row["offset"] - starts[-1] >= split_bytes:
                        starts.append(row["offset"])
                yield pa.record_batch({"path": pa.array([path] * len(starts)), "start": pa.array(starts, pa.int64()), "end": pa.array([*starts[1:], size], pa.int64())})

    found = sizes(uri, (".warc", ".warc.gz"))
    if not found:
        return []
    files = spark.createDataFrame(found, "path string, size bigint").repartition(len(found))
    return sorted(tuple(r) for r in files.mapInArrow(walk, "path string, start bigint, end bigint").collect())


def read_warc(spark: SparkSession, uri: str, payload: bool = True, splits: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """The records of a file or folder of .warc and .warc.gz files.

    Columns: path, offset (of the record, or of the compressed member that
    holds it), record_id, warc_type, target_uri, warc_date, content_type,
    content_length, headers, http_status, http_headers, payload (an HTTP
    message's decoded body, else the block; null with ``payload=False``).  A
    header that a record lacks is null.  Repeated records are all returned; a
    folder without such files gives an empty table.  A file is read by one
    task unless ``splits`` has been planned; a record is held whole by the
    task that reads it.  Turns the session's filter pushdown for Python
    sources on, without which predicates are applied after reading.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc").option("payload", str(payload).lower())
    return (reader if splits is None else reader.option("splits", json.dumps(splits))).load(uri)


# Writing


def _line(text: str) -> str:
    """A header value on one line: line ends and NUL are percent-encoded."""
    return text.replace("\r", "%0D").replace("\n", "%0A").replace("\0", "%00")


def _record(kind: str, ident: str, uri: str | None, content_type: str, block: bytes, date: str) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date}", *([f"WARC-Target-URI: {_line(uri)}"] if uri is not None else []), f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url: str = "url", html: str = "html", packed: bool = True, date: str = DATE) -> list[tuple[str, int]]:
    """Write a request and a response record for each row, one file for each partition; gives (file, records).

    The response's record id ends in the row's id ("null" if that is null).  A
    null URL has no target header, a null page an empty body.  Other columns
    are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{uri}/part-{TaskContext.get().partitionId():06d}.warc{'.gz' if packed else ''}"
        n = 0

        def put(f, data: bytes) -> None:
            c = zlib.compressobj(1, zlib.DEFLATED, 31)
            f.write(c.compress(data) + c.flush() if packed else data)

        with open_write(name) as f:
            put(f, _record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", None, "application/warc-fields", b"software: onomast\r\nformat: WARC File Format 1.1\r\n", date))
            for batch in batches:
                for ident, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                    ident = "null" if ident is None else ident
                    host, _, rest = (at or "").partition("://")[2].partition("/")
                    put(f, _record("request", f"urn:request:{ident}", at, "application/http; msgtype=request", f"GET /{_line(rest)} HTTP/1.1\r\nHost: {_line(host)}\r\n\r\n".encode(), date))
                    body = (text or "").encode()
                    put(f, _record("response", f"urn:page:{ident}", at, "application/http; msgtype=response", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body, date))
                    n += 1
        yield pa.record_batch({"path": pa.array([name]), "records": pa.array([2 * n + 1], pa.int64())})

    rows = pages.select(F.col(id_col).cast("string"), F.col(url).cast("string"), F.col(html).cast("string"))
    return [tuple(r) for r in rows.mapInArrow(write, "path string, records bigint").collect()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC and read back by type and status: page_id, url, http_status, n_bytes, html."""
    folder = new_folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = read_warc(spark, folder).where("warc_type = 'response' AND content_type LIKE 'application/http%'")
    return found.select(F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) AS BIGINT)").alias("page_id"), F.col("target_uri").alias("url"), "http_status", F.octet_length("payload").cast("bigint").alias("n_bytes"), F.decode("payload", "UTF-8").alias("html"))


SQL = """
SELECT page_id, url, CAST(200 AS INTEGER) AS http_status, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, coalesce(html, '') AS html
FROM pages
"""
