"""WARC archives as a Python data source, for writing and for reading.

Writing gives each task's records to files of bounded size, a gzip member for each record, whose extra field holds the
member's length (the skip length of the format's compression notes) and whose header part ends on a byte boundary.
Files are written under temporary names and moved when the job commits, so a lost task leaves nothing that is read.
Reading plans one partition for each run of files, takes filters on type, target, identifiers and headers, parses a
record's header lines first, and steps over the payload, undecoded, of what is filtered out or not asked for.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringStartsWith, WriterCommitMessage

SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 128 << 20, 64 << 20, 4 << 20
_FIXED = struct.Struct("<4BI2B")
_EXTRA = struct.Struct("<H2sHII")
_COLUMNS = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to", "payload_length")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def _plain(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row) -> tuple[bytes, bytes]:
    """Header lines and payload of a record; the block of a revisit has the response's own headers and no payload."""
    payload = bytes(row["payload"] or b"")
    length = len(payload) if row["payload_length"] is None else row["payload_length"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if row["record_type"] == "revisit":
        payload = b""
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_plain(row['record_id'])}>"]
    for name, value in (("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", row["payload_digest"] and f"sha1:{row['payload_digest']}"), ("WARC-Refers-To", row["refers_to"] and f"<{row['refers_to']}>")):
        if value is not None:
            lines.append(f"{name}: {_plain(value)}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [f"{_plain(k)}: {_plain(v or '')}" for k, v in sorted((row["headers"] or {}).items()) if not re.match("(?i)WARC-|content-", k)]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http, payload


def member(head: bytes, payload: bytes) -> bytes:
    """One gzip member: headers, flushed to a byte boundary, then the payload; its length stands in the extra field."""
    pack = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = pack.compress(head) + pack.flush(zlib.Z_FULL_FLUSH) + pack.compress(payload + b"\r\n\r\n") + pack.flush()
    size = len(head) + len(payload) + 4
    total = _FIXED.size + _EXTRA.size + len(body) + 8
    checksum = zlib.crc32(b"\r\n\r\n", zlib.crc32(payload, zlib.crc32(head)))
    return _FIXED.pack(0x1F, 0x8B, 8, 4, 0, 4, 255) + _EXTRA.pack(12, b"sl", 8, total, size & 0xFFFFFFFF) + body + struct.pack("<II", checksum, size & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = uuid.uuid4().hex[:8]

    def write(self, rows: Iterator) -> _Written:
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for row in rows:
            if out is None:
                files.append(f"_{self.job}-{uuid.uuid4().hex}.warc.gz")
                out, size = store.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
            data = member(*record(row))
            out.write(data)
            size += len(data)
            if size >= FILE_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path)):
                if old.base_name.endswith(".warc.gz") and not old.base_name.startswith("_"):
                    store.delete_file(old.path)
        for name in (f for m in messages if m is not None for f in m.files):
            store.move(f"{path}/{name}", f"{path}/{name[1:]}")

    def abort(self, messages: list) -> None:
        store, path = _open(self.path)
        for name in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{path}/{name}")


@dataclass
class _Files(InputPartition):
    files: list[str]


class _Stream:
    """Reads forward through gzip members or plain records."""

    def __init__(self, file):
        self.file, self.held, self.at = file, b"", 0

    def take(self, n: int) -> bytes:
        if len(self.held) - self.at < n:
            self.held, self.at = self.held[self.at :] + self.file.read(max(n, 1 << 20)), 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        there = min(n, len(self.held) - self.at)
        self.at += there
        if n > there:
            self.file.seek(n - there, 1)

    def back(self, data: bytes) -> None:
        self.held, self.at = data + self.held[self.at :], 0


def _records(file, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(header fields, payload or None) of the records that are wanted, judged by their header lines alone."""
    stream = _Stream(file)
    while start := stream.take(_FIXED.size):
        if start[:2] != b"\x1f\x8b":
            stream.back(start)
            yield from _plain_records(stream, wanted, payload)
            return
        extra = stream.take(_EXTRA.size) if start[3] == 4 else b""
        known = len(extra) == _EXTRA.size and extra[2:4] == b"sl"
        inflate = zlib.decompressobj(-15)
        if known:
            rest = _EXTRA.unpack(extra)[3] - _FIXED.size - _EXTRA.size
            text, used = b"", 0
            while not _headed(text) and used < rest and not inflate.eof:
                part = stream.take(min(4096, rest - used))
                used += len(part)
                text += inflate.decompress(part)
            fields, body = _fields(text)
            if wanted(fields):
                data = None
                if payload:
                    data = _payload(fields, body + inflate.decompress(stream.take(rest - used)))
                    used = rest
                yield fields, data
            stream.skip(rest - used)
        else:  # a member of another writer: its end shows only when it is inflated
            stream.back(start + extra)
            inflate, text = zlib.decompressobj(31), b""
            while not _headed(text) and not inflate.eof and (part := stream.take(1 << 14)):
                text += inflate.decompress(part)
            fields, body = _fields(text)
            take = wanted(fields)
            parts = [body]
            while not inflate.eof and (part := stream.take(1 << 16)):  # what isn't asked for is let go piece by piece
                piece = inflate.decompress(part)
                if take and payload:
                    parts.append(piece)
            stream.back(inflate.unused_data)
            if take:
                yield fields, _payload(fields, b"".join(parts)) if payload else None


def _headed(text: bytes) -> bool:
    """Whether the header lines are there, and those of HTTP where the block begins with them."""
    _, mark, body = text.partition(b"\r\n\r\n")
    return bool(mark) and len(body) >= 5 and (not body.startswith(b"HTTP/") or b"\r\n\r\n" in body)


def _plain_records(stream: _Stream, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    while True:
        text = b""
        while b"\r\n\r\n" not in text.lstrip() and (part := stream.take(4096)):
            text += part
        if not text.strip():
            return
        text = text.lstrip()
        head, _, after = text.partition(b"\r\n\r\n")
        stream.back(after)
        fields, _ = _fields(head + b"\r\n\r\n")
        length = int(fields["headers"].get("content-length", 0))
        if wanted(fields) and payload:
            yield fields, _payload(fields, stream.take(length))
        else:
            if wanted(fields):
                yield fields, None
            stream.skip(length)


def _fields(text: bytes) -> tuple[dict, bytes]:
    """Header fields of a record (names in lower case), and what of its block came along."""
    head, _, body = text.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    digest = headers.get("warc-payload-digest")
    inner = re.search(rb"(?i)\r\ncontent-length: *(\d+)", body.partition(b"\r\n\r\n")[0])
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    return {"record_type": headers.get("warc-type"), "record_id": bare("warc-record-id"), "target_uri": headers.get("warc-target-uri"), "payload_digest": digest.partition(":")[2] if digest else None, "refers_to": bare("warc-refers-to"), "payload_length": int(inner[1]) if inner else None, "headers": headers}, body


def _payload(fields: dict, body: bytes) -> bytes:
    """The block without the HTTP headers."""
    block = body[: int(fields["headers"].get("content-length", len(body)))]
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters: list[Filter]):
        """Takes what header lines can decide; hands the rest back."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            name = inner.attribute if isinstance(inner, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)) else ()
            if name[:1] and name[0] in _COLUMNS and len(name) == 1 or name[:1] == ("headers",) and len(name) == 2:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, fields: dict) -> bool:
        return all(_holds(f, fields) for f in self.filters)

    def partitions(self) -> list[_Files]:
        store, path = _open(self.path)
        found = sorted((f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and re.search(r"\.warc(\.gz)?$", f.base_name) and not f.base_name.startswith("_")), key=lambda f: -f.size)
        runs: list[list[str]] = []
        size = 0
        for f in found:
            if not runs or size + f.size > PARTITION_BYTES:
                runs.append([])
                size = 0
            runs[-1].append(f.path)
            size += f.size
        return [_Files(r) for r in runs] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        kind = pa.schema([*((c, pa.int64() if c == "payload_length" else pa.string()) for c in _COLUMNS), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows, size = [], 0
        for path in partition.files:
            with store.open_input_file(path) as file:
                for fields, data in _records(file, self.wanted, self.payload):
                    rows.append([*(fields[c] for c in _COLUMNS), list(fields["headers"].items()), data])
                    size += 500 + len(data or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


def _holds(f: Filter, fields: dict) -> bool:
    if isinstance(f, Not):
        known = f.child.attribute
        return (isinstance(f.child, (IsNull, IsNotNull)) or _value(known, fields) is not None) and not _holds(f.child, fields)
    value = _value(f.attribute, fields)
    if isinstance(f, IsNull):
        return value is None
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return value.startswith(f.value) if isinstance(f, StringStartsWith) else True


def _value(name: tuple, fields: dict):
    return fields["headers"].get(name[1].lower()) if name[0] == "headers" else fields[name[0]]


class WarcSource(DataSource):
    """``format("warc")``: option ``path``; option ``payload`` false leaves payloads null and undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


LEAST_REVISIT_BYTES = 1000


def archive(pages: DataFrame, path: str) -> None:
    """Writes a record for each row: of equal payloads of at least 1000 bytes the one with the largest page_id is the
    response and the others revisit it; all smaller ones are responses.

    A null html is an empty payload; a row without an id revisits one that has an id, and is a response if none has.
    Rows with one id and equal payloads are each what that id is. Only digests and ids meet by digest; pages that
    revisit are then marked by id.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("long"))
    large = rows.select("page_id", "digest", "length").where(F.col("length") >= LEAST_REVISIT_BYTES)
    best = large.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("best").isNotNull())
    again = large.join(best, "digest").where(~F.col("page_id").eqNullSafe(F.col("best"))).select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "best").distinct()
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    revisit = F.col("best").isNotNull()
    marked.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.col("digest").alias("payload_digest"),
        F.when(revisit, urn(F.col("best"))).alias("refers_to"),
        F.col("length").alias("payload_length"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload)).load(path)
