"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans its partitions from the files' sizes, takes predicates on the record type and on the
other header columns, parses a record's headers first and skips the rest of a record that
is not wanted: it seeks past it in plain files and in compressed ones whose members carry
their length (the ``sl`` field of the gzip header, which the writer here sets); other members are
inflated without being parsed. Option ``payload`` says what becomes of wanted payloads:
``read`` returns them, ``verify`` compares them with their digests and returns nulls, ``skip`` leaves them.

Files are opened through pyarrow's file systems, so a path may be local, hdfs:// or s3://.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringStartsWith,
    WriterCommitMessage,
)

from crewmetrics.llm.common import Scratch

SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, payload binary"
)
#: Columns that are known from a record's headers alone.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Base32 as RFC 4648 has it.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes read at once: few at first, as most records are short.
FIRST, BLOCK = 1 << 12, 1 << 16


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(row: dict) -> bytes:
    """One record; a revisit has the headers of its payload but not the payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {row['date']}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {quote(row['target_uri'], safe=':/?#[]@!$&()*+,;=%~')}")
    if row["refers_to"] is not None:
        head += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """A gzip member whose header tells its own length and that of the record."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    length = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return (
        b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
        + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    )


class _Bytes:
    """What follows one position of a file: the bytes of a record, inflated as far as asked for."""

    def __init__(self, file, at: int, zipped: bool):
        self.file, self.at, self.inflate = file, at, zlib.decompressobj(31) if zipped else None
        self.length, self.fed, self.have, self.rest, self.block = None, 0, bytearray(), b"", FIRST
        file.seek(at)
        if zipped:
            start = file.read(24)
            if start[2:4] == b"\x08\x04" and start[12:16] == b"sl\x08\x00":
                self.length = struct.unpack("<I", start[16:20])[0]
            file.seek(at)

    def _read(self) -> bytes:
        size, self.block = self.block, min(BLOCK, 2 * self.block)
        return self.file.read(size if self.length is None else min(size, self.length - self.fed))

    def more(self) -> bool:
        if self.inflate is None:
            block = self._read()
            self.have += block
            return bool(block)
        if self.inflate.eof:
            return False
        block = self.rest or self._read()
        if not block:
            raise ValueError(f"the member at {self.at} ends too early")
        self.fed += 0 if self.rest else len(block)
        self.have += self.inflate.decompress(block, BLOCK)
        self.rest = self.inflate.unconsumed_tail
        return True

    def upto(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        return bytes(self.have[:n])

    def until(self, mark: bytes, begin: int = 0) -> int:
        """Where the bytes after ``mark`` begin."""
        while (found := self.have.find(mark, begin)) < 0:
            if not self.more():
                raise ValueError(f"the record at {self.at} has no end of its headers")
        return found + len(mark)

    def end(self, size: int) -> int:
        """Where the next record begins, after ``size`` bytes of this one."""
        if self.inflate is None:
            return self.at + size
        if self.length:
            return self.at + self.length
        while not self.inflate.eof:
            self.more()
            self.have.clear()
        return self.at + self.fed - len(self.inflate.unused_data)


def _headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        found[key.strip().lower()] = value.strip()
    return found


def _column(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADERS[column].lower())
    if value is not None and column in ("record_id", "refers_to"):
        value = value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if value is not None and column == "payload_digest" else value


def records(file, size: int, zipped: bool, wanted, payload: str) -> Iterator[tuple]:
    """The wanted records of a file as rows of ``SCHEMA``."""
    at = 0
    while at < size:
        data = _Bytes(file, at, zipped)
        begin = data.until(b"\r\n\r\n")
        headers = _headers(bytes(data.have[: begin - 4]))
        block = int(headers["content-length"])
        row = {c: _column(headers, c) for c in HEADERS}
        if wanted(row):
            body, n_bytes = None, block
            if headers.get("content-type", "").startswith("application/http"):
                http = data.until(b"\r\n\r\n", begin)
                n_bytes = begin + block - http
                if row["record_type"] == "revisit":
                    n_bytes = int(_headers(bytes(data.have[begin : http - 4])).get("content-length", 0))
            else:
                http = begin
            if payload != "skip" and row["record_type"] != "revisit":
                body = data.upto(begin + block)[http:]
                if payload == "verify":
                    if len(body) != n_bytes or row["payload_digest"] not in (None, digest_of(body)):
                        raise ValueError(f"record {row['record_id']} has another payload than its digest says")
                    body = None
            yield (*row.values(), n_bytes, body)
        at = data.end(begin + block + 4)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "read")
        self.most = int(options.get("partitionbytes", 128 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            inner, sign = (f.child, "not ") if isinstance(f, Not) else (f, "")
            column = getattr(inner, "attribute", (None,))
            if len(column) == 1 and column[0] in HEADERS and isinstance(inner, (EqualTo, In, IsNull, IsNotNull, StringStartsWith)):
                values = inner.value if isinstance(inner, In) else (getattr(inner, "value", None),)
                self.tests.append((column[0], sign + type(inner).__name__, tuple(values)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for column, test, values in self.tests:
            value, kind = row[column], test.removeprefix("not ")
            if kind in ("IsNull", "IsNotNull"):
                ok = (value is None) == (kind == "IsNull")
            elif value is None:
                return False  # neither a comparison with a null nor its negation holds
            else:
                ok = value.startswith(values[0]) if kind == "StringStartsWith" else value in values
            if ok == test.startswith("not "):
                return False
        return True

    def partitions(self):
        store, path = _open(self.path)
        found = store.get_file_info(path)
        infos = [found] if found.is_file else store.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.is_file and i.path.endswith((".warc", ".warc.gz")))
        bins: list[list[tuple[str, int]]] = []
        room = 0
        for file, size in files:
            if room < size or not bins:
                bins.append([])
                room = self.most
            bins[-1].append((file, size))
            room -= size
        return [Files(b) for b in bins] or [Files([])]

    def read(self, partition):
        store, _ = _open(self.path)
        for path, size in partition.files:
            with store.open_input_file(path) as file:
                yield from records(file, size, path.endswith(".gz"), self.wanted, self.payload)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own; only those of committed ones get their final names."""

    def __init__(self, options: dict):
        self.path, self.level = options["path"].rstrip("/"), int(options.get("level", 4))
        self.most, self.zipped = int(options.get("filebytes", 256 << 20)), options.get("compress", "true") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = _open(self.path)
        store.create_dir(path, recursive=True)
        done, out, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.zipped
                    done.append((f"{path}/_{name}.tmp", f"{path}/{name}"))
                    out, size = store.open_output_stream(done[-1][0], compression=None), 0
                record = record_bytes({name: batch.column(name)[i].as_py() for name in batch.schema.names})
                size += out.write(member(record, self.level) if self.zipped else record) or 0
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages) -> None:
        store, _ = _open(self.path)
        for message in messages:
            for made, final in message.files if message else ():
                store.move(made, final)

    def abort(self, messages) -> None:
        store, _ = _open(self.path)
        for message in messages:
            for made, _ in message.files if message else ():
                store.delete_file(made)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32(hexadecimal: Column) -> Column:
    """Base32 of the 20 bytes that 40 hexadecimal digits stand for: 10 digits are 8 letters."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_pages(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html) into archives under ``path``.

    Among rows with equal payloads of at least ``min_bytes`` bytes those with the smallest page_id
    are responses, the others revisit it; rows with smaller payloads are all responses. A null html
    is an empty payload, a null url no target. A null page_id comes after all others, and
    a group without any page_id has only responses. Rows that repeat a page_id with its payload
    are of one kind. No pages make no archive. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = pages.select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("hex")
    )
    copies = scratch.save(
        pages.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("hex", "payload_bytes")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n")
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = pages.join(copies, ["hex", "payload_bytes"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(revisit, F.concat(F.lit("urn:x-page:"), F.col("first_id").cast("string"))).alias("refers_to"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        base32(F.col("hex")).alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    register(pages.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: str = "read") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def page_records(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that ``write_pages`` made."""
    number = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1)
    return archives.select(
        F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.nullif(number("refers_to"), F.lit("")).cast("long").alias("refers_to"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives of all pages in the shared folder, read back; stored payloads are held against their digests."""
    spark = pages.sparkSession
    path = Scratch(spark).path()
    path = path if ":/" in path else f"file://{path}"
    write_pages(pages, path, min_bytes)
    return page_records(read_archives(spark, path, "verify"))


ORACLE = f"""
with p as (
  select page_id, coalesce(html, '') as body from pages
), h as (
  select page_id, cast(strlen(body) as bigint) as payload_bytes, sha1(body) as hx from p
), f as (
  select *, min(page_id) over (partition by hx, payload_bytes) as first_id from h
)
select page_id, payload_bytes,
  array_to_string([substr('{BASE32}',
    1 + cast((cast('0x' || substr(hx, cast(k // 8 * 10 + 1 as int), 10) as bigint) >> cast(35 - 5 * (k % 8) as int)) & 31 as int), 1) for k in range(0, 32)], '')
    as payload_digest,
  case when page_id is distinct from first_id and first_id is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first_id and first_id is not null then first_id end as refers_to
from f
"""
