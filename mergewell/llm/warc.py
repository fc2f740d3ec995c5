"""WARC archives as a PySpark data source, and page archives with revisit records.

Writing: every task writes compressed archives of about ``roll_bytes`` under names that no other
attempt uses; each write adds a manifest of its own, moved into place whole, that names the files of the
attempts that Spark committed, so a retried or abandoned task leaves nothing that a reader sees and a
folder can be appended to.  Each record is a gzip member of its own, and the
member's length stands in a gzip extra field.

Reading: one input partition for each run of files up to ``split_bytes``.  Equality and membership
tests on the record type and on headers are pushed down.  A record's headers are inflated first; if
they fail a test, or if the payload isn't wanted (option ``payload`` = ``false``), the rest of the
member is skipped by its length, or inflated and thrown away in archives of other writers.

Folders are opened with ``pyarrow.fs``: local and shared paths, HDFS and object stores.

Defined results: null html is an empty payload; of rows that tie on payload and largest ``page_id`` all
are responses; repeated rows are records each; very long payloads are inflated a megabyte at a time and
held whole one by one; extra columns of the pages are ignored; an empty table gives an empty archive,
which reads as no record; a null ``page_id`` is read back as null.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from mergewell.workspace import fresh_path, materialize

MANIFEST = "manifest-"
#: Spark lets Python data sources take filters only where this is set; ``pushing`` sets it for a block.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = (
    "record_type string, record_id string, target_uri string, page_id long, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary"
)
#: Columns whose value is in the headers, hence known before the payload.
HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "page_id", "payload_bytes", "payload_digest", "refers_to")
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
GZIP = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
READ = 1 << 20


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def member(content: bytes, level: int) -> bytes:
    """A gzip member whose extra field holds its own length."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(content) + squeeze.flush()
    length = len(GZIP) + 2 + 8 + len(body) + 8
    extra = struct.pack("<H2sHI", 8, b"WL", 4, length)
    return GZIP + extra + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    """No line can end inside a header."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(row: dict) -> bytes:
    """One WARC record of a page."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    block = HTTP % (0 if revisit else len(payload)) + (b"" if revisit else payload)
    headers = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", record_id(row["page_id"])),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if row["target_uri"] is None else _clean(row["target_uri"])),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(row["refers_to"]) if revisit else None),
        ("Page-Id", row["page_id"]),
        ("Page-Refers-To", row["refers_to"]),
        ("Page-Payload-Length", row["payload_bytes"]),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def manifests(fs: pafs.FileSystem, base: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.startswith(MANIFEST) and f.base_name.endswith(".json"))


def read_manifest(fs: pafs.FileSystem, base: str, name: str) -> list[dict]:
    with fs.open_input_stream(f"{base}/{name}", compression=None) as file:
        return json.loads(file.read())["files"]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 3)), overwrite
        self.roll = int(options.get("roll_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = open_folder(self.path)
        files, out, name, size, records = [], None, "", 0, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, size, records = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(row), self.level)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= self.roll:
                    out.close()
                    files.append({"name": name, "bytes": size, "records": records})
                    out = None
        if out is not None:
            out.close()
            files.append({"name": name, "bytes": size, "records": records})
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = open_folder(self.path)
        fs.create_dir(base, recursive=True)
        before = manifests(fs, base) if self.overwrite else []
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{base}/_{name}", compression=None) as out:
            out.write(json.dumps({"files": files}).encode())
        fs.move(f"{base}/_{name}", f"{base}/{MANIFEST}{name}.json")
        for old in before:
            gone = read_manifest(fs, base, old)
            fs.delete_file(f"{base}/{old}")
            for f in gone:
                fs.delete_file(f"{base}/{f['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = open_folder(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                fs.delete_file(f"{base}/{f['name']}")


def parse_headers(head: bytes) -> dict[str, str]:
    """Headers by lower-case name; the last of several counts, folded lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _digest(value: str | None) -> str | None:
    """Bare lower-case hex of a ``sha1:`` digest in base 32 or 16; others as they are."""
    if not value or not value.lower().startswith("sha1:"):
        return value
    text = value[5:]
    if len(text) == 32:
        return base64.b32decode(text.upper()).hex()
    return text.lower()


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and value.lstrip("-").isdigit() else None


def described(headers: dict[str, str]) -> dict:
    return {
        "record_type": headers.get("warc-type"),
        "record_id": headers.get("warc-record-id"),
        "target_uri": headers.get("warc-target-uri"),
        "page_id": _number(headers.get("page-id")),
        "payload_bytes": _number(headers.get("page-payload-length")),
        "payload_digest": _digest(headers.get("warc-payload-digest")),
        "refers_to": _number(headers.get("page-refers-to")),
    }


class _Stream:
    """Buffered reading of a file, with skipping and handing back."""

    def __init__(self, file):
        self.file, self.buffer, self.spot, self.at = file, b"", 0, 0

    def fill(self, n: int) -> bool:
        while len(self.buffer) - self.spot < n:
            more = self.file.read(max(READ, n))
            if not more:
                return False
            self.buffer, self.spot = self.buffer[self.spot :] + more, 0
        return True

    def peek(self, n: int) -> bytes:
        self.fill(n)
        return self.buffer[self.spot : self.spot + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.spot, self.at = self.spot + len(out), self.at + len(out)
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.buffer) - self.spot:
            self.take(n)
        else:
            self.at += n
            self.file.seek(self.at)
            self.buffer, self.spot = b"", 0

    def back(self, data: bytes) -> None:
        self.at -= len(data)
        if self.spot >= len(data):
            self.spot -= len(data)
        else:
            self.buffer, self.spot = data + self.buffer[self.spot :], 0


class _Member:
    """One gzip member (or the rest of an uncompressed file), inflated as far as it is asked for."""

    def __init__(self, stream: _Stream):
        self.stream, self.begin = stream, stream.at
        start = stream.peek(20)
        self.gzip = start[:2] == b"\x1f\x8b"
        self.length = struct.unpack("<I", start[16:20])[0] if start[3:4] == b"\x04" and start[10:16] == b"\x08\x00WL\x04\x00" else None
        self.inflate = zlib.decompressobj(31) if self.gzip else None
        self.ready, self.ended = b"", False

    def more(self, n: int) -> bool:
        """Inflate until ``n`` bytes are ready; false if the member ends before."""
        while len(self.ready) < n and not self.ended:
            if not self.gzip:
                chunk = self.stream.take(max(READ, n - len(self.ready)))
                self.ready += chunk
                self.ended = not chunk
                continue
            left = 1 << 14 if self.length is None else min(1 << 14, self.begin + self.length - self.stream.at)
            data = self.inflate.unconsumed_tail or self.stream.take(left)
            if not data:
                self.ended = True
                break
            self.ready += self.inflate.decompress(data, max(4096, n - len(self.ready)))
            if self.inflate.eof:
                self.ended = True
        return len(self.ready) >= n

    def take(self, n: int) -> bytes:
        self.more(n)
        out, self.ready = self.ready[:n], self.ready[n:]
        return out

    def head(self) -> bytes | None:
        """Up to the empty line that ends the headers; leading line breaks are passed over."""
        n = 2048
        while True:
            full = self.more(n)
            self.ready = self.ready.lstrip(b"\r\n")
            end = self.ready.find(b"\r\n\r\n")
            if end >= 0:
                return self.take(end + 4)[:end]
            if not full:
                return None
            n = 2 * max(n, len(self.ready))

    def drop(self, n: int) -> None:
        while n > 0:
            got = len(self.take(min(n, READ)))
            if not got:
                return
            n -= got

    def finish(self) -> None:
        """Go on to the next member, by its length if it is known."""
        stream = self.stream
        if not self.gzip:
            return
        if self.length is not None:
            stream.skip(self.begin + self.length - stream.at)
            return
        while not self.ended:
            self.ready = b""
            self.more(READ)
        stream.back(self.inflate.unused_data)


def read_records(file, tests: list[tuple[str, frozenset]], payload: bool) -> Iterator[dict]:
    """The records of one archive that pass ``tests`` on header columns."""
    stream = _Stream(file)
    while stream.fill(1):
        part = _Member(stream)
        while (head := part.head()) is not None:
            headers = parse_headers(head)
            length = _number(headers.get("content-length")) or 0
            row = described(headers)
            wanted = all(row[column] in values for column, values in tests)
            body = None
            if wanted and payload and row["record_type"] != "revisit":
                body = part.take(length)
                if headers.get("content-type", "").startswith("application/http"):
                    body = body.partition(b"\r\n\r\n")[2]
            elif not part.gzip or part.length is None:
                part.drop(length)
            if wanted:
                yield row | {"payload": body}
            if part.length is not None:
                break
        part.finish()
        if not part.gzip:
            return


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.split, self.batch = int(options.get("split_bytes", 32 << 20)), int(options.get("batch_bytes", 8 << 20))
        self.tests: list[tuple[str, frozenset]] = []

    def partitions(self) -> Sequence[Files]:
        fs, base = open_folder(self.path)
        written = manifests(fs, base)
        if written:
            files = sorted((f["name"], f["bytes"]) for m in written for f in read_manifest(fs, base, m))
        else:
            found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
            files = sorted((f.base_name, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz")))
        out, size = [], self.split
        for name, n in files:
            if size + n > self.split:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(self.path)
        schema = pa.schema(
            [(c, pa.int64() if c in ("page_id", "payload_bytes", "refers_to") else pa.string()) for c in HEADER_COLUMNS]
            + [("payload", pa.binary())]
        )
        rows, size = [], 0
        for name in partition.names:
            with fs.open_input_file(f"{base}/{name}") as file:
                for row in read_records(file, self.tests, self.payload):
                    rows.append(row)
                    size += 256 + len(row["payload"] or b"")
                    if size >= self.batch:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class PushingReader(WarcReader):
    """A reader that takes tests on header columns."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.tests.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value) - {None}))
            else:
                yield f


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return PushingReader(self.options) if self.options.get("push") == "true" else WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def page_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """A record for every row of ``pages (page_id, url, html)``, payloads of revisits left out.

    Null html is an empty payload.  Of equal payloads of at least ``least_bytes`` the rows with the
    largest ``page_id`` are responses (all of them, if that row is repeated) and the others revisits;
    rows without a ``page_id`` are always responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    last = (
        rows.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    revisit = F.col("page_id") < F.col("_last")
    return rows.join(last, ["payload_digest", "payload_bytes"], "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.lit(None).cast("string").alias("record_id"),
        "target_uri",
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, F.col("_last")).alias("refers_to"),
        F.when(F.coalesce(revisit, F.lit(False)), None).otherwise(F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    records.sparkSession.dataSource.register(WarcDataSource)
    records.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.format("warc").options(**options).mode(mode).save(path)


@contextmanager
def pushing(spark: SparkSession) -> Iterator[None]:
    """Let archives that are read and used inside the block take filters; the session's setting is put back afterwards."""
    before = spark.conf.get(PUSHDOWN, None)
    spark.conf.set(PUSHDOWN, "true")
    try:
        yield
    finally:
        spark.conf.unset(PUSHDOWN) if before is None else spark.conf.set(PUSHDOWN, before)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of the archives under ``path``.  Filters on header columns are pushed down inside ``pushing``."""
    spark.dataSource.register(WarcDataSource)
    push = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("warc").options(push=push, **options).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages``, read the archives back and describe every record by what was read.

    Responses are described by their payload.  A second pass reads the other records, of which only the
    headers are inflated.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(page_records(pages), path)
    with pushing(spark):
        full = read_warc(spark, path).filter("record_type = 'response'").select(
            "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to"
        )
        bare = read_warc(spark, path, payload="false").filter("record_type = 'revisit'").select(*full.columns)
        return materialize(full.unionByName(bare), "records")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM m
"""
