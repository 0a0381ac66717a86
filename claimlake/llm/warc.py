"""WARC archives as a Spark data source, for reading and writing.

Reading: files are planned into partitions of about `partitionBytes`; filters on header columns are pushed into the scan. A
record's headers are parsed first; if they fail a filter, its block is skipped without being decoded, by a seek in a plain
file or in one whose gzip members say their length, else by inflating past it. A payload is only taken if the schema asks for
it, so `.schema(...)` without `payload` reads headers alone. A task holds one record and one batch of rows at a time.

Writing: a task writes whole records, each its own gzip member, into files of at most `fileBytes` (or one record). Files are
hidden until the job commits, so a lost or repeated task leaves nothing behind; what failed attempts wrote is never read.

A record: `record_type, record_id, target_uri, date, refers_to, payload_digest, content_type, http, payload`; http is the block's
HTTP head without its blank line, payload what follows. Reading adds content_length and headers (all named fields, lower case;
repeated ones joined by a comma).

Nulls: a null column writes no header, a null payload is empty. Control characters and spaces of header values are percent-encoded in URIs and
identifiers and become spaces elsewhere. Empty and long payloads are kept as they are; a file that ends within a record raises an error.
An empty table writes no file, and an empty folder reads as no rows. Extra columns are not written.

`archived` writes pages and gives equal payloads one response, `page_records` reads them back.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.llm.common import stash

#: Named fields of the format, by column.
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", content_length long, headers map<string, string>, http string, payload binary"
_HTTP = "application/http"
_CHUNK = 1 << 18
_BATCH_BYTES = 8 << 20
_HEAD_MOST = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# ---- bytes of a file ----


class Plain:
    """A file as it is, with a buffer; skipping seeks."""

    def __init__(self, file) -> None:
        self.file, self.held = file, bytearray()

    def more(self) -> bool:
        got = self.file.read(_CHUNK)
        self.held += got
        return bool(got)

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise EOFError("the file ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, end: bytes) -> bytes | None:
        """Up to and with `end`; None at the end of the file."""
        seen = 0
        while (at := self.held.find(end, max(0, seen - len(end)))) < 0:
            seen = len(self.held)
            if seen > _HEAD_MOST:
                raise ValueError("no WARC header")
            if not self.more():
                if bytes(self.held).strip():
                    raise EOFError("the file ends within a header")
                return None
        return self.take(at + len(end))

    def skip(self, n: int, record: int) -> None:
        """n bytes on, to the end of a record of so many bytes."""
        if n <= len(self.held):
            del self.held[:n]
        else:
            self.file.seek(n - len(self.held), 1)
            self.held.clear()


class Inflated(Plain):
    """A gzip file of any number of members, inflated; a member that says its length is left by a seek."""

    def __init__(self, file) -> None:
        super().__init__(file)
        self.raw, self.z, self.member = b"", None, None

    def more(self) -> bool:
        if self.z is None or self.z.eof:
            self.raw = ((self.z.unused_data if self.z else b"") + self.raw).lstrip(b"\0")
            if len(self.raw) < 64:
                self.raw += self.file.read(_CHUNK)
            if not self.raw.strip(b"\0"):
                return False
            self.member = self._lengths(self.file.tell() - len(self.raw))
            self.z = zlib.decompressobj(31)
        chunk = self.raw or self.file.read(_CHUNK)
        found = self.z.decompress(chunk, _CHUNK)
        if not (chunk or found or self.z.eof):
            raise EOFError("the file ends within a gzip member")
        self.held += found
        self.raw = b"" if self.z.eof else self.z.unconsumed_tail  # behind the member's end, unused_data has the rest
        return True

    def _lengths(self, at: int) -> tuple[int, int] | None:
        """(offset behind the member, its bytes inflated), if the member's extra field `sl` says them."""
        head = self.raw[:24]
        if len(head) == 24 and head[3] & 4 and head[10:16] == b"\x0c\0sl\x08\0":
            packed, plain = struct.unpack("<II", head[16:24])
            return at + packed, plain
        return None

    def skip(self, n: int, record: int) -> None:
        if self.member and self.member[1] == record and n > len(self.held):
            self.file.seek(self.member[0])
            self.held.clear()
            self.raw, self.z = b"", None
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if not self.more():
                raise EOFError("the file ends within a record")
        del self.held[:n]


def named_fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def records(file, wanted, payload: bool) -> Iterator[dict]:
    """The records whose headers are wanted; payload: whether it is taken."""
    magic = file.read(2)
    file.seek(0)
    source = (Inflated if magic == b"\x1f\x8b" else Plain)(file)
    while (head := source.until(b"\r\n\r\n")) is not None:
        size, head = len(head), head.lstrip(b"\r\n")
        if not head:
            continue
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC header")
        headers = named_fields(head)
        length = int(headers["content-length"])
        row = {c: headers.get(f.lower()) for c, f in FIELDS.items()} | {"content_length": length, "headers": headers, "http": None, "payload": None}
        rest, record = length + 4, size + length + 4
        if not wanted(row):
            source.skip(rest, record)
            continue
        if (row["content_type"] or "").startswith(_HTTP):
            while (at := source.held.find(b"\r\n\r\n", 0, length)) < 0 and len(source.held) < min(length, _HEAD_MOST):
                if not source.more():
                    raise EOFError("the file ends within a record")
            if at >= 0:
                row["http"] = source.take(at + 4)[:-4].decode("utf-8", "replace")
                rest -= at + 4
        if payload:
            row["payload"] = source.take(rest - 4)
            rest = 4
        source.skip(rest, record)
        yield row


# ---- pushed filters ----


def judge(test: ds.Filter, row: dict) -> bool | None:
    """A filter's value on a record's headers, None for unknown."""
    if isinstance(test, ds.Not):
        found = judge(test.child, row)
        return None if found is None else not found
    value = row[test.attribute[0]]
    if isinstance(test, ds.IsNull | ds.IsNotNull):
        return (value is None) == isinstance(test, ds.IsNull)
    if isinstance(test, ds.EqualNullSafe):
        return value == test.value
    if value is None:
        return None
    if isinstance(test, ds.In):
        return True if value in test.value else None if None in test.value else False
    if test.value is None:
        return None
    return _COMPARE[type(test)](value, test.value)


_COMPARE = {
    ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: lambda a, b: b in a,
}
_ON_HEADERS = {*FIELDS, "content_length"}


def can_judge(test: ds.Filter) -> bool:
    if isinstance(test, ds.Not):
        return can_judge(test.child)
    known = (*_COMPARE, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe, ds.In)
    return isinstance(test, known) and len(test.attribute) == 1 and test.attribute[0] in _ON_HEADERS


# ---- the data source ----


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.path, self.most, self.tests = schema, options["path"], int(options.get("partitionBytes", 128 << 20)), []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for test in filters:
            if can_judge(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[ds.InputPartition]:
        system, root = _opened(self.path)
        found = system.get_file_info(root)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        kept = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.base_name[0] not in "_." and re.search(r"\.warc(\.gz)?$", f.base_name))
        plans, held = [Files([])], 0
        for path, size in kept:
            if held and held + size > self.most:
                plans.append(Files([]))
                held = 0
            plans[-1].paths.append(path)
            held += size
        return plans

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _opened(self.path)
        kind = to_arrow_schema(self.schema)
        wanted = lambda row: all(judge(t, row) for t in self.tests)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                try:
                    for row in records(file, wanted, "payload" in kind.names):
                        rows.append({c: row[c] for c in kind.names})
                        held += 512 + len(row["payload"] or b"")
                        if held > _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, held = [], 0
                except (EOFError, ValueError, KeyError, zlib.error) as wrong:
                    raise ValueError(f"{path}: {wrong}") from wrong
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


def encoded(row: dict) -> bytes:
    """A record's bytes."""
    block = (row["http"].encode() + b"\r\n\r\n" if row.get("http") is not None else b"") + (row.get("payload") or b"")
    out = ["WARC/1.1"]
    for column, field in FIELDS.items():
        if (value := row.get(column)) is not None:
            if column in ("target_uri", "record_id", "refers_to"):
                value = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
            out.append(f"{field}: {re.sub(r'[\x00-\x1f\x7f]', ' ', value)}")
    out.append(f"Content-Length: {len(block)}")
    return b"\r\n".join([*(line.encode() for line in out), b"", block, b"", b""])


def member(data: bytes, level: int) -> bytes:
    """A gzip member that says its length, packed and plain, in the extra field `sl`."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 24 + len(packed) + 8
    extra = b"\x0c\0sl\x08\0" + struct.pack("<II", whole, len(data)) if max(whole, len(data)) < 1 << 32 else b"\0\0"
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + extra + packed + tail


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most, self.level = int(options.get("fileBytes", 512 << 20)), int(options.get("level", 4))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        files, file, size = [], None, 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names) if name in FIELDS or name in ("http", "payload")}
                    data = encoded(row)
                    data = member(data, self.level) if self.level else data
                    if file and size + len(data) > self.most:
                        file.close()
                        file = None
                    if not file:
                        files.append(f"_{uuid.uuid4().hex}.warc{'.gz' if self.level else ''}")
                        file, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    file.write(data)
                    size += len(data)
        finally:
            if file:
                file.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and not f.base_name.startswith("_")] if self.overwrite else []
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: system.move(f"{root}/{f}", f"{root}/part-{f[1:]}"), [f for m in messages if m for f in m.files]))
            list(pool.map(system.delete_file, old))

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        for name in [f for m in messages if m for f in m.files]:
            system.delete_file(f"{root}/{name}")


class Warc(ds.DataSource):
    """spark.read.format("warc").load(path), df.write.format("warc").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of a file or folder; with columns, only these are decoded. Filters on header columns are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    known = T._parse_datatype_string(SCHEMA)
    return spark.read.format("warc").schema(T.StructType([known[c] for c in columns or known.names])).load(path)


def write_warc(df: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    df.sparkSession.dataSource.register(Warc)
    df.write.format("warc").mode(mode).options(**options).save(path)


# ---- pages ----

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five bits of it, four from each five hexadecimal digits."""
    hexed = F.sha1(data)

    def letter(i: Column) -> Column:
        value = F.conv(F.substring(hexed, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        bits = F.floor(value / F.pow(F.lit(2), 15 - 5 * (i % 4))).cast("int") % 32
        return F.substring(F.lit(_BASE32), bits + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def page_name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def page_of(name: Column) -> Column:
    """The page that page_name names; null for a null page."""
    return F.nullif(F.regexp_extract(name, r"^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def archived(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", **options: object) -> None:
    """Write a record per row of pages (page_id, url, html): of equal payloads of at least min_bytes the one with the largest page_id
    is a response, the others are revisits of it without payload. Rows that share that page_id as well are responses all.

    Only digests that stand in several rows meet their rows again, so payloads are shuffled only if that table is large.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    several = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).filter(F.col("n") > 1)
    shared = stash(several)  # its size is known before the join is planned
    typed = rows.join(shared, "digest", "left").withColumn("again", F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"))
    write_warc(
        typed.select(
            F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), page_name(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
            F.when(F.col("again"), page_name(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))).alias("payload_digest"),
            F.lit(f"{_HTTP};msgtype=response").alias("content_type"), head.alias("http"), F.when(~F.col("again"), F.col("payload")).alias("payload"),
        ),
        path, **options,
    )


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages: responses measured by their payload, revisits by their headers."""
    responses = read_warc(spark, path, ["record_type", "record_id", "payload"]).filter(F.col("record_type") == "response")
    revisits = read_warc(spark, path, ["record_type", "record_id", "refers_to", "payload_digest", "http"]).filter(F.col("record_type") == "revisit")
    return responses.select(
        page_of(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(revisits.select(
        page_of(F.col("record_id")).alias("page_id"), F.regexp_extract("http", r"(?i)\ncontent-length: *([0-9]+)", 1).cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to"),
    ))
