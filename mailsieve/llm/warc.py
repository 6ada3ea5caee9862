"""WARC archives as a PySpark Python data source.

Writing: one record per row, each in a gzip member of its own that states its packed size (the "sl" extra
field), so a reader can step over it. Reading: the driver lists the files and plans partitions of bounded
size; filters on record type and on the header columns are pushed into the reader, which
unpacks only the header of a record, tests it, and skips the packed payload of rejected records, or of
all records when no column needs the payload. Archives of other writers are read as well: from the first
member that doesn't state its size a file is unpacked to its end, and .warc files are read as they are. Absent headers
come back null; of an HTTP message the payload is what follows its header, and its digest isn't compared.

Writing adds to a folder: other archives in it stay, unless the save mode is overwrite.

Defined cases: a null payload is empty; null fields have no header and come back null; a null page id is a
response nobody refers to unless no other page shares its payload; repeated rows are repeated records; rows
of equal largest page id are all responses; an empty table writes no file and reads as no record. Extra
columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

SCHEMA = (
    "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, "
    "refers_to long, payload binary"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
PARTITION_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def clean(value: str) -> str:
    """A header value may not hold line ends; they are written in percent form."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def pack(row: dict) -> bytes:
    """One record as a gzip member with its packed and unpacked size in the extra field."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {clean(row['target_uri'])}")
    head += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    plain = "\r\n".join(head).encode() + body + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = packer.compress(plain) + packer.flush()
    total = 12 + 12 + len(packed) + 8
    extra = struct.pack("<2sHII", b"sl", 8, total & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file under a fresh name; a task that fails or repeats leaves its file unnamed
    by the commit, and the commit removes what it doesn't know among the files of its own job, or of all with ``overwrite``."""

    def __init__(self, folder: str, overwrite: bool = False):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        out, path = None, f"{root}/{self.job}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    out = out or store.open_output_stream(path, compression=None)
                    out.write(pack(row))
        if out:
            out.close()
        return Written([path] if out else [])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(root, recursive=True)
        known = {p.rsplit("/", 1)[-1] for m in messages if m for p in m.paths}
        for info in store.get_file_info(fs.FileSelector(root)):
            mine = self.overwrite or info.base_name.startswith(f"{self.job}-")
            if mine and info.base_name.endswith(".warc.gz") and info.base_name not in known:
                store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            for path in m.paths if m else []:
                store.delete_file(path)


def headers(raw: bytes) -> dict[str, str]:
    """Fields of a record's header by lower-case name."""
    lines = raw.decode(errors="replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
    out, name = {}, ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            # Blanks belong to a written address, but for the one behind the colon.
            out[name] = value.removeprefix(" ") if name == "warc-target-uri" else value.strip(" \t")
    return out


def is_http(head: dict[str, str]) -> bool:
    return head.get("content-type", "").lower().startswith("application/http")


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if is_http(head) else block


class Member:
    """A record's header, unpacked; the rest of it only on demand. ``sized`` tells whether the member states its size."""

    def __init__(self, file, start: int):
        self.file, self.start = file, start
        fixed = file.read(12)
        self.end = not fixed
        if self.end:
            return
        if fixed[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {start}")
        extra = file.read(struct.unpack("<H", fixed[10:])[0]) if fixed[3] == 4 and len(fixed) == 12 else b""
        self.sized = len(extra) >= 12 and extra[:2] == b"sl"
        if not self.sized:
            return
        _, _, self.size, self.plain = struct.unpack("<2sHII", extra[:12])
        self.unpacker, self.got = zlib.decompressobj(-15), b""
        self.left = self.size - 12 - len(extra) - 8
        while (cut := self.got.find(b"\r\n\r\n")) < 0 and self.left:
            part = file.read(min(self.left, 2048))
            self.left -= len(part)
            self.got += self.unpacker.decompress(part, 4096)
            while self.got.find(b"\r\n\r\n") < 0 and self.unpacker.unconsumed_tail:
                self.got += self.unpacker.decompress(self.unpacker.unconsumed_tail, 4096)
        self.head = headers(self.got[:cut])
        self.body_at = cut + 4

    def payload(self) -> bytes:
        parts = [self.got, self.unpacker.decompress(self.unpacker.unconsumed_tail + self.file.read(self.left))]
        return payload_of(self.head, b"".join(parts)[self.body_at : self.body_at + int(self.head["content-length"])])

    def skip(self) -> int:
        """Place of the next record."""
        return self.start + self.size


class Unpacked:
    """The bytes of a file from ``start`` on, out of gzip members one after another or as they are."""

    def __init__(self, file, start: int, packed: bool):
        file.seek(start)
        self.file, self.packed, self.unpacker, self.got = file, packed, None, bytearray()

    def fill(self) -> bool:
        """Gets more bytes; False at the end of the file."""
        rest = self.unpacker.unused_data or self.unpacker.unconsumed_tail if self.unpacker else b""
        part = rest or self.file.read(1 << 16)
        if not self.packed:
            self.got += part
            return bool(part)
        if not part and (not self.unpacker or self.unpacker.eof):
            return False
        if not self.unpacker or self.unpacker.eof:
            self.unpacker = zlib.decompressobj(31)
        more = self.unpacker.decompress(part, 1 << 18)
        if not part and not more and not self.unpacker.eof:
            raise ValueError("a gzip member ends before its time")
        self.got += more
        return True

    def next_header(self) -> bytes | None:
        """The next record's header; line ends before it belong to the record before."""
        while True:
            kept = self.got.lstrip(b"\r\n")
            if kept:
                self.got = kept
                break
            self.got.clear()
            if not self.fill():
                return None
        seen = 0
        while (cut := self.got.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.got)
            if not self.fill():
                raise ValueError("a record's header ends before its time")
        raw = bytes(self.got[:cut])
        del self.got[: cut + 4]
        return raw

    def block(self, length: int, wanted: bool) -> bytes:
        """The next ``length`` bytes, or nothing where they are only passed over."""
        parts = []
        while length:
            if not self.got and not self.fill():
                raise ValueError("a record ends before its time")
            part = bytes(self.got[:length])
            del self.got[: len(part)]
            length -= len(part)
            if wanted:
                parts.append(part)
        return b"".join(parts)


class Record:
    """A record among unpacked bytes; they are left behind it once ``payload`` or ``pass_over`` was called."""

    def __init__(self, stream: Unpacked, head: dict[str, str], start: int):
        self.stream, self.head, self.start, self.left = stream, head, start, int(head["content-length"])

    def payload(self) -> bytes:
        length, self.left = self.left, 0
        return payload_of(self.head, self.stream.block(length, True))

    def pass_over(self) -> None:
        self.stream.block(self.left, False)


def records(file, packed: bool) -> Iterator[Member | Record]:
    """The records of a file in order. Those of a member without a size are known by the place where such members begin."""
    at = 0
    while packed:
        member = Member(file, at)
        if member.end:
            return
        if not member.sized:
            break
        yield member
        at = member.skip()
        file.seek(at)
    stream = Unpacked(file, at, packed)
    while (raw := stream.next_header()) is not None:
        record = Record(stream, headers(raw), at)
        yield record
        record.pass_over()


def header_row(head: dict[str, str]) -> dict:
    number = lambda name: int(head[name]) if name in head else None
    uri, digest = head.get("warc-target-uri"), head.get("warc-payload-digest")
    # Only this module's records, which state their payload's length, write line ends in percent form.
    own = "x-payload-length" in head
    return {
        "page_id": number("x-page-id"),
        "record_type": head.get("warc-type"),
        "target_uri": unclean(uri) if uri is not None and own else uri,
        "payload_digest": digest.removeprefix("sha1:") if digest is not None else None,
        "payload_bytes": number("x-payload-length"),
        "refers_to": number("x-refers-to-page"),
    }


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...] = ()


class WarcReader(DataSourceReader):
    """``columns`` limits what is decoded; filters arrive through ``pushFilters``."""

    def __init__(self, folder: str, columns: list[str], partition_bytes: int):
        self.folder, self.columns, self.partition_bytes = folder, columns, partition_bytes
        self.tests: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in COLUMNS[:-1] and isinstance(f, EqualTo):
                self.tests.append((name, (f.value,)))
            elif name in COLUMNS[:-1] and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            elif name in COLUMNS[:-1] and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        plans, held = [[]], 0
        for info in sorted((i for i in found if i.base_name.endswith((".warc.gz", ".warc"))), key=lambda i: i.path):
            if plans[-1] and held + info.size > self.partition_bytes:
                plans.append([])
                held = 0
            plans[-1].append(info.path)
            held += info.size
        return [Files(tuple(p)) for p in plans]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        wanted = "payload" in self.columns
        rows, held = [], 0
        kinds = {"record_type": pa.string(), "target_uri": pa.string(), "payload_digest": pa.string(), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in self.columns])
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for record in records(file, path.endswith(".gz")):
                    row = header_row(record.head)
                    if all((row[c] is not None) if v is None else row[c] in v for c, v in self.tests):
                        if wanted:
                            row["payload"] = record.payload() if row["record_type"] != "revisit" else None
                            told = record.head.get("warc-payload-digest", "")
                            if row["payload"] is not None and told.startswith("sha1:") and not is_http(record.head) and base32_digest(row["payload"]) != row["payload_digest"]:
                                raise ValueError(f"{path}: the record at byte {record.start} doesn't match its digest")
                            held += len(row["payload"] or b"")
                        rows.append({c: row[c] for c in self.columns})
                    if len(rows) >= 4096 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """``spark.read.format("warc")``: options path, columns (comma-joined), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def _columns(self) -> list[str]:
        return self.options.get("columns", ",".join(COLUMNS)).split(",")

    def schema(self) -> str:
        kinds = dict(part.split() for part in SCHEMA.split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in self._columns())

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], self._columns(), int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32(sha1_hex: F.Column) -> F.Column:
    """Upper-case base32 of a SHA-1 in hex: eight groups of five hex digits, four letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for group in range(8):
        value = F.conv(F.substring(sha1_hex, group * 5 + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def as_records(pages: DataFrame) -> DataFrame:
    """Rows to write: of pages with equal payloads the largest page_id is the response, others revisit it."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # Counts are combined before the shuffle, so a payload shared by a third of all pages is one row per task.
    last = rows.groupBy("sha1").agg(F.max("page_id").alias("last_id"))
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return rows.join(last, "sha1").select(
        "page_id",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        base32(F.col("sha1")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("last_id")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, folder: str) -> None:
    """Write a record per page (page_id, url, html) below ``folder``."""
    register(pages.sparkSession)
    as_records(pages).write.format("warc").option("path", folder).mode("append").save()


def read_warc(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Records below ``folder``; leaving "payload" out of ``columns`` skips all payloads."""
    register(spark)
    return spark.read.format("warc").option("path", folder).option("columns", ",".join(columns or COLUMNS)).load()
