"""WARC archives as a Python data source.

``spark.read.format("warc").load(folder)`` plans partitions of whole files, takes
predicates on record_type and on the other header columns, and parses a record's headers
before its payload: where the predicates reject the record, or the schema that was asked for
has no payload, the compressed rest is skipped unread.  ``df.write.format("warc").save(folder)``
writes one gzip member a record.  Its ``sl`` extra field (WARC 1.0, annex on gzip) holds the
lengths that make skipping possible; members without it, from other writers, are decoded to
be passed over.  Archives that are not compressed are read too.

Each task writes its own file, and the commit adds a list of the files that count, so that a
task that ran twice leaves no record twice.  A folder's records are those of all its lists;
mode "overwrite" removes the lists and files that were there before.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import dealt, scratch, ship, stored

SCHEMA = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"
HEADER_COLUMNS = ("page_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to")
#: Payloads of fewer bytes are never written as revisits.
LEAST_SHARED = 100
#: Compressed bytes that a reading partition takes together, and rows of an Arrow batch.
SPLIT_BYTES, BATCH_ROWS = 16 << 20, 256
#: Files of a folder that list the archives of one write, and bytes read at once.
MANIFEST, READ_BYTES = "_records-", 256 << 10
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


def record(page_id: int | None, kind: str, uri: str, size: int, digest: str, refers_to: int | None, payload: bytes) -> bytes:
    """One record as a gzip member with its lengths in the header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() if kind == "response" else b""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(uri.splitlines()),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    head = ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")
    plain = head + http + payload + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(plain) + z.flush()
    tail = struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(body) + len(tail)
    if total >> 32 or len(plain) >> 32:
        # The field's lengths have 32 bits: a larger member goes without it.
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, total, len(plain))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def parse_headers(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _number(text: str | None) -> int | None:
    digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def header_row(h: dict[str, str]) -> dict:
    return {
        "page_id": _number(h.get("warc-record-id")),
        "record_type": h.get("warc-type"),
        "target_uri": h.get("warc-target-uri"),
        "payload_bytes": _number(h.get("x-payload-length")),
        "payload_digest": (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
        "refers_to": _number(h.get("warc-refers-to")),
    }


class _Window:
    """A file read in large steps, of which records take what they need."""

    def __init__(self, f):
        self.f, self.size = f, f.size()
        self.start, self.held = 0, b""

    def at(self, place: int, n: int) -> bytes:
        """n bytes from place on, fewer at the end of the file."""
        if not self.start <= place <= place + n <= self.start + len(self.held) and place < self.size:
            self.f.seek(place)
            self.start, self.held = place, self.f.read(max(n, READ_BYTES))
        return self.held[place - self.start : place - self.start + n]

    def rest(self, place: int) -> bytes:
        """What is at hand from place on, at least a byte unless the file ends there."""
        self.at(place, 1)
        return self.held[place - self.start :]


class _Member:
    """The plain bytes of one record's part of a file: a gzip member, or the bytes themselves."""

    def __init__(self, window: _Window, at: int):
        self.window, self.start, self.place = window, at, at
        first = window.at(at, 24)
        self.z = zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None
        if self.z is None and first[:5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        self.length = None
        if self.z is not None and len(first) == 24 and first[3] & 4 and first[12:14] == b"sl":
            self.length = struct.unpack_from("<I", first, 16)[0]

    def more(self, most: int) -> bytes:
        """The next plain bytes, about as many as asked for; none at the member's end."""
        out = b""
        while not out and not (self.z is not None and self.z.eof):
            if self.z is None:
                out = self.window.rest(self.place)[:most]
                self.place += len(out)
                return out
            packed = self.z.unconsumed_tail
            if not packed:
                packed = self.window.rest(self.place)
                if not packed:
                    raise ValueError("the archive ends within a record")
                self.place += len(packed)
            out = self.z.decompress(packed, most)
        return out

    def end(self) -> int:
        """Where the next member starts, after all of this one has been read."""
        while self.more(1 << 20):
            pass
        return self.place - len(self.z.unused_data)

    def skipped(self) -> int:
        """Where the next member starts; by the stored length, if a member does start there."""
        if self.length:
            stop = self.start + self.length
            if stop == self.window.size or self.window.at(stop, 3) == b"\x1f\x8b\x08":
                return stop
        return self.end()


def read_records(f, wanted, payloads: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """Header values and payload (None without payloads) of the records that
    wanted(header values) accepts."""
    window, at = _Window(f), 0
    while at < window.size:
        member = _Member(window, at)
        parts, plain = [], b""
        while b"\r\n\r\n" not in plain:
            found = member.more(4 << 10)
            if not found:
                break
            plain += found
        head, _, rest = plain.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        length = _number(headers.get("content-length")) or 0
        row = header_row(headers)
        take = wanted(row)
        if take and payloads:
            parts, held = [rest], len(rest)
            while held < length:
                found = member.more(min(1 << 20, length - held) if member.z is None else 1 << 20)
                if not found:
                    raise ValueError("the archive ends within a record")
                parts.append(found)
                held += len(found)
            block = b"".join(parts)[:length]
            yield row, block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
        elif take:
            yield row, None
        if member.z is None:
            at += len(head) + 4 + length + 4  # two line ends close a record
        else:
            at = member.end() if take and payloads else member.skipped()


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    records: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema
        #: A header column and the values that it may have; without values any but null.
        self.filters: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if column in HEADER_COLUMNS:
                self.filters.append((column, None if isinstance(f, IsNotNull) else tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        files, root = _open(self.path)
        listed = {i.base_name: i for i in files.get_file_info(fs.FileSelector(root)) if i.is_file}
        lists = sorted(n for n in listed if n.startswith(MANIFEST))
        names = [n for x in lists for n in _listed(files, f"{root}/{x}")]
        if not lists:  # another writer's folder
            names = sorted(n for n in listed if n.endswith((".warc.gz", ".warc")))
        out: list[Files] = []
        held: list[str] = []
        size = 0
        for n in names:
            if held and size + listed[n].size > SPLIT_BYTES:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(n)
            size += listed[n].size
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(self.schema)
        files, root = _open(self.path)
        wanted = lambda row: all(row[c] is not None if values is None else row[c] in values for c, values in self.filters)
        payloads = "payload" in shape.names
        rows: list[dict] = []
        size = 0
        for name in partition.paths:
            with files.open_input_file(f"{root}/{name}") as f:
                for row, payload in read_records(f, wanted, payloads):
                    rows.append({c: row.get(c) for c in shape.names} | ({"payload": payload} if payloads else {}))
                    size += len(payload or b"")
                    if len(rows) >= BATCH_ROWS or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=shape)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=shape)


def _listed(files: fs.FileSystem, path: str) -> list[str]:
    with files.open_input_file(path) as f:
        return json.loads(f.read())


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        name, n, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                out.write(record(r["page_id"], r["record_type"], r["target_uri"] or "", r["payload_bytes"], r["payload_digest"], r["refers_to"], r["payload"] or b""))
                n += 1
        if out is not None:
            out.close()
        return Written(name if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        before = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.is_file and i.base_name.startswith(MANIFEST)) if self.overwrite else []
        with files.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(m.name for m in messages if m and m.name)).encode())
        for x in before:
            names = _listed(files, f"{root}/{x}")
            files.delete_file(f"{root}/{x}")
            for n in names:
                files.delete_file(f"{root}/{n}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; predicates are pushed down to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_rows(pages: DataFrame) -> DataFrame:
    """Records of pages (page_id, url, html), in the shape of SCHEMA.

    Of pages with equal payloads of at least LEAST_SHARED bytes those with the least
    page_id are responses, the others revisits of it, without payload.  A null html is an
    empty payload, a null url an empty one; null ids come last (responses only among
    themselves); repeated rows give repeated records.
    """
    rows = dealt(pages, "page_id", "url", "html").select("page_id", F.coalesce("url", F.lit("")).alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    # Which pages are revisits is found on sizes and digests; no payload is sorted by its digest.
    narrow = rows.where(F.col("payload_bytes") >= LEAST_SHARED).select(F.col("page_id").alias("again"), F.col("payload_digest").alias("same"))
    shared = narrow.groupBy("same").agg(F.min("again").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = narrow.join(shared, "same").where(F.col("least").isNotNull() & ~F.col("again").eqNullSafe(F.col("least"))).distinct()
    marks = stored(marks, "warc-revisits")
    rows = rows.join(marks, rows["page_id"].eqNullSafe(marks["again"]) & (rows["payload_digest"] == marks["same"]), "left")
    again = F.col("least").isNotNull()
    return rows.select(
        "page_id",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "payload_bytes",
        "payload_digest",
        F.when(again, F.col("least")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, mode: str = "append") -> None:
    """One archive file a task under path; mode append or overwrite."""
    register(pages.sparkSession)
    archive_rows(pages).write.format("warc").mode(mode).save(path)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records under path, in the shape of SCHEMA; without payloads no payload is decoded."""
    register(spark)
    shape = SCHEMA if payloads else SCHEMA.removesuffix(", payload binary")
    return spark.read.format("warc").schema(shape).load(path)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives in the shared folder, read them back, and digest what was read:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payloads, whose size and digest these are; of revisits the
    headers alone, which hold those of the full payload.  Either reading pushes its record
    type to the source.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path)
    whole = read_warc(spark, path).where("record_type = 'response'")
    whole = whole.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    again = read_warc(spark, path, payloads=False).where("record_type = 'revisit'")
    return whole.union(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


#: DuckDB SQL for archive_round_trip over the pages table.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS s FROM p),
l AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS least FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM least AND least IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM l
"""
