"""WARC archives in ZIP packages: writer, ZIP reader and range reads without extraction.

``write_archives`` packs pages into ZIP files of bounded size.  Each holds ``archive/data.warc.gz`` (one gzip
member per WARC record) and ``indexes/index.cdx`` (a line per record), both *stored*, so a record can
be read with one range request.  Equal payloads (at least ``MIN_REVISIT`` bytes) are stored once: the record of
the smallest page_id is a response, the others are revisits that refer to it.

``read_archives`` opens each package through its end-of-central-directory record, its ZIP64 records where
there are any, and its central directory; it locates the stored members by their local headers and
range-reads the index and the records.

Files lie below ``spark.checkpoint.dir`` and are reached through pyarrow's file systems, so any store that
Spark's cluster shares (file, hdfs, s3, gs) will do.  A repeated task writes the same name under a new attempt and
moves it into place.  Null and empty pages have an empty payload; page_ids should be unique (repeated rows
give repeated records); other columns are ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_schema, chunks, save, scratch_path, settle

MIN_REVISIT = 0
#: Bytes of WARC data after which a package is closed.
ARCHIVE_BYTES = 32 << 20
GZIP_LEVEL = 3
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx"
_EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: Signatures of the ZIP format's records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int, url: str, payload: bytes, name: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the payload's digest but not the payload."""
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": _EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": "".join(url.split()),
        "WARC-Payload-Digest": f"sha1:{name}",
        "Content-Type": "application/http; msgtype=response",
    }
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    else:
        body += payload
    head["Content-Length"] = str(len(body))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the payload's length as the HTTP header tells it, and the payload (empty for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, length, payload


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class ZipWriter:
    """Stored members one after another, with running CRCs; ZIP64 fields where a size or offset needs them."""

    def __init__(self, sink, zip64: bool = False) -> None:
        self.sink, self.zip64, self.at, self.entries = sink, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> int:
        """Write a stored member; returns the offset of its data in the package."""
        crc, size = 0, 0
        for part in parts:
            crc, size = zlib.crc32(part, crc), size + len(part)
        wide, start, encoded = self.zip64 or size >= 0xFFFFFFFF, self.at, name.encode()
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = 0xFFFFFFFF if wide else size
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if wide else 20, 0, 0, 0, 33, crc, short, short, len(encoded), len(extra)))
        self._put(encoded + extra)
        data_at = self.at
        for part in parts:
            self._put(part)
        self.entries.append((encoded, crc, size, start))
        return data_at

    def close(self) -> None:
        start = self.at
        for name, crc, size, offset in self.entries:
            wide = self.zip64 or size >= 0xFFFFFFFF or offset >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            short, place = (0xFFFFFFFF, 0xFFFFFFFF) if wide else (size, offset)
            self._put(
                struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0, 0, 0, 33, crc, short, short, len(name), len(extra), 0, 0, 0, 0, place)
                + name
                + extra
            )
        size, count = self.at - start, len(self.entries)
        if self.zip64 or self.at >= 0xFFFFFFFF or count >= 0xFFFF:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, count, count, size, start, 0))


class ZipReader:
    """Finds the stored members of a package by its central directory; reads ranges only."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        tail_at = max(0, size - 65_557)
        tail = self.range(tail_at, size - tail_at)
        at = tail.rfind(struct.pack("<I", END))
        if at < 0:
            raise ValueError("not a ZIP package")
        *_, count, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            signature, _, end, _ = struct.unpack("<IIQI", self.range(tail_at + at - 20, 20))
            if signature != LOCATOR64:
                raise ValueError("the ZIP64 locator is missing")
            fields = struct.unpack("<IQHHIIQQQQ", self.range(end, 56))
            count, length, start = fields[7:]
        directory, at = self.range(start, length), 0
        #: name: (offset of the local header, size, crc)
        self.members: dict[str, tuple[int, int, int]] = {}
        for _ in range(count):
            fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
            if fields[0] != CENTRAL:
                raise ValueError("the central directory is damaged")
            method, crc, packed, size, name_size, extra_size, comment_size, offset = fields[4], *fields[7:13], fields[16]
            name = directory[at + 46 : at + 46 + name_size].decode()
            extra = directory[at + 46 + name_size : at + 46 + name_size + extra_size]
            place = 0
            while place + 4 <= len(extra):
                tag, width = struct.unpack_from("<HH", extra, place)
                if tag == 1:
                    values = iter(struct.unpack_from(f"<{width // 8}Q", extra, place + 4))
                    size = next(values) if size == 0xFFFFFFFF else size
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    offset = next(values) if offset == 0xFFFFFFFF else offset
                place += 4 + width
            if method == 0:
                self.members[name] = (offset, size, crc)
            at += 46 + name_size + extra_size + comment_size

    def range(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's data, from its local header."""
        offset, size, _ = self.members[name]
        fields = struct.unpack("<IHHHHHIIIHH", self.range(offset, 30))
        return offset + 30 + fields[9] + fields[10], size


def package(rows: list[tuple[int, str, bytes, str, str, int | None]], zip64: bool = False) -> bytes:
    """A ZIP package of (page_id, url, payload, digest, kind, refers_to) rows."""
    parts, index, at = [], [], 0
    for page_id, url, payload, name, kind, refers_to in rows:
        part = gzip_member(record(kind, page_id, url, payload, name, refers_to))
        index.append(json.dumps({"page_id": page_id, "offset": at, "length": len(part), "digest": name, "mime": "warc/revisit" if kind == "revisit" else "text/html"}))
        parts.append(part)
        at += len(part)
    out = io.BytesIO()
    writer = ZipWriter(out, zip64)
    writer.add(WARC_MEMBER, parts)
    writer.add(INDEX_MEMBER, ["\n".join(index).encode()])
    writer.close()
    return out.getvalue()


def records(reader: ZipReader, window: int = 4 << 20) -> Iterator[bytes]:
    """Each record's bytes, by range reads that the index gives; neighbours share a read up to ``window`` bytes."""
    at, size = reader.locate(INDEX_MEMBER)
    lines = [json.loads(x) for x in reader.range(at, size).split(b"\n") if x]
    start, _ = reader.locate(WARC_MEMBER)
    k = 0
    while k < len(lines):
        stop, first = k, lines[k]["offset"]
        while stop < len(lines) and (stop == k or lines[stop]["offset"] + lines[stop]["length"] - first <= window):
            stop += 1
        block = reader.range(start + first, lines[stop - 1]["offset"] + lines[stop - 1]["length"] - first)
        for line in lines[k:stop]:
            yield zlib.decompress(block[line["offset"] - first : line["offset"] - first + line["length"]], 31)
        k = stop


_FILES, _FILES_ARROW = arrow_schema("archive string, n_records long")
_READ, _READ_ARROW = arrow_schema("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string")


def plan(pages: DataFrame) -> DataFrame:
    """The pages with payload_digest, record_type and refers_to: the smallest page_id of equal payloads responds.

    Only groups of two or more are joined back.  They are few and one row each, and are written first, so both
    sides of the join are plain exchanges and a payload that a third of the pages share is split among tasks.
    """
    spark = settle(pages.sparkSession)
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("key", F.sha2(F.encode("html", "UTF-8"), 256))
    groups = (
        keyed.where(F.octet_length("html") >= MIN_REVISIT)
        .groupBy("key")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    groups = save(groups, "warc-groups")
    with_first = keyed.join(groups, "key", "left")
    other = F.col("first_id").isNotNull() & (F.col("first_id") < F.col("page_id"))
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return with_first.select("page_id", "url", "html", F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, zip64: bool = False) -> DataFrame:
    """Write the packages; returns one row per package: its address and the number of its records."""
    folder = scratch_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def close() -> pa.RecordBatch:
            store, path = open_store(folder)
            store.create_dir(path, recursive=True)
            data = package(waiting, zip64)
            name = f"{path}/{hashlib.sha1(data).hexdigest()}-{len(waiting)}-{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(name + ".part") as out:
                out.write(data)
            store.move(name + ".part", name)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([len(waiting)], pa.int64())], schema=_FILES_ARROW)

        for batch in chunks(batches, "html"):
            pages_ = batch.column("html").cast(pa.binary()).to_pylist()
            for page_id, url, refers_to, payload in zip(
                batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("refers_to").to_pylist(), pages_, strict=True
            ):
                waiting.append((page_id, url, payload, digest(payload), "response" if refers_to is None else "revisit", refers_to))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    waiting.clear()
                    size = 0
        if waiting:
            yield close()

    # Written at once, so that the list names the packages of the attempts that succeeded.
    return save(plan(pages).select("page_id", "url", "html", "refers_to").mapInArrow(run, _FILES), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the packages: lengths and digests of payloads, checked where the record has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                store, path = open_store(uri)
                rows = []
                with store.open_input_file(path) as source:
                    for data in records(ZipReader(source, source.size())):
                        headers, length, payload = parse_record(data)
                        name, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        if kind == "response" and (digest(payload) != name or len(payload) != length):
                            raise ValueError(f"a payload of {uri} is damaged")
                        target = headers.get("WARC-Refers-To")
                        rows.append((_number(headers["WARC-Record-ID"]), length, name, kind, _number(target) if target else None, uri))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ_ARROW, strict=True)], schema=_READ_ARROW)

    spark = archives.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(tasks).mapInArrow(run, _READ)


def _number(urn: str) -> int:
    return int(urn.strip("<>").rpartition(":")[2])
