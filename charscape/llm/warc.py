"""WARC archives inside ZIP packages: writing, and range-reading without extraction.

A package holds stored (uncompressed) members: `archive/data.warc.gz`, WARC records that are gzip
members of their own, and `indexes/index.cdxj`, one JSON line per record with its offset and length in
the archive. Reading works from the package's end: the end record, the ZIP64 end record where sizes or
counts need it, and the central directory give each member's place; the local header gives the start of
its data. The index then names byte ranges, which are read with one seek each; neighbouring records
share a range up to `range_bytes`.

Writing: payloads are hashed by Spark, equal ones of at least `min_revisit` bytes are resolved to the
record with the smallest id by a grouping of digests alone, and only then payloads move, evenly by id.
Each task buffers one package (`package_bytes`) and writes it under a name of its own; the returned
manifest lists the packages that count, so the leftovers of a failed attempt are never read.

Defined cases: a NULL payload is an empty one; a NULL id is last among equal payloads; rows with the
smallest id of their payload, also repeated ones, are all responses; NULL and odd addresses are left
out or percent-encoded; an empty table gives no package. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charscape.llm.common import materialise, small_batches
from charscape.sources.workspace import new_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1980-01-01T00:00:00Z"
# Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = (
    b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Layout:
    package_bytes: int = 64 << 20
    range_bytes: int = 4 << 20
    min_revisit: int = 100
    zip64: bool = False  # write ZIP64 records also where they are not needed


# --- ZIP -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    crc: int
    header: int  # place of the local header


def write_zip(out, members: list[tuple[str, bytes]], force64: bool = False) -> None:
    """Stored members, central directory and end records, in one pass."""
    directory, at = io.BytesIO(), 0
    for name, data in members:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        wide = force64 or size >= FULL32 or at >= FULL32
        shown = FULL32 if wide else size
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        head = struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if wide else 20, 0x800, 0, 0, 33, crc, shown,
                           shown, len(raw), len(extra)) + raw + extra
        out.write(head)
        out.write(data)
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        directory.write(struct.pack(
            "<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, shown, shown,
            len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else at) + raw + extra)
        at += len(head) + size
    listed, n = directory.getvalue(), len(members)
    out.write(listed)
    wide = force64 or at + len(listed) >= FULL32 or n >= FULL16
    if wide:
        out.write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, len(listed), at))
        out.write(struct.pack("<4sIQI", LOCATOR64, 0, at + len(listed), 1))
    out.write(struct.pack("<4sHHHHIIH", END, 0, 0, FULL16 if wide else n, FULL16 if wide else n,
                          FULL32 if wide else len(listed), FULL32 if wide else at, 0))


def _read(source, at: int, size: int) -> bytes:
    source.seek(at)
    data = source.read(size)
    if len(data) != size:
        raise ValueError(f"package ends before byte {at + size}")
    return data


def read_directory(source, total: int) -> list[Member]:
    """The members of a package, from its end records and central directory."""
    tail_at = max(0, total - 22 - FULL16)
    tail = _read(source, tail_at, total - tail_at)
    found = tail.rfind(END)
    while found >= 0:  # the signature may also occur inside a comment
        if found + 22 <= len(tail) and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
            break
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("not a ZIP package: no end record")
    count, size, at = struct.unpack_from("<HII", tail, found + 10)
    end_at = tail_at + found
    if (count == FULL16 or size == FULL32 or at == FULL32) and end_at >= 20:
        locator = _read(source, end_at - 20, 20)
        if locator[:4] == LOCATOR64:
            end64 = _read(source, struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("broken ZIP64 end record")
            count, size, at = struct.unpack_from("<QQQ", end64, 32)
    listed, place, members = _read(source, at, size), 0, []
    for _ in range(count):
        if listed[place:place + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", listed, place + 10)
        crc, packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", listed, place + 16)
        header, = struct.unpack_from("<I", listed, place + 42)
        name = listed[place + 46:place + 46 + n_name].decode("utf-8", "replace")
        extra = listed[place + 46 + n_name:place + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # the fields that do not fit, in this order
                field = 4
                if plain == FULL32:
                    plain, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                if packed == FULL32:
                    packed, field = struct.unpack_from("<Q", extra, field)[0], field + 8
                if header == FULL32:
                    header = struct.unpack_from("<Q", extra, field)[0]
            extra = extra[4 + length:]
        members.append(Member(name, method, packed, crc, header))
        place += 46 + n_name + n_extra + n_comment
    return members


def data_start(source, member: Member) -> int:
    """Place of a stored member's first byte."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be range-read")
    head = _read(source, member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


# --- WARC ------------------------------------------------------------------------------------------


def _address(url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else ""


def record(row: dict) -> bytes:
    """One WARC record. A revisit has the headers of the response it stands for, but no payload."""
    payload = (row["payload"] or "").encode("utf-8", "surrogatepass")
    revisit = row["is_revisit"]
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:record:{row['id']}>", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
    ]
    if url := _address(row["url"]):
        lines.append(f"WARC-Target-URI: {url}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:record:{row['first']}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return {"headers": headers, "payload": payload, "http_length": int(lengths[0]) if lengths else None}


def _number(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:record:").removesuffix(">")
    return None if text in ("", "None") else int(text)


# --- Spark -----------------------------------------------------------------------------------------


def resolved(pages: DataFrame, id_col: str, url_col: str, payload_col: str,
             layout: Layout = Layout()) -> DataFrame:
    """id, url, payload, digest, is_revisit, first: which records stand for others."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= layout.min_revisit).select("digest", "id")
    firsts = long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Digests and ids alone meet by digest; payloads only by their own id.
    revisits = (
        long.join(firsts.select("digest", "first"), "digest")
        .where(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
        .select(F.col("digest").alias("r_digest"), F.col("id").alias("r_id"), "first").distinct()
    )
    same = (rows["digest"] == revisits["r_digest"]) & rows["id"].eqNullSafe(revisits["r_id"])
    return rows.join(revisits, same, "left").select(
        "id", "url", "payload", "digest", F.col("first").isNotNull().alias("is_revisit"), "first")


def write_packages(records: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:
    """Write packages below a folder; the manifest: path, size, n_records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        archive, index, n = io.BytesIO(), [], 0

        def close() -> pa.RecordBatch:
            nonlocal archive, index, n
            name = f"{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                write_zip(out, [(ARCHIVE, archive.getvalue()), (INDEX, "".join(index).encode())],
                          layout.zip64)
            size = system.get_file_info(f"{base}/{name}").size
            done = pa.RecordBatch.from_pydict({
                "path": [f"{folder}/{name}"], "size": pa.array([size], pa.int64()),
                "n_records": pa.array([n], pa.int64())})
            archive, index, n = io.BytesIO(), [], 0
            return done

        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch[c][at].as_py() for c in ("id", "url", "payload", "digest",
                                                         "is_revisit", "first")}
                data = gzip.compress(record(row), 1, mtime=0)
                index.append(json.dumps({"offset": archive.tell(), "length": len(data)}) + "\n")
                archive.write(data)
                n += 1
                if archive.tell() >= layout.package_bytes:
                    yield close()
        if n:
            yield close()

    return materialise(small_batches(records).mapInArrow(write, "path string, size long, n_records long"),
                       "warc-manifest")


def locate(manifest: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """path, start, lengths: byte ranges of neighbouring records, from directories and indexes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, total in zip(batch["path"].to_pylist(), batch["size"].to_pylist(), strict=True):
                system, name = pyarrow.fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as source:
                    members = {m.name: m for m in read_directory(source, total)}
                    base = data_start(source, members[ARCHIVE])
                    listed = members[INDEX]
                    lines = _read(source, data_start(source, listed), listed.size)
                if zlib.crc32(lines) != listed.crc:
                    raise ValueError(f"{path}: the index is damaged")
                starts, lengths, filled = [], [], layout.range_bytes
                for line in lines.splitlines():
                    entry = json.loads(line)
                    at, length = base + entry["offset"], entry["length"]
                    if filled + length > layout.range_bytes or at != starts[-1] + sum(lengths[-1]):
                        starts.append(at)
                        lengths.append([])
                        filled = 0
                    lengths[-1].append(length)
                    filled += length
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(starts), "start": pa.array(starts, pa.int64()),
                    "lengths": pa.array(lengths, pa.list_(pa.int64()))})

    return manifest.mapInArrow(look, "path string, start long, lengths array<long>")


READ = ("id long, url string, record_type string, refers_to long, digest string, payload_bytes long, "
        "payload binary")


def read_ranges(ranges: DataFrame) -> DataFrame:
    """The records in byte ranges. A revisit's digest and length are those it states; its payload is
    NULL. A response's payload is checked against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = pyarrow.fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(name) as source:
                    data = _read(source, row["start"], sum(row["lengths"]))
                at, out = 0, []
                for length in row["lengths"]:
                    found = parse_record(gzip.decompress(data[at:at + length]))
                    at += length
                    headers, payload = found["headers"], found["payload"]
                    kind = headers["warc-type"]
                    stated = headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != stated:
                        raise ValueError(f"{headers['warc-record-id']}: payload and digest differ")
                    out.append({
                        "id": _number(headers["warc-record-id"]), "url": headers.get("warc-target-uri"),
                        "record_type": kind, "refers_to": _number(headers.get("warc-refers-to")),
                        "digest": stated,
                        "payload_bytes": len(payload) if kind == "response" else found["http_length"],
                        "payload": payload if kind == "response" else None})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                        ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload", pa.binary())]))

    return ranges.mapInArrow(read, READ)


def round_trip(spark: SparkSession, pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Write all pages into packages in the shared folder and read every record back."""
    records = resolved(pages, "page_id", "url", "html", layout)
    manifest = write_packages(records, new_path(spark, "warc"), layout)
    ranges = materialise(locate(manifest.repartition("path"), layout), "warc-ranges")
    return read_ranges(ranges.repartition("path", "start"))
