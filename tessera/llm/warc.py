"""Web archives packaged in ZIP files: written by tasks, and read by ranges, without extraction.

An archive holds stored members: archive/data.warc.gz, whose records are gzip members of their own,
and indexes/index.cdxj, a line per record with its offset and length. A reader takes the end of the
file, finds the central directory (by the ZIP64 records where sizes need them), reads the index
member, and then fetches only the bytes of the records of its own share.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, small_batches

#: Fixed values of the formats.
END, END64, LOCATOR64, ENTRY, LOCAL, EXTRA64, FULL32, FULL16 = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4", 1, 0xFFFFFFFF, 0xFFFF
STORED, DEFLATED = 0, 8
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "<urn:x-page:{}>"
#: Payloads under this size are never revisits.
LEAST_REVISIT = 1000
#: Bytes fetched by one read, of an output batch, of a share of an archive; bytes and records of an archive.
READ, BATCH, SHARE, ARCHIVE, RECORDS = 4 << 20, 4 << 20, 32 << 20, 256 << 20, 50_000
#: SQL and Arrow types of what read_records() gives.
FIELDS = {
    "archive": pa.string(), "member": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(),
    "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "fault": pa.string(), "payload": pa.binary(),
}


def store(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file://" + path[5:].removeprefix("//") if not path.startswith("file:///") else path
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


# Writing


def headers(fields: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One response, or a revisit that holds the response's header only, as a gzip member."""
    http = headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    own = RECORD.format("" if page_id is None else page_id)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("WARC-Profile", PROFILE if revisit else ""),
        ("WARC-Refers-To", RECORD.format(refers_to) if revisit else ""), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(headers(fields, "WARC/1.1") + block + b"\r\n\r\n") + packer.flush()


class Archive:
    """An archive that is being written to a file of its own."""

    def __init__(self, folder: str):
        system, at = store(folder)
        system.create_dir(at, recursive=True)
        self.path = posixpath.join(folder, f"{uuid.uuid4().hex}.wacz")
        self.out = system.open_output_stream(store(self.path)[1])
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, member: bytes, url: str | None, date: str) -> None:
        self.data.write(member)
        self.lines.append(f"{quote(url or '-', safe=':/?&=%')} {date} " + json.dumps({"offset": self.size, "length": len(member), "filename": DATA.rpartition("/")[2]}))
        self.size += len(member)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(self.lines)))
        self.zip.writestr(zipfile.ZipInfo(PACKAGE), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, size


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT, most_broadcast: int = 200_000, salts: int = 32) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to of each row; refers_to is null for responses.

    Of equal payloads of at least so many bytes the largest page_id is the response (all rows of that
    id). Only digests with several ids are joined: broadcast if they are few, otherwise by digest and salt.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    long = rows.where(F.col("payload_bytes") >= least)
    shared = long.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("payload_digest", "payload_bytes", "last")
    shared = durable(shared)
    keys = ["payload_digest", "payload_bytes"]
    if shared.count() <= most_broadcast:
        joined = rows.join(F.broadcast(shared), keys, "left")
    else:
        shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(shared, [*keys, "salt"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(path, bytes, records) of the archives that the tasks write into the folder; rows as with_revisits() gives them.

    Every attempt of a task writes files of its own, and only those of the attempt that ended well are
    in the result, which is checkpointed: readers go by it, and a lost executor leaves nothing half read.
    No rows, no archives. The folder must be one that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        at = None

        def done() -> pa.RecordBatch:
            path, size = at.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([len(at.lines)])], ["path", "bytes", "records"])

        for batch in batches:
            for cells in zip(*batch.columns):
                page_id, url, payload, size, sha1, refers_to = (c.as_py() for c in cells)
                at = at or Archive(folder)
                at.add(record(page_id, url, payload, size, sha1, refers_to, refers_to is not None, date), url, date)
                if at.size >= ARCHIVE or len(at.lines) >= RECORDS:
                    yield done()
                    at = None
        if at:
            yield done()

    with small_batches(rows.sparkSession, 256):
        return durable(rows.mapInArrow(run, "path string, bytes long, records long"))


# Reading


@dataclass
class Member:
    """A member of a ZIP file: how it is packed, and where its bytes are."""

    name: str
    method: int
    packed: int
    size: int
    header: int
    start: int = -1


def directory(read, length: int) -> list[Member]:
    """The members that the central directory names; read(offset, n) gives bytes of the file."""
    tail_at = max(0, length - (22 + FULL16 + 20))
    tail = read(tail_at, length - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    shift = 0
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64:
        (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        record = read(at, 56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end of a central directory")
        count, size, start = struct.unpack("<QQQ", record[32:56])
    else:
        shift = tail_at + end - size - start  # bytes before the archive, as in self-extracting files
    rows, at, members = read(start + shift, size), 0, []
    while at < len(rows) and rows[at : at + 4] == ENTRY:
        flags, method = struct.unpack("<HH", rows[at + 8 : at + 12])
        packed, full, named, extra, comment = struct.unpack("<IIHHH", rows[at + 20 : at + 34])
        (header,) = struct.unpack("<I", rows[at + 42 : at + 46])
        name = rows[at + 46 : at + 46 + named]
        more = rows[at + 46 + named : at + 46 + named + extra]
        while len(more) >= 4:
            kind, n = struct.unpack("<HH", more[:4])
            if kind == EXTRA64:  # only what does not fit in 32 bits, in this order
                wide = [v[0] for v in struct.iter_unpack("<Q", more[4 : 4 + n // 8 * 8])]
                full = wide.pop(0) if full == FULL32 else full
                packed = wide.pop(0) if packed == FULL32 else packed
                header = wide.pop(0) if header == FULL32 else header
            more = more[4 + n :]
        members.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, full, header + shift))
        at += 46 + named + extra + comment
    if len(members) != count:
        raise ValueError(f"{len(members)} of {count} members in the central directory")
    return members


def located(read, member: Member) -> Member:
    """The member with the offset of its bytes, which follow a header of its own."""
    head = read(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no header of member {member.name}")
    named, extra = struct.unpack("<HH", head[26:30])
    member.start = member.header + 30 + named + extra
    return member


def content(read, member: Member) -> bytes:
    """A small member, whole: an index."""
    raw = read(located(read, member).start, member.packed)
    raw = zlib.decompress(raw, -15) if member.method == DEFLATED else raw
    return zlib.decompress(raw, 31) if member.name.endswith(".gz") else raw


def indexed(lines: bytes) -> dict[str, list[tuple[int, int]]]:
    """Offsets and lengths of records by file name, from the lines of a CDXJ index."""
    found: dict[str, list[tuple[int, int]]] = {}
    for line in lines.split(b"\n"):
        brace = line.find(b"{")
        if brace >= 0:
            entry = json.loads(line[brace:])
            found.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
    return found


def streamed(read, member: Member) -> Iterator[tuple[int, bytes]]:
    """All records of a member without an index, by reading it in order."""
    inflate, at, compressed = zlib.decompressobj(-15) if member.method == DEFLATED else None, 0, member.name.endswith(".gz")
    pending, start, own, text = b"", 0, None, b""
    while at < member.packed or pending:
        if at < member.packed:
            raw = read(member.start + at, min(READ, member.packed - at))
            at += len(raw)
            pending += inflate.decompress(raw) if inflate else raw
        if not compressed:
            if at >= member.packed:
                yield from plain(pending)
                return
            continue
        while pending:
            own = own or zlib.decompressobj(31)
            text += own.decompress(pending)
            if not own.eof:
                pending = b""
                break
            used = len(pending) - len(own.unused_data)
            pending = own.unused_data
            yield start, text
            start, own, text = start + used, None, b""
    if own:
        yield start, text  # cut off


def plain(data: bytes) -> Iterator[tuple[int, bytes]]:
    """The records of an uncompressed file."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        body = data.find(b"\r\n\r\n", at) + 4
        if body < 4:
            yield at, data[at:]
            return
        size = int(fields(data[at:body]).get("content-length", 0))
        yield at, data[at : body + size]
        at = body + size


def fetched(read, start: int, entries: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """The records at these offsets of a member; neighbours come by one read."""
    i = 0
    while i < len(entries):
        j, first = i + 1, entries[i][0]
        while j < len(entries) and entries[j][0] <= entries[j - 1][0] + entries[j - 1][1] + 4096 and sum(entries[j]) - first <= READ:
            j += 1
        block = read(start + first, max(o + n for o, n in entries[i:j]) - first)
        for offset, n in entries[i:j]:
            raw = block[offset - first : offset - first + n]
            if raw[:2] == b"\x1f\x8b":
                inflate = zlib.decompressobj(31)
                try:
                    raw = inflate.decompress(raw)
                except zlib.error:
                    raw = b""
            yield offset, raw
        i = j


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def parsed(raw: bytes) -> dict:
    """A record: its fields, its payload (that of the HTTP message, if it is one) and what is wrong with it."""
    head, gap, block = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not gap:
        return {"fault": "form"}
    own = fields(head)
    size = int(own["content-length"]) if own.get("content-length", "").isdigit() else -1
    fault = "truncated" if len(block) < size or size < 0 else None
    block = block[: max(size, 0)]
    http, payload = {}, block
    if own.get("content-type", "").startswith("application/http"):
        first, _, payload = block.partition(b"\r\n\r\n")
        http = fields(first)
    kind, told = own.get("warc-type"), own.get("warc-payload-digest", "")
    sha1 = base64.b32decode(told[5:]).hex() if told.startswith("sha1:") and len(told) == 37 else None
    out = {"record_type": kind, "record_id": own.get("warc-record-id"), "target_uri": own.get("warc-target-uri"), "refers_to": own.get("warc-refers-to")}
    if kind == "revisit":  # the payload is the other record's: its size and digest are told here
        return out | {"payload_bytes": int(http["content-length"]) if http.get("content-length", "").isdigit() else None, "payload_digest": sha1, "payload": None, "fault": fault}
    found = hashlib.sha1(payload).hexdigest()
    return out | {"payload_bytes": len(payload), "payload_digest": found, "payload": payload, "fault": fault or ("digest" if sha1 and sha1 != found else None)}


def records(path: str, length: int, low: int, high: int) -> Iterator[dict]:
    """The records of an archive that start within a range of its bytes.

    Members without an index, or packed a second time, are read in order by the share in which they begin.
    """
    system, at = store(path)
    with system.open_input_file(at) as file:

        def read(offset: int, n: int) -> bytes:
            file.seek(offset)
            return file.read(n)

        members = directory(read, length)
        lists: dict[str, list[tuple[int, int]]] = {}
        for m in members:
            if m.name.startswith("indexes/") and m.name.rstrip(".gz").endswith((".cdxj", ".cdx")):
                for name, entries in indexed(content(read, m)).items():
                    lists.setdefault(name, []).extend(entries)
        for m in members:
            if not m.name.endswith((".warc", ".warc.gz")):
                continue
            located(read, m)
            entries = lists.get(m.name.rpartition("/")[2])
            if entries and m.method == STORED:
                found = fetched(read, m.start, sorted(e for e in entries if low <= m.start + e[0] < high))
            else:
                found = streamed(read, m) if low <= m.start < high else iter(())
            for offset, raw in found:
                yield {"archive": path, "member": m.name, "offset": offset} | parsed(raw)


def read_records(archives: DataFrame, payload: bool = True, share: int = SHARE) -> DataFrame:
    """The records of archives (path, bytes): see FIELDS; fault says what is wrong with a record (else null).

    Each share of about so many bytes of an archive is a row of its own, dealt to the tasks; a task holds the
    index of one archive and one block of records at a time. Empty archives and an empty table give no rows.
    """
    columns = {k: v for k, v in FIELDS.items() if payload or k != "payload"}
    shares = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("bytes") - 1), F.lit(share).cast("long"))).alias("low"))
    shares = shares.repartition(F.xxhash64("path", "low"))
    schema = pa.schema(list(columns.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, low in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                for r in records(path, length, low, low + share):
                    rows.append({k: r.get(k) for k in columns})
                    held += 200 + (len(r.get("payload") or b"") if payload else 0)
                    if held >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return shares.mapInArrow(run, ", ".join(f"{k} {kinds[v]}" for k, v in columns.items()))


def archives_in(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes) of the archives that a path or pattern names; their contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    durable(spark.range(1))  # sets a checkpoint folder where a local session has none
    return posixpath.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"archives-{uuid.uuid4().hex}")


def archive_pages(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row of pages (page_id, url, html), read back from archives of it.

    Null html is an empty payload, null urls and ids stay null, every row has its record; rows with a null id
    are revisits where an equal payload has one, rows that share the largest id are all responses. Control
    characters in urls are percent-encoded. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    written = write_archives(with_revisits(pages), shared_folder(spark))
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d*)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    found = read_records(written, payload=False)
    damaged = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(" ", "archive", "offset", "fault"))).otherwise(F.col("record_type"))
    return found.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", damaged.alias("record_type"), number(F.col("refers_to")).alias("refers_to"))
