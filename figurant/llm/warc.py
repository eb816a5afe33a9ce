"""Web archives: WARC records in ZIP packages, written and range-read by executors.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, whose records are
gzip members of their own, and ``indexes/index.cdxj``, a line per record with its place. A
reader takes the ZIP central directory from the end of the file, finds the stored members,
reads the index and then only the byte ranges of records; nothing is unpacked to disk.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figurant.llm.stages import arrow_map, scratch_dir, spread, stage

#: A package is closed at this many records or bytes, which bounds a reader's task.
MAX_RECORDS = 50_000
MAX_BYTES = 256 << 20
#: Adjacent records are fetched together up to this many bytes.
FETCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# --- ZIP ---------------------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    method: int
    stored: int  # bytes in the package
    size: int
    header: int  # offset of the local header


class Package:
    """The directory of a ZIP package behind a random-access file (``seek``, ``read``)."""

    def __init__(self, file, length: int):
        self.file, self.length = file, length
        self.members = {m.name: m for m in self._directory()}

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError("package ends early")
        return data

    def _directory(self) -> Iterator[Member]:
        tail_from = max(0, self.length - (22 + 0xFFFF))
        tail = self.at(tail_from, self.length - tail_from)
        at = len(tail)
        while True:  # a comment may hold the signature: the record must reach the file's end
            at = tail.rfind(b"PK\x05\x06", 0, at)
            if at < 0:
                raise ValueError("no end of central directory: not a ZIP package")
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        _, _, _, count, size, start, _ = struct.unpack_from("<4H2LH", tail, at + 4)
        end = tail_from + at
        if 0xFFFF == count or 0xFFFFFFFF in (size, start):
            where = self.at(end - 20, 20) if end >= 20 else b""
            if where[:4] == b"PK\x06\x07":
                record = self.at(struct.unpack_from("<Q", where, 8)[0], 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("ZIP64 end record is missing")
                count, size, start = struct.unpack_from("<3Q", record, 32)
        data, p = self.at(start, size), 0
        for _ in range(count):
            if data[p : p + 4] != b"PK\x01\x02":
                raise ValueError("central directory is damaged")
            method = struct.unpack_from("<H", data, p + 10)[0]
            flags = struct.unpack_from("<H", data, p + 8)[0]
            stored, full, n, m, k = struct.unpack_from("<2L3H", data, p + 20)
            header = struct.unpack_from("<L", data, p + 42)[0]
            name = data[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = data[p + 46 + n : p + 46 + n + m], 0
            while q + 4 <= len(extra):
                kind, length = struct.unpack_from("<2H", extra, q)
                if kind == 1:  # 64-bit values, only for the fields that are full, in this order
                    r = q + 4
                    for field in ("full", "stored", "header"):
                        if {"full": full, "stored": stored, "header": header}[field] == 0xFFFFFFFF:
                            value = struct.unpack_from("<Q", extra, r)[0]
                            r += 8
                            full, stored, header = (value if field == "full" else full), (value if field == "stored" else stored), (value if field == "header" else header)
                q += 4 + length
            yield Member(name, method, stored, full, header)
            p += 46 + n + m + k

    def data_start(self, m: Member) -> int:
        """Where a stored member's bytes begin: its local header has lengths of its own."""
        if m.method != zipfile.ZIP_STORED:
            raise ValueError(f"{m.name} is compressed; ranges need stored members")
        local = self.at(m.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{m.name}: no local header")
        n, k = struct.unpack_from("<2H", local, 26)
        return m.header + 30 + n + k

    def read(self, name: str) -> bytes:
        m = self.members[name]
        return self.at(self.data_start(m), m.size)


# --- WARC --------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, mark: str) -> bytes:
    """One WARC record, gzipped. A revisit keeps the HTTP head, so its length stays known."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = _uri(url)
    head["WARC-Payload-Digest"] = f"sha1:{mark}"
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, 6, mtime=0)


def parse(raw: bytes) -> dict:
    """The fields of one gzipped record; a response's payload must have the digest it states."""
    data = zlib.decompress(raw, 31)
    top, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = top.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    mark, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:N>
    if kind == "response" and digest(payload) != mark:
        raise ValueError(f"payload of {head['warc-record-id']} doesn't match its digest")
    return {"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": int(fields["content-length"]), "payload_digest": mark, "record_type": kind, "refers_to": number(head.get("warc-refers-to"))}


class PackageWriter:
    """Streams records into one package; only the index is held in memory."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.index, self.bytes = io.StringIO(), 0
        self.count = 0

    def add(self, raw: bytes, page_id: int | None) -> None:
        self.index.write(json.dumps({"page": page_id, "offset": self.bytes, "length": len(raw)}) + "\n")
        self.data.write(raw)
        self.bytes += len(raw)
        self.count += 1

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, self.index.getvalue())
        self.zip.close()


def read_package(file, length: int) -> Iterator[bytes]:
    """The records of a package (gzipped), fetched by the index's ranges."""
    package = Package(file, length)
    start, room = package.data_start(package.members[ARCHIVE]), package.members[ARCHIVE].size
    places = sorted((x["offset"], x["length"]) for x in map(json.loads, package.read(INDEX).splitlines()))
    i = 0
    while i < len(places):
        j, low = i, places[i][0]
        while j < len(places) and (j == i or places[j][0] + places[j][1] - low <= FETCH_BYTES):
            j += 1
        high = places[j - 1][0] + places[j - 1][1]
        if high > room:
            raise ValueError("index points beyond the archive")
        got = package.at(start + low, high - low)
        for o, n in places[i:j]:
            yield got[o - low : o - low + n]
        i = j


# --- Spark -------------------------------------------------------------------------------


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to. Of pages with equal payloads of at least
    ``min_bytes`` bytes the one with the largest page_id is kept whole, and the others refer to
    it; rows that repeat that page_id are kept whole too. Null html counts as empty; a null
    page_id is never referred to.

    The winners are one aggregate over (SHA-256, length) with partial sums in each task; the
    join back leaves the page side splittable when one payload holds much of the table.
    """
    whole = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    whole = whole.withColumn("mark", F.unhex(F.sha2("payload", 256))).withColumn("n", F.octet_length("payload"))
    best = whole.where(F.col("n") >= min_bytes).groupBy("mark").agg(F.max("page_id").alias("best"))
    refers = F.when((F.col("n") >= min_bytes) & (~F.col("page_id").eqNullSafe(F.col("best"))), F.col("best"))
    return whole.join(best, "mark", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Write packages below ``folder`` (a URI that executors share) and return their manifest:
    path, bytes, records. Files have names of their own for each attempt, and only those of
    attempts that succeeded are in the manifest, so a lost executor leaves nothing half read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        writer = stream = name = None

        def close() -> None:
            nonlocal writer
            if writer:
                writer.close()
                n = stream.tell()
                stream.close()
                done.append((name, n, writer.count))
                writer = None

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                page, url, payload, refers = (x.as_py() for x in row)
                if writer is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = store.open_output_stream(f"{root}/{name}")
                    writer = PackageWriter(stream)
                writer.add(record(page, url, payload, refers, digest(payload)), page)
                if writer.count >= MAX_RECORDS or writer.bytes >= MAX_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return stage(arrow_map(decided, run, "path string, bytes long, records long"))


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload (null for revisits, or everywhere if not ``payloads``),
    payload_bytes, payload_digest, record_type, refers_to: a row per record."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        pack = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))
        for batch in batches:
            for name, length in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                rows, held = [], 0
                with store.open_input_file(f"{root}/{name}") as file:
                    for raw in read_package(file, length):
                        rows.append(parse(raw))
                        if not payloads:
                            rows[-1]["payload"] = None
                        held += len(rows[-1]["payload"] or b"") + 200
                        if held > FETCH_BYTES:
                            yield pack(rows)
                            rows, held = [], 0
                yield pack(rows)

    return arrow_map(spread(manifest), run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write all ``pages`` as packages and read every record back by range; see ``decide`` for
    which records become revisits and ``read`` for the columns. An empty table gives no rows;
    repeated rows give a record each; other columns of ``pages`` are left out."""
    folder = folder or f"{scratch_dir(spark)}/packages-{uuid.uuid4().hex}"
    return read(write(decide(pages, min_bytes), folder), folder, payloads=False).drop("payload", "url")
