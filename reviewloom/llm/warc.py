"""Web archives in ZIP packages: written by tasks, and read back by their directories, without extraction.

A package holds three stored members: ``archive/data.warc.gz`` (a gzip member per WARC record), ``indexes/index.cdxj``
(the place of every record) and ``datapackage.json``.  The reader takes the end of the file, the ZIP64 locator and
directory where there are any, the central directory, the index, and then byte ranges of records.

Of records with equal payloads of at least ``min_bytes`` the one of the smallest id is a response, the others are
revisits that refer to it and hold no payload.  Packages lie in the session's shared folder (``spark.checkpoint.dir``),
which tasks reach by its address; a task writes under a name of its own attempt and then renames, so that repeated
attempts leave one package.

Odd input: null html is an empty payload; a null url is an empty target; rows with a null id are never referred to
(equal ones refer to the smallest id there is); rows repeated under the smallest id are all responses; an empty table
gives no packages and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, written
from .words import small_batches

PACKAGE_BYTES = 32 << 20
RANGE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, refers_to) -> tuple[bytes, str]:
    """One gzip member with a response or revisit record, and the payload's digest."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe='!#$%&()*+,/:;=?@[]~')}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush(), digest


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return fields, rest[:int(fields["Content-Length"])]


def zip_parts(members: list[tuple[str, bytes]], zip64: bool = False) -> Iterator[bytes]:
    """The bytes of a ZIP file of stored members, one after the other and without copies of the members' bytes; ``zip64``
    writes the large form whatever the sizes."""
    place, directory = 0, bytearray()
    for name, data in members:
        crc, raw = zlib.crc32(data), name.encode()
        large = zip64 or len(data) >= _FULL32 or place >= _FULL32
        size = _FULL32 if large else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if large else b""
        head = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if large else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra
        yield head
        yield data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), place) if large else b""
        directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if large else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _FULL32 if large else place) + raw + extra
        place += len(head) + len(data)
    start, n = place, len(members)
    yield bytes(directory)
    if zip64 or start >= _FULL32 or n >= _FULL16:
        yield struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(directory), start)
        yield struct.pack("<4sIQI", b"PK\6\7", 0, start + len(directory), 1)
        yield struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 0)
    else:
        yield struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, len(directory), start, 0)


def zip_package(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """The same in one piece."""
    return b"".join(zip_parts(members, zip64))


class Package:
    """Members of a ZIP file behind anything that reads byte ranges: ``read(start, size)``."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 22 - _FULL16)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of a central directory")
        n, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
        if end >= 20 and tail[end - 20:end - 16] == b"PK\6\7":
            place, = struct.unpack("<Q", tail[end - 12:end - 4])
            n, length, start = struct.unpack("<QQQ", read(place + 32, 24))
        directory, at, self.members = read(start, length), 0, {}
        for _ in range(n):
            if directory[at:at + 4] != b"PK\1\2":
                raise ValueError("not a central directory entry")
            method, = struct.unpack("<H", directory[at + 10:at + 12])
            packed, size_, name, extra, comment = struct.unpack("<IIHHH", directory[at + 20:at + 34])
            place, = struct.unpack("<I", directory[at + 42:at + 46])
            label = directory[at + 46:at + 46 + name].decode()
            field, stop = at + 46 + name, at + 46 + name + extra
            while field + 4 <= stop:
                kind, long = struct.unpack("<HH", directory[field:field + 4])
                if kind == 1:  # 64-bit values of the fields that are full, in this order
                    values = iter(struct.unpack(f"<{long // 8}Q", directory[field + 4:field + 4 + long // 8 * 8]))
                    size_ = next(values) if size_ == _FULL32 else size_
                    packed = next(values) if packed == _FULL32 else packed
                    place = next(values) if place == _FULL32 else place
                field += 4 + long
            self.members[label] = (place, packed, method)
            at = stop + comment

    def place(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member lie."""
        at, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        name_size, extra = struct.unpack("<HH", self.read(at + 26, 4))
        return at + 30 + name_size + extra, size

    def records(self):
        """(header fields, block) of every record of the index, read in ranges of neighbouring records."""
        index_at, size = self.place("indexes/index.cdxj")
        data_at, _ = self.place("archive/data.warc.gz")
        entries = sorted((int(e["offset"]), int(e["length"])) for e in (json.loads(line.split(" ", 2)[2]) for line in self.read(index_at, size).decode().splitlines()))
        group: list[tuple[int, int]] = []
        for entry in [*entries, (None, 0)]:
            if group and (entry[0] is None or entry[0] != sum(group[-1]) or entry[0] + entry[1] - group[0][0] > RANGE_BYTES):
                data = self.read(data_at + group[0][0], sum(group[-1]) - group[0][0])
                for offset, length in group:
                    yield read_record(data[offset - group[0][0]:offset - group[0][0] + length])
                group = []
            group.append(entry)


def decided(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """id, url, payload and, for revisits, the id of the response."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("same", F.sha2("payload", 256))
    several = rows.where(F.octet_length("payload") >= min_bytes).groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    return rows.join(several, "same", "left").select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write all pages to packages below ``folder`` and return (path, records, bytes) of each package."""
    def run(batches):
        system, base = reached(folder)
        task = TaskContext.get()
        data, lines, done = bytearray(), [], 0

        def close():
            nonlocal data, lines, done
            name = f"pages-{task.partitionId():06d}-{done:06d}.wacz"
            members = [
                ("archive/data.warc.gz", data), ("indexes/index.cdxj", "".join(sorted(lines)).encode()),
                ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": "archive/data.warc.gz", "bytes": len(data)}]}).encode()),
            ]
            system.create_dir(base, recursive=True)
            own = f"{base}/.{name}-{task.taskAttemptId()}"
            with system.open_output_stream(own) as out:
                for part in zip_parts(members, zip64):
                    out.write(part)
                size = out.tell()
            system.move(own, f"{base}/{name}")
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(lines)], "bytes": [size]})
            data, lines, done = bytearray(), [], done + 1
            return row

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, refers_to = (c[i].as_py() for c in b.columns)
                record, digest = record_bytes(page_id, url, payload, refers_to)
                if data and len(data) + len(record) > package_bytes:
                    yield close()
                lines.append(f"{quote(url or '-', safe='/:')} 20240101000000 {json.dumps({'offset': len(data), 'length': len(record), 'digest': digest})}\n")
                data += record
        if lines:
            yield close()

    return decided(pages, id_col, url_col, html_col, min_bytes).mapInArrow(run, "path string, records long, bytes long")


def reached(address: str):
    """The file system of an address and the path in it."""
    return files.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (files.LocalFileSystem(), address)


def read_archives(packages: DataFrame, path_col: str = "path") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record; ids are texts.

    The payload of a response is held against its digest.  A revisit has the digest and size of the full payload.
    """
    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                system, place = reached(path)
                with system.open_input_file(place) as file:
                    package = Package(lambda at, n: file.read_at(n, at), file.size())
                    held, size = [], 0
                    for fields, block in package.records():
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        kind = fields["WARC-Type"]
                        if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
                            raise ValueError(f"damaged record in {path}")
                        ids = [fields.get(k, "")[len("<urn:page:"):-1] or None for k in ("WARC-Record-ID", "WARC-Refers-To")]
                        held.append((ids[0], fields["WARC-Target-URI"], length, digest, kind, ids[1], payload if kind == "response" else None))
                        size += len(payload)
                        if size > RANGE_BYTES:
                            yield _rows(held)
                            held, size = [], 0
                    yield _rows(held)

    paths = packages.select(path_col)
    # a stated number of partitions is not coalesced: a package, some 32 MB, is a task
    return paths.repartitionByRange(max(1, paths.count()), path_col).mapInArrow(
        run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*held) if held else [[]] * 7, kinds)], names=names)


def archived(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read every record back; ids have their type again."""
    kind = pages.schema[id_col].dataType
    with small_batches(pages.sparkSession, "4m"):
        packages = written(write_archives(pages, shared_dir(pages.sparkSession, "packages"), id_col=id_col, **options), "packages-list")
    return read_archives(packages).withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).withColumnRenamed("page_id", id_col)
