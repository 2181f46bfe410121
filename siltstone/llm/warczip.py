"""WARC archives in ZIP packages: writer, directory parser and range reader.

A package is a ZIP file whose members are *stored*: ``archive/data-NNNNN.warc.gz`` (each record its own gzip
member) and ``indexes/data-NNNNN.cdx`` (one JSON line a record with offset and length). A reader finds the end
record, follows ZIP64 records where they are used, reads the central directory and the index members, and then
asks for byte ranges of records; nothing is extracted.

Packages lie in a folder that driver and executors share, named by a URI; files are opened with pyarrow's file
systems (local, HDFS, S3, GCS). A task writes under a name of its own attempt and reports it, so a repeated or
speculative attempt leaves at most an unused file. Memory: one WARC member (``member_bytes``) while writing, one
range of at most ``RANGE_BYTES`` (or one record) while reading.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, shared_out, shuffle_partitions
from siltstone.scratch import cut

MEMBER_BYTES = 8 << 20
SAME_ROWS = 100_000  # digests that several pages have: up to so many are broadcast
RANGE_BYTES = 4 << 20
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the ZIP format (APPNOTE 6.3): signatures, field layouts and the value that refers to a ZIP64 field.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
LOCAL_FIELDS, CENTRAL_FIELDS, END_FIELDS = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH")
END64_FIELDS, LOCATOR64_FIELDS = struct.Struct("<IQHHIIQQQQ"), struct.Struct("<IIQI")
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class ZipWriter:
    """Sequential writer of stored members to a stream; ``zip64`` forces the wide records at any size."""

    def __init__(self, stream, zip64: bool = False):
        self.stream, self.zip64, self.at, self.entries = stream, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def member(self, name: str, data: bytes) -> int:
        """Append a member; the offset of its first byte of data."""
        wide = self.zip64 or len(data) >= MAX32
        crc, raw, size = zlib.crc32(data), name.encode(), MAX32 if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        self.entries.append((raw, crc, len(data), self.at))
        self._put(LOCAL_FIELDS.pack(LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        start = self.at
        self._put(data)
        return start

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.entries:
            wide = self.zip64 or size >= MAX32 or offset >= MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            size, offset = (MAX32, MAX32) if wide else (size, offset)
            self._put(CENTRAL_FIELDS.pack(CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, offset) + raw + extra)
        length, count, end = self.at - start, len(self.entries), self.at
        if self.zip64 or count >= MAX16 or start >= MAX32 or length >= MAX32:
            self._put(END64_FIELDS.pack(END64, END64_FIELDS.size - 12, 45, 45, 0, 0, count, count, length, start))
            self._put(LOCATOR64_FIELDS.pack(LOCATOR64, 0, end, 1))
            count, length, start = MAX16, MAX32, MAX32
        self._put(END_FIELDS.pack(END, 0, 0, min(count, MAX16), min(count, MAX16), min(length, MAX32), min(start, MAX32), 0))


class ZipReader:
    """Directory of a ZIP file that is read by ranges. ``read_at(length, offset)`` gives bytes, ``size`` is the file's."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        tail_at = max(0, size - END_FIELDS.size - MAX16)
        tail = read_at(size - tail_at, tail_at)
        at = tail.rfind(struct.pack("<I", END))
        while at >= 0:  # the bytes may also stand in the comment
            if len(tail) - at >= END_FIELDS.size and at + END_FIELDS.size + END_FIELDS.unpack_from(tail, at)[7] == len(tail):
                break
            at = tail.rfind(struct.pack("<I", END), 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        _, _, _, _, count, length, start, _ = END_FIELDS.unpack_from(tail, at)
        end_at = tail_at + at
        if MAX16 == count or MAX32 in (length, start):
            where = end_at - LOCATOR64_FIELDS.size
            signature, _, at64, _ = LOCATOR64_FIELDS.unpack(read_at(LOCATOR64_FIELDS.size, where)) if where >= 0 else (0, 0, 0, 0)
            if signature == LOCATOR64:
                found = END64_FIELDS.unpack(read_at(END64_FIELDS.size, at64))
                if found[0] != END64:
                    raise ValueError("broken ZIP64 end record")
                count, length, start = found[7], found[8], found[9]
        self.members = dict(self._directory(read_at(length, start), count))

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(count):
            f = CENTRAL_FIELDS.unpack_from(raw, at)
            if f[0] != CENTRAL:
                raise ValueError("broken central directory")
            method, packed, size, n_name, n_extra, n_comment, offset = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
            at += CENTRAL_FIELDS.size
            name, extra = raw[at : at + n_name].decode(), raw[at + n_name : at + n_name + n_extra]
            at += n_name + n_extra + n_comment
            k = 0
            while k + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, k)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                    size = wide.pop(0) if size == MAX32 else size
                    packed = wide.pop(0) if packed == MAX32 else packed
                    offset = wide.pop(0) if offset == MAX32 else offset
                k += 4 + n
            yield name, (method, packed, offset)

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's data."""
        method, length, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        f = LOCAL_FIELDS.unpack(self.read_at(LOCAL_FIELDS.size, offset))
        if f[0] != LOCAL:
            raise ValueError(f"no local header for {name}")
        return offset + LOCAL_FIELDS.size + f[9] + f[10], length

    def read(self, name: str) -> bytes:
        start, length = self.locate(name)
        return self.read_at(length, start)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzipped WARC/1.1 record: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return gzip.compress(("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(raw: bytes) -> dict:
    """Fields of one gzipped record; a response whose payload differs from its digest is an error."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": payload if kind == "response" else None,
    }


def write_packages(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, member_bytes: int = MEMBER_BYTES, zip64: bool = False) -> DataFrame:
    """Write one record for each row to ZIP packages below ``uri``; the packages as (path, size, n_records).

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest id is the response
    and the others revisit it; smaller payloads are all responses. Each task writes one package. The list is
    materialised before it is returned, so a later use doesn't write again.

    Edge cases: a null page has the empty payload; rows with equal payload and equal largest id are all responses;
    null ids count as the least, and if all ids are null all rows are responses; a null url is left out. An empty
    table gives no package. Ids are integers; other columns are ignored, whatever their names.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    bounded_batches(pages.sparkSession)
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    same = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    same = cut(same)
    found = rows.join(F.broadcast(same), "sha1", "left") if same.count() <= SAME_ROWS else shared_out(rows, same, ["sha1"], "n", ["page_id"], "left")
    told = found.select("page_id", "url", "payload", "sha1", F.expr(f"case when octet_length(payload) >= {int(min_revisit_bytes)} and not page_id <=> last then last end").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pafs.FileSystem.from_uri(uri)
        path, stream, out, n = f"{folder}/{uuid.uuid4().hex}.zip", None, None, 0
        held: list[bytes] = []
        index: list[str] = []
        size = members = 0

        def close_member():
            nonlocal held, index, size, members
            out.member(f"archive/data-{members:05d}.warc.gz", b"".join(held))
            out.member(f"indexes/data-{members:05d}.cdx", "".join(index).encode())
            held, index, size, members = [], [], 0, members + 1

        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                if stream is None:
                    system.create_dir(folder, recursive=True)
                    stream = system.open_output_stream(path)
                    out = ZipWriter(stream, zip64)
                made = record(page_id.as_py(), url.as_py(), payload.as_py(), base64.b32encode(sha1.as_py()).decode(), refers_to.as_py())
                index.append(json.dumps({"id": page_id.as_py(), "offset": size, "length": len(made)}) + "\n")
                held.append(made)
                size, n = size + len(made), n + 1
                if size >= member_bytes:
                    close_member()
        if stream is not None:
            if held:
                close_member()
            out.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([out.at], pa.int64()), pa.array([n], pa.int64())], names=["path", "size", "n_records"])

    return cut(told.mapInArrow(run, "path string, size long, n_records long"))


def read_packages(spark: SparkSession, packages: DataFrame, uri: str, payloads: bool = True) -> DataFrame:
    """All records of the packages (``path``, ``size``) in the file system of ``uri``.

    Columns: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, with ``payloads``, payload
    (null for revisits). Directories and indexes are read first; then ranges of neighbouring records are dealt to the
    tasks. Broken directories, indexes or payloads raise.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_file(path) as f:
                    package = ZipReader(lambda n, at, f=f: f.read_at(n, at), size)
                    for name in sorted(m for m in package.members if m.startswith("indexes/")):
                        base, length = package.locate(f"archive/{name[8:-4]}.warc.gz")
                        parts, begin, last, sizes = [], 0, 0, []
                        for line in package.read(name).decode().splitlines():
                            x = json.loads(line)
                            if sizes and (x["offset"] != last or last + x["length"] - begin > RANGE_BYTES):
                                parts.append((begin, sizes))
                                sizes = []
                            if not sizes:
                                begin = x["offset"]
                            sizes.append(x["length"])
                            last = x["offset"] + x["length"]
                        if last > length:
                            raise ValueError(f"{name} points behind its archive")
                        if sizes:
                            parts.append((begin, sizes))
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(parts), pa.string()), pa.array([base + b for b, _ in parts], pa.int64()), pa.array([s for _, s in parts], pa.list_(pa.int64()))], names=["path", "start", "lengths"])

    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(columns)]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(path) as f:
                    raw, at, rows = f.read_at(sum(lengths), start), 0, []
                    for n in lengths:
                        rows.append(parse_record(raw[at : at + n]))
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(columns, types, strict=True)], names=columns)

    parts = shuffle_partitions(spark)
    dealt = packages.select("path", "size").repartition(parts, "path").mapInArrow(ranges, "path string, start long, lengths array<long>").repartition(parts, "path", "start")
    return dealt.mapInArrow(records, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads)
