"""Operator 6: WARC records in ZIP-packaged archives, read by ranges.

Writing: pages whose payloads are equal (SHA-1 and length) have one response, the
smallest page_id; the others are revisits.  A task streams its records, each a gzip
member of its own, into archives of about a bounded size: ZIP files in the shared
folder with two stored members, ``data.warc.gz`` and ``index.cdx`` (offset and length
of each record).  Files of failed attempts have names of their own; only those that
the returned table lists count.

Reading: ``ZipReader`` parses the end record, the ZIP64 records and the central
directory, finds where stored members begin and reads the index.  Its ranges, in
chunks of ``CHUNK`` records, are dealt out to all tasks, which read just these ranges
of the files without extracting a member.

Very long payloads: a worker holds one record, or when reading one chunk of records
of at most ``ARCHIVE_BYTES`` (or one record), and its payload.

Defined cases: null html is an empty payload.  A page without page_id is a
response and never the one that others refer to.  Equal rows are both responses if
theirs is the smallest page_id.  Extra columns are not archived.  Empty tables
make no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import fresh_path, mapped, removed_at_end, written
from ._words import slices

LEAST = 0
ARCHIVE_BYTES = 16 << 20
CHUNK = 256
DATA, INDEX = "data.warc.gz", "index.cdx"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- ranges ----------------------------------------------------------------


class BytesSource:
    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.size = len(self.data)

    def read(self, start: int, length: int) -> bytes:
        return bytes(self.data[start : start + length])


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's filesystem for a URI as Hadoop writes it, and the path in it."""
    return fs.FileSystem.from_uri("s3://" + uri[6:] if uri.startswith("s3a://") else uri)


class FileSource:
    """Ranges of a file on any filesystem that Arrow opens by URI."""

    def __init__(self, uri: str):
        system, path = _filesystem(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(length, start)


# ---- ZIP -------------------------------------------------------------------


class ArchiveError(ValueError):
    pass


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int
    crc: int


class ZipReader:
    """Members of a ZIP archive and ranges of its stored members."""

    def __init__(self, source):
        self.source = source
        count, size, start, shift = self._end()
        self.members = {m.name: m for m in self._directory(count, size, start, shift)}
        self._begin: dict[str, int] = {}

    def _end(self) -> tuple[int, int, int, int]:
        """(entries, bytes and offset of the central directory, bytes before the archive)."""
        src = self.source
        tail_at = max(0, src.size - 65557)
        tail = src.read(tail_at, src.size - tail_at)
        at = len(tail)
        while True:
            at = tail.rfind(b"PK\5\6", 0, at)
            if at < 0:
                raise ArchiveError("no end of central directory")
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] <= len(tail):
                break
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        end = tail_at + at
        locator = src.read(end - 20, 20) if end >= 20 else b""
        if locator[:4] == b"PK\6\7":
            where = struct.unpack_from("<Q", locator, 8)[0]
            for place in (where, end - 76):  # the second: bytes before the archive shift all offsets
                big = src.read(place, 56) if place >= 0 else b""
                if big[:4] == b"PK\6\6":
                    count, size, start = struct.unpack_from("<QQQ", big, 32)
                    return count, size, start, place - where
            raise ArchiveError("no ZIP64 end of central directory")
        return count, size, start, end - size - start

    def _directory(self, count: int, size: int, start: int, shift: int):
        data = self.source.read(start + shift, size)
        at = 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\1\2":
                raise ArchiveError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            crc, packed, full = struct.unpack_from("<III", data, at + 16)
            n, e, c, disk = struct.unpack_from("<HHHH", data, at + 28)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, p = data[at + 46 + n : at + 46 + n + e], 0
            while p + 4 <= len(extra):
                kind, long = struct.unpack_from("<HH", extra, p)
                if kind == 1:
                    q = p + 4  # only the fields that overflow, in this order
                    if full == 0xFFFFFFFF:
                        full, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                    if packed == 0xFFFFFFFF:
                        packed, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", extra, q)[0]
                p += 4 + long
            yield Member(name, method, full, packed, header + shift, crc)
            at += 46 + n + e + c

    def begin(self, name: str) -> int:
        """Offset of a stored member's first byte."""
        if name not in self._begin:
            m = self.members[name]
            if m.method:
                raise ArchiveError(f"{name} is compressed; only stored members have ranges")
            local = self.source.read(m.header, 30)
            if local[:4] != b"PK\3\4":
                raise ArchiveError("broken local header")
            n, e = struct.unpack_from("<HH", local, 26)
            self._begin[name] = m.header + 30 + n + e
        return self._begin[name]

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        size = self.members[name].size
        length = size - start if length is None else length
        if start < 0 or length < 0 or start + length > size:
            raise ArchiveError("a range beyond its member")
        return self.source.read(self.begin(name) + start, length)


# ---- WARC ------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """A response record, or a revisit record where refers_to is given."""
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size)]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    block = _HTTP + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ArchiveError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(urn: str | None) -> int | None:
    got = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(got) if got else None


class ArchiveWriter:
    """Streams records into an archive on ``sink``, a file open for writing."""

    def __init__(self, sink, zip64: bool = False):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64)
        self.size, self.index = 0, []

    def add(self, data: bytes, note: str) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.index.append(f"{self.size} {len(packed)} {note}")
        self.size += self.data.write(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w") as f:
            f.write("\n".join(self.index).encode())
        self.zip.close()


def ranges(z: ZipReader) -> list[tuple[int, int]]:
    """(offset in the archive, length) of each record that the index lists."""
    begin = z.begin(DATA)
    return [(begin + int(start), int(length)) for start, length, _ in (line.split(" ", 2) for line in z.read(INDEX).decode().splitlines())]


def read_archive(source):
    """(fields, payload) of each record, by the ranges of the index."""
    for start, length in ranges(ZipReader(source)):
        yield parse_record(gzip.decompress(source.read(start, length)))


def _write(size, folder):
    def run(batches):
        name = f"{folder}/part-{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        system, path = _filesystem(name)
        done, out, sink = [], None, None

        def close():
            out.close()
            sink.close()
            done.append((f"{name}-{len(done)}.zip", len(out.index)))

        for whole in batches:
            for b in slices(whole, "html", 2 << 20):
                for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    payload = (html or "").encode()
                    digest = digest_of(payload)
                    if out is None:
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        sink = system.open_output_stream(f"{path}-{len(done)}.zip")
                        out = ArchiveWriter(sink)
                    out.add(record(page, url, payload, digest, len(payload), refers), digest)
                    if out.size >= size:
                        close()
                        out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done]), pa.array([n for _, n in done], pa.int64())], ["archive", "records"])

    return run


def _index(batches):
    for b in batches:
        for uri in b.column("archive").to_pylist():
            chunks, held = [[]], 0
            for start, length in ranges(ZipReader(FileSource(uri))):
                if chunks[-1] and (len(chunks[-1]) >= CHUNK or held + length > ARCHIVE_BYTES):
                    chunks.append([])
                    held = 0
                chunks[-1].append((start, length))
                held += length
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(chunks)), pa.array([[s for s, _ in c] for c in chunks], kind), pa.array([[n for _, n in c] for c in chunks], kind)], ["archive", "start", "length"])


def _read(batches):
    for b in batches:
        for uri, starts, lengths in zip(*(b.column(c).to_pylist() for c in ("archive", "start", "length"))):
            if not starts:
                continue
            source, rows = FileSource(uri), []
            for start, length in zip(starts, lengths):
                fields, payload = parse_record(gzip.decompress(source.read(start, length)))
                kind = fields["warc-type"]
                if kind == "response":
                    size, digest = len(payload), digest_of(payload)
                else:
                    size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                rows.append((_page(fields["warc-record-id"]), size, digest, kind, _page(fields.get("warc-refers-to")), fields.get("warc-target-uri")))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])


def with_references(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id of an equal payload of at least ``least`` bytes, null for that page itself."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    key = ["page_id", "digest", "size"]  # payloads travel once, by their own page; common digests only in rows of ids
    first = pages.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    refers = pages.select(*key).join(first, ["digest", "size"]).filter("page_id <> first").distinct()
    return pages.join(refers, key, "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, least: int = LEAST, size: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records): the URIs of ZIP files written to the shared folder, and how many records each holds."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "archives")
    out = written(with_references(pages, least).transform(mapped, _write(size, folder), "archive string, records long"), "archive-list")
    removed_at_end(spark, folder)
    return out


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(archive): the ZIP files in a folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select(F.col("path").alias("archive"))


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record of the files that archives.archive names."""
    chunks = archives.select("archive").transform(mapped, _index, "archive string, start array<long>, length array<long>")
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(n).transform(mapped, _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex,
         min(page_id) over (partition by sha1(coalesce(html, ''))) as first
  from pages
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::bigint >> (5 * (3 - i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from p
"""
