"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC
records, then a skippable frame with the seek table (compressed and raw size of
every frame) as the seekable format lays it down. The index maps a record to its
frame and its offset in that frame's raw bytes, so one record costs one frame.

Bundles are rows of a table (``bundle``, ``data``, ``index``), so Spark commits
them and any store it can write will do; ``export`` writes plain files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry a fixed date, so equal tables give equal archives.
DATE = "2000-01-01T00:00:00Z"

INDEX = "array<struct<page_id:long,frame:int,offset:int,length:int>>"
_INDEX = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    return " ".join(value.split())  # a line break would end the header


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to`` with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""

    def fields(lines: list[bytes]) -> dict[str, str]:
        pairs = (x.decode().split(":", 1) for x in lines if b":" in x)
        return {k.lower(): v.strip() for k, v in pairs}

    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = fields(lines[1:])
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length doesn't match its header")
    http, payload = block.split(b"\r\n\r\n", 1)
    return warc, fields(http.split(b"\r\n")[1:]), payload


class BundleWriter:
    """Groups records into frames and frames into one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.index: list[tuple] = []
        self.open, self.raw, self.bytes = [], 0, 0

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.raw and self.raw + len(record) > self.frame_bytes:
            self.close_frame()
        self.index.append((page_id, len(self.frames), self.raw, len(record)))
        self.open.append(record)
        self.raw += len(record)

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.frames.append(packed)
            self.table.append((len(packed), self.raw))
            self.bytes += len(packed)
            self.open, self.raw = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        foot = struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(foot)), entries, foot])


class BundleReader:
    """Reads frames of a bundle by its seek table."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        n, flags, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError("no seek table")
        self.sizes = list(struct.iter_unpack("<II", self.data[-9 - 8 * n : -9]))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.unpacker, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            raw = self.unpacker.decompress(self.data[self.starts[i] : self.starts[i + 1]])
            if len(raw) != self.sizes[i][1]:
                raise ValueError("frame size doesn't match the seek table")
            self.last = i, raw
        return self.last[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


# --------------------------------------------------------------------------
# Jobs


def first_of_equal(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload) with ``refers_to``: the least page with an equal payload, null for itself.

    Digests are counted by page id alone; payloads are not shuffled when the
    repeated digests are few enough to broadcast.
    """
    key = F.sha1("payload")
    of = pages.filter(F.length("payload") >= least_bytes).select("page_id", key.alias("digest"))
    first = of.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    joined = pages.withColumn("digest", F.when(F.length("payload") >= least_bytes, key)).join(small(stage(first, "digests")), "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Table of bundles: ``bundle`` (name), ``data``, ``index``.

    Of equal payloads of at least ``least_bytes`` the least page is the response
    and the others revisit it; smaller payloads are all responses. A null html is
    an empty payload; a null url has no target field. A row without a page id is
    written without one, as a revisit where a page with an id has its payload.
    Repeated rows are separate records (equal ids: both responses).
    """
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    p = first_of_equal(p, least_bytes).withColumn("part", F.spark_partition_id())

    def run(batches):
        part, n, out = 0, 0, BundleWriter()

        def done():
            data = out.finish()
            rows = [dict(zip(("page_id", "frame", "offset", "length"), x, strict=True)) for x in out.index]
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([data], pa.binary()), pa.array([rows], _INDEX)], ["bundle", "data", "index"])

        for batch in batches:
            for page, url_, payload, refers, where in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "part")), strict=True):
                part = where.as_py()
                out.add(page.as_py(), build_record(page.as_py(), url_.as_py(), payload.as_py(), refers.as_py()))
                if out.bytes >= BUNDLE_BYTES:
                    yield done()
                    n, out = n + 1, BundleWriter()
        if out.index:
            yield done()

    return p.mapInArrow(run, f"bundle string, data binary, index {INDEX}")


def read_records(bundles: DataFrame) -> DataFrame:
    """Every record, by way of the index: its fields and, for responses, its payload's own digest and size.

    Columns ``page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, bundle, frame, offset``. A digest that doesn't match a response's
    payload raises an error.
    """

    def run(batches):
        for batch in batches:
            for name, data, index in zip(batch.column("bundle"), batch.column("data"), batch.column("index"), strict=True):
                yield pa.RecordBatch.from_pylist(list(_records(name.as_py(), data.as_py(), index.as_py())), schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int32())])
    return bundles.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, bundle string, frame int, offset int")


def _records(name: str, data: bytes, index: list[dict]) -> Iterator[dict]:
    reader = BundleReader(data)
    for x in index:
        warc, http, payload = parse_record(reader.record(x["frame"], x["offset"], x["length"]))
        kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
        size = int(http["content-length"])
        if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
            raise ValueError(f"payload of page {x['page_id']} doesn't match its record")
        refers = warc.get("x-refers-to-page")
        page = warc.get("x-page-id")
        yield {"page_id": None if page is None else int(page), "url": warc.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": None if refers is None else int(refers), "bundle": name, "frame": x["frame"], "offset": x["offset"]}


def export(bundles: DataFrame, folder: str) -> None:
    """Write bundles as ``<bundle>.warc.zst`` into ``folder``, which all executors can reach."""

    def run(rows):
        for r in rows:
            path = os.path.join(folder, f"{r.bundle}.warc.zst")
            with open(f"{path}.{os.getpid()}.tmp", "wb") as f:
                f.write(r.data)
            os.replace(f.name, path)

    bundles.select("bundle", "data").foreachPartition(run)
