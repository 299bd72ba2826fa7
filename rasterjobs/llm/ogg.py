"""Ogg as a media column: pages with checksums, lacing, logical streams, granule times.

A document's bytes are stored as 8-bit mono samples in one logical stream, in
packets of 576 samples; a second logical stream carries a comment packet. The
reader checks every page, rebuilds packets from lacing values (also those that
span pages), splits the streams apart and turns granule positions into seconds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage

PACKET = 576
#: Texts, or stored files, that a task holds at once.
HELD = 64
RATE = 8000
SAMPLES, COMMENTS = 0x53414D50, 0x434F4D4D  # serial numbers of the two streams
MAGIC = b"PCM8"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
#: Lacing values of a page; 255 is the format's limit.
SEGMENTS = 255
HEAD = struct.Struct("<4sBBqIIIB")

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, unreflected, from 0, without a final xor.

    zlib has the reflected form of the same polynomial, so bytes go in and the
    result comes out with their bits reversed.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def mux_stream(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """The pages of one logical stream; a packet may run over several pages."""
    lacing, ends = [], []  # per lacing value; ends: (packet, value's place)
    for i, p in enumerate(packets):
        lacing += [255] * (len(p) // 255) + [len(p) % 255]
        ends.append(len(lacing) - 1)
    body, pages, at, last_end = b"".join(packets), [], 0, -1
    end_at = dict(zip(ends, granules, strict=True))
    for number, lo in enumerate(range(0, len(lacing), SEGMENTS)):
        part = lacing[lo : lo + SEGMENTS]
        size = sum(part)
        closed = [x for x in range(lo, lo + len(part)) if x in end_at]
        flags = (CONTINUED if lo and last_end != lo - 1 else 0) | (FIRST if not lo else 0) | (LAST if lo + len(part) == len(lacing) else 0)
        pages.append(_page(flags, end_at[closed[-1]] if closed else NO_GRANULE, serial, number, bytes(part), body[at : at + size]))
        at, last_end = at + size, closed[-1] if closed else last_end
    return pages


def encode(payload: bytes, comment: bytes = b"") -> bytes:
    """``payload`` (a positive multiple of 576 bytes) as an Ogg file of two interleaved streams."""
    head = MAGIC + struct.pack("<IQ", RATE, len(payload))
    packets = [head] + [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    granules = [0] + [min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET)]
    # the first packets stand alone on the first pages, as the format wants
    first = mux_stream([head], [0], SAMPLES)[0]
    rest = mux_stream(packets[1:], granules[1:], SAMPLES)
    rest = [_page((p[5] & ~FIRST), *_renumber(p), p[27 : 27 + p[26]], p[27 + p[26] :]) for p in rest]
    first = _page(FIRST, 0, SAMPLES, 0, first[27:28], first[28:])
    comments = mux_stream([comment], [0], COMMENTS)
    out = [first, comments[0]]
    for i in range(max(len(rest), len(comments) - 1)):
        out += rest[i : i + 1] + comments[i + 1 : i + 2]
    return b"".join(out)


def _renumber(page: bytes) -> tuple[int, int, int]:
    _, _, _, granule, serial, number, _, _ = HEAD.unpack_from(page)
    return granule, serial, number + 1


@dataclass
class Stream:
    """A logical stream: packets with the granule position of the page on which they end."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)


def decode(data: bytes) -> dict[int, Stream]:
    """Demultiplex a file; raises ValueError on a bad checksum, gap or cut page."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEAD.size or data[at : at + 4] != b"OggS":
            raise ValueError("no page where one must begin")
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = data[at : at + size]
        if version or len(page) != size:
            raise ValueError("page is cut")
        if checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("page checksum")
        if flags & FIRST:
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages or bool(flags & CONTINUED) != bool(s.open):
            raise ValueError("page out of order")
        s.pages += 1
        place, done = 27 + n, 0
        start = place
        for v in lacing:
            place += v
            if v < 255:
                s.packets.append(b"".join([*s.open, page[start:place]]))
                s.open, start, done = [], place, done + 1
        if start < place or (lacing and lacing[-1] == 255):
            s.open.append(page[start:place])
        s.granules += [NO_GRANULE] * (done - 1) + [granule] * (done > 0)
        s.ended = bool(flags & LAST)
        at += size
    if any(s.open for s in streams.values()):
        raise ValueError("packet is cut")
    return streams


def read_samples(data: bytes) -> tuple[bytes, list[float], dict[int, Stream]]:
    """Payload, end times of its packets in seconds, and all streams.

    A page names the position of its last packet only; earlier packets of the
    page count back from it, as each holds ``PACKET`` samples.
    """
    streams = decode(data)
    s = streams[SAMPLES]
    if s.packets[0][:4] != MAGIC:
        raise ValueError("not a sample stream")
    rate, size = struct.unpack("<IQ", s.packets[0][4:])
    payload = b"".join(s.packets[1:])
    ends = np.cumsum([len(p) for p in s.packets[1:]])
    known = np.array(s.granules[1:])
    if len(payload) != size or not np.array_equal(ends[known >= 0], known[known >= 0]):
        raise ValueError("granule positions don't match the samples")
    return payload, (ends / rate).tolist(), streams


def pad(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % PACKET or (0 if text else PACKET))


def feature(payload: bytes, times: list[float], streams: dict[int, Stream]) -> str:
    """Packets, pages, seconds, and mean, deviation and zero crossings of the samples about 128, as text."""
    x = np.frombuffer(payload, np.uint8)
    above = x >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    total = int(x.sum(dtype=np.int64))
    squares = int(np.bincount(x, minlength=256) @ np.arange(256, dtype=np.int64) ** 2)
    pages = sum(s.pages for s in streams.values())
    return f"packets={len(times)} pages={pages} ms={round(times[-1] * 1000)} sum={total} squares={squares} crossings={crossings}"


def media(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text as an Ogg file (null: empty)."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, HELD):
            texts = [t.as_py() for t in batch.column("text")]
            files = [encode(pad(t), b"n_bytes=%d" % len(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def describe(files: DataFrame) -> DataFrame:
    """What the stored files hold: sizes, digests and features, read back from ``media``.

    Columns as in ``files`` but for ``media``, and ``payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.
    """
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, HELD):
            rows = []
            for data in batch.column("media"):
                data = data.as_py()
                payload, times, streams = read_samples(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, times, streams)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_table(docs: DataFrame, **options) -> DataFrame:
    """Store every text as Ogg in the shared folder, read the files back and describe them."""
    return describe(stage(media(docs, **options), "media"))
