"""Marker segments, header fields and tables of JPEG files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.arrays import be16, byte_at, dezigzag
from ..sources.headers import Lazy
from ..sources.staging import stage

#: Marker bytes (ITU-T T.81, table B.1).
SOF0, SOF2, DHT, SOI, EOI, SOS, DQT, DRI, TEM = 0xC0, 0xC2, 0xC4, 0xD8, 0xD9, 0xDA, 0xDB, 0xDD, 0x01
DNL, DHP, EXP, COM = 0xDC, 0xDE, 0xDF, 0xFE
IGNORED = {*range(0xE0, 0xF0), *range(0xF0, 0xFE), DNL, DHP, EXP, COM}
KNOWN = {SOF0, SOF2, DHT, SOS, DQT, DRI} | IGNORED


def split_segments(data: bytes | Lazy, skip: frozenset[int] | set[int] = frozenset()):
    """(ord, marker, offset, length, payload, error) up to the first SOS; jumps by length.

    Segments of the markers in ``skip`` are passed over without a look at their payload.
    """
    if data[:2] != b"\xff\xd8":
        yield 0, None, 0, 0, None, "bad_soi"
        return
    at, order = 2, 0
    while True:
        order += 1
        if at >= len(data):
            yield order, None, at, 0, None, "truncated"
            return
        if data[at] != 0xFF:
            yield order, None, at, 0, None, "expected_marker"
            return
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            yield order, None, at, 0, None, "truncated"
            return
        marker, at = data[at], at + 1
        if marker == TEM:
            continue
        if marker not in KNOWN:
            yield order, marker, at, 0, None, "unknown_marker"
            continue
        length = int.from_bytes(data[at : at + 2], "big")
        if length < 2 or at + length > len(data):
            yield order, marker, at, length, None, "truncated"
            return
        if marker not in skip:
            yield order, marker, at, length, data[at + 2 : at + length], None
        at += length
        if marker == SOS:
            return


def split_intervals(data: bytes, at: int):
    """(interval_no, data, error) of the entropy bytes from ``at``: unstuffed, split at restart markers."""
    marks = np.flatnonzero(np.frombuffer(data, np.uint8, offset=min(at, len(data))) == 0xFF) + at
    parts, number, start, done = [], 0, at, at
    for p in marks.tolist():
        if p < done:
            continue
        nxt = p + 1
        while nxt < len(data) and data[nxt] == 0xFF:
            nxt += 1
        if nxt >= len(data):
            break
        code, done = data[nxt], nxt + 1
        if code == 0x00:
            parts.append(data[start:p] + b"\xff")
        else:
            parts.append(data[start:p])
            if code == EOI:
                yield number, b"".join(parts), None
                return
            if not 0xD0 <= code <= 0xD7:
                yield number, b"".join(parts), "marker_in_scan"
                return
            yield number, b"".join(parts), None
            parts, number = [], number + 1
        start = done
    yield number, b"".join([*parts, data[start:]]), "truncated"


def split_range(data: bytes | Lazy, start: int, lo: int, hi: int):
    """(data, code) of the entropy bytes from ``lo`` to ``hi``, cut after each marker; entropy bytes begin at ``start``.

    ``code`` is the marker that ends a piece, none at the end of the range. A run of
    FF bytes and the byte after it belong to the range in which the run begins.
    """
    at = lo
    if lo > start and data[lo - 1] == 0xFF:  # such a byte is never a code
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return  # the run before ends the file
        at += 1
    own = data[at:hi]
    parts, begin, done = [], at, at
    for p in (np.flatnonzero(np.frombuffer(own, np.uint8) == 0xFF) + at).tolist():
        if p < done:
            continue
        nxt = p + 1
        while nxt < len(data) and data[nxt] == 0xFF:
            nxt += 1
        if nxt >= len(data):
            yield b"".join([*parts, own[begin - at : p - at], data[p:]]), None
            return
        code, done = data[nxt], nxt + 1
        parts.append(own[begin - at : p - at])
        if code == 0x00:
            parts.append(b"\xff")
        else:
            yield b"".join(parts), code
            parts = []
        begin = done
    yield b"".join([*parts, own[max(begin - at, 0) :] if begin < hi else b""]), None


def mapped(files: DataFrame, fields: list[tuple[str, str, pa.DataType]], rows) -> DataFrame:
    """Rows of each file's bytes, with its id, made inside Arrow batches."""
    kind = files.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, cols = [], [[] for _ in fields]
            for i, row in enumerate(zip(*(batch.column(c) for c in batch.schema.names if c != "image_id"), strict=True)):
                for out in rows(*(x.as_py() for x in row)):
                    at.append(i)
                    for c, x in zip(cols, out, strict=True):
                        c.append(x)
            ids = batch.column(batch.schema.names.index("image_id")).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f[2]) for c, f in zip(cols, fields, strict=True))], ["image_id", *(f[0] for f in fields)])

    return files.mapInArrow(run, ", ".join([f"image_id {kind}", *(f"{n} {k}" for n, k, _ in fields)]))


SEGMENT = [("ord", "int", pa.int32()), ("marker", "int", pa.int32()), ("offset", "bigint", pa.int64()), ("length", "int", pa.int32()), ("payload", "binary", pa.binary()), ("error", "string", pa.string())]


def segments(files: DataFrame) -> DataFrame:
    """``image_id, ord, marker, offset, length, payload, error`` up to and with the first SOS.

    A row with ``error`` tells why the walk stopped (or an unknown marker, after
    which it goes on). Null content counts as empty.
    """
    return mapped(files.select("image_id", "content"), SEGMENT, lambda content: split_segments(content or b""))


def walk(source: bytes | str | None, skip: set[int]):
    """``split_segments`` of a file's bytes, or of the file at a path."""
    if not isinstance(source, str):
        yield from split_segments(source or b"", skip)
        return
    data = Lazy(source)
    try:
        yield from split_segments(data, skip)
    finally:
        data.close()


def _intervals(content: bytes | None):
    start = None
    for _, marker, offset, length, _, error in split_segments(content or b"", KNOWN - {SOS}):
        if marker == SOS and error is None:
            start = offset + length
    if start is not None:
        yield from split_intervals(content, start)


def entropy_intervals(files: DataFrame, segs: DataFrame | None = None) -> DataFrame:
    """``image_id, interval_no, data, error`` of every file whose walk reaches SOS.

    Each file is walked again where it is split, so file bytes are never joined or
    shuffled. With ``segs`` only files that have their SOS there.
    """
    fields = [("interval_no", "int", pa.int32()), ("data", "binary", pa.binary()), ("error", "string", pa.string())]
    out = mapped(files.select("image_id", "content"), fields, _intervals)
    return out if segs is None else out.join(of_kind(segs, SOS).select("image_id"), "image_id", "left_semi")


#: Bytes of a file that one task reads.
RANGE = 32 << 20


def entropy_ranges(files: DataFrame, segs: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """As ``entropy_intervals``, of files that are given by ``path`` and ``length`` and not read yet.

    A file of any size is read in ranges by several tasks, once if it is listed twice. Restart markers are
    counted by range and summed up, which numbers the intervals; the pieces of an
    interval that lies in several ranges are put together. What follows the end of
    the image, or a marker that has no place there, is dropped.
    """
    sos = of_kind(segs, SOS).select("image_id", (F.col("offset") + F.col("length")).alias("start"))
    d = files.select("image_id", "path", "length").dropDuplicates(["image_id"]).join(sos, "image_id")
    n = F.greatest(F.ceil((F.col("length") - F.col("start")) / range_bytes), F.lit(1)).cast("int")
    d = d.select("image_id", "path", "start", F.explode(F.sequence(F.lit(0), n - 1)).alias("range"), n.alias("ranges")).repartition("image_id", "range")

    def rows(path, start, number, ranges):
        data = Lazy(path, 1 << 16)
        try:
            lo = start + number * range_bytes
            hi = len(data) if number == ranges - 1 else min(lo + range_bytes, len(data))
            for place, (piece, code) in enumerate(split_range(data, start, lo, hi)):
                yield number, place, piece, code
        finally:
            data.close()

    pieces = stage(mapped(d, [("range", "int", pa.int32()), ("place", "int", pa.int32()), ("data", "binary", pa.binary()), ("code", "int", pa.int32())], rows), "pieces")
    # a row for each range
    last = F.min(F.when(~F.col("code").between(0xD0, 0xD7), F.struct("range", "place", "code")))
    ends = pieces.groupBy("image_id").agg(last.alias("end"), F.max(F.struct("range", "place")).alias("most"))
    counts = pieces.groupBy("image_id", "range").agg(F.count("code").alias("n"))
    before = counts.select("image_id", "range", (F.sum("n").over(W.partitionBy("image_id").orderBy("range")) - F.col("n")).alias("before"))
    p = pieces.join(before, ["image_id", "range"]).join(ends, "image_id")
    here = F.struct("range", "place")
    p = p.filter(F.col("end").isNull() | (here <= F.struct("end.range", "end.place")))
    final = here == F.when(F.col("end").isNotNull(), F.struct("end.range", "end.place")).otherwise(F.col("most"))
    error = F.when(final, F.when(F.col("end").isNull(), "truncated").when(F.col("end.code") != EOI, "marker_in_scan"))
    p = p.select("image_id", (F.col("before") + F.col("place")).cast("int").alias("interval_no"), "range", "data", error.alias("error"))
    p = p.repartition("image_id", "interval_no").sortWithinPartitions("image_id", "interval_no", "range")
    kind = p.schema["image_id"].dataType.simpleString()

    def join(batches):
        key, parts, error = None, [], None
        for batch in batches:
            for i, number, x, e in zip(batch.column("image_id"), batch.column("interval_no").to_pylist(), batch.column("data"), batch.column("error").to_pylist(), strict=True):
                if key is None or number != key[1] or i != key[0]:
                    if key is not None:
                        yield row(key, parts, error)
                    key, parts = (i, number), []
                parts.append(x.as_py())
                error = e
        if key is not None:
            yield row(key, parts, error)

    def row(key, parts, error):
        cols = [pa.array([key[0].as_py()], key[0].type), pa.array([key[1]], pa.int32()), pa.array([b"".join(parts)], pa.binary()), pa.array([error], pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["image_id", "interval_no", "data", "error"])

    return p.select("image_id", "interval_no", "data", "error").mapInArrow(join, f"image_id {kind}, interval_no int, data binary, error string")


def drop_ignorable(segs: DataFrame) -> DataFrame:
    """Without application, comment and other segments that don't affect decoding; one that ends the walk stays."""
    return segs.filter(F.col("marker").isNull() | F.col("error").isNotNull() | ~F.col("marker").isin(*sorted(IGNORED)))


def of_kind(segs: DataFrame, *markers: int) -> DataFrame:
    return segs.filter(F.col("marker").isin(*markers) & F.col("error").isNull())


def last_definition(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that comes last: a table defined again replaces the earlier one."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def frame_header(segs: DataFrame) -> DataFrame:
    """``image_id, ord, frame_type, precision, height, width, num_components, zero_based`` of each frame segment."""
    p = F.col("payload")
    return of_kind(segs, SOF0, SOF2).select(
        "image_id", "ord", "length", "payload", (F.col("marker") - SOF0).alias("frame_type"), byte_at(p, 0).alias("precision"), be16(p, 1).alias("height"), be16(p, 3).alias("width"),
        byte_at(p, 5).alias("num_components"), (byte_at(p, 6) == 0).alias("zero_based"),
    )


def _each(n: Column, *columns) -> list:
    """One row for each of ``n`` entries, numbered ``i`` from 0."""
    return [*columns, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("i")]


def frame_components(segs: DataFrame) -> DataFrame:
    """One row per component of a frame: ``component`` (from 1), sampling and quantization table id."""
    p, at = F.col("payload"), 6 + 3 * F.col("i")
    rows = frame_header(segs).select(*_each(F.col("num_components"), "image_id", "ord", "payload", "zero_based"))
    return rows.select(
        "image_id", "ord", F.col("i").alias("place"), (byte_at(p, at) + F.col("zero_based").cast("int")).alias("component"),
        F.shiftright(byte_at(p, at + 1), 4).alias("h"), byte_at(p, at + 1).bitwiseAND(15).alias("v"), byte_at(p, at + 2).alias("quant_id"),
    )


def scan_header(segs: DataFrame) -> DataFrame:
    """``image_id, ord, length, components_in_scan, ss, se, ah, al`` of the scan."""
    p = F.col("payload")
    n = byte_at(p, 0)
    end = 1 + 2 * n
    return of_kind(segs, SOS).select(
        "image_id", "ord", "length", "payload", n.alias("components_in_scan"), byte_at(p, end).alias("ss"), byte_at(p, end + 1).alias("se"),
        F.shiftright(byte_at(p, end + 2), 4).alias("ah"), byte_at(p, end + 2).bitwiseAND(15).alias("al"),
    )


def scan_components(segs: DataFrame) -> DataFrame:
    """``image_id, ord, place, scan_id, dc_id, ac_id``; the id as written (a zero-based frame shifts it by one)."""
    p, at = F.col("payload"), 1 + 2 * F.col("i")
    rows = scan_header(segs).select(*_each(F.col("components_in_scan"), "image_id", "ord", "payload"))
    return rows.select("image_id", "ord", F.col("i").alias("place"), byte_at(p, at).alias("scan_id"), F.shiftright(byte_at(p, at + 1), 4).alias("dc_id"), byte_at(p, at + 1).bitwiseAND(15).alias("ac_id"))


def restart_interval(segs: DataFrame) -> DataFrame:
    """``image_id, restart_interval``; the last definition counts."""
    dri = of_kind(segs, DRI).select("image_id", "ord", be16(F.col("payload"), 0).alias("restart_interval"))
    return last_definition(dri, ["image_id"], "ord").drop("ord")


def split_quant(payload: bytes):
    """(place, table id, 64 values in scan order, error) of a DQT payload."""
    at = place = 0
    while at < len(payload):
        wide, table = payload[at] >> 4, payload[at] & 15
        size = 128 if wide else 64
        if table > 3:
            yield place, table, None, "bad_quant_id"
            return
        if at + 1 + size > len(payload):
            yield place, table, None, "bad_dqt_length"
            return
        yield place, table, np.frombuffer(payload, ">u2" if wide else "u1", 64, at + 1).astype(np.int32), None
        at, place = at + 1 + size, place + 1


def split_huffman(payload: bytes):
    """(place, class, table id, counts, symbols, error) of a DHT payload."""
    at = place = 0
    while at < len(payload):
        kind, table = payload[at] >> 4, payload[at] & 15
        counts = payload[at + 1 : at + 17]
        n = sum(counts)
        error = "bad_huffman_id" if table > 3 or kind > 1 else "bad_dht_length" if len(counts) < 16 else "huffman_too_many" if n > 162 else "bad_dht_length" if at + 17 + n > len(payload) else None
        if error:
            yield place, kind, table, None, None, error
            return
        yield place, kind, table, list(counts), list(payload[at + 17 : at + 17 + n]), None
        at, place = at + 17 + n, place + 1


#: Fields of a parsed table.
QUANT = "place:int,table_id:int,scan:array<int>,error:string"
HUFFMAN = "place:int,table_class:int,table_id:int,counts:array<int>,symbols:array<int>,error:string"


def all_quant(segs: DataFrame) -> DataFrame:
    """``image_id, ord`` and a row for each table of DQT segments; parsed before in ``checked_segments``."""
    if "quant" in segs.columns:
        return segs.select("image_id", "ord", F.explode("quant").alias("x")).select("image_id", "ord", "x.*")
    fields = [("ord", "int", pa.int32()), ("place", "int", pa.int32()), ("table_id", "int", pa.int32()), ("scan", "array<int>", pa.list_(pa.int32())), ("error", "string", pa.string())]
    return mapped(of_kind(segs, DQT).select("image_id", "ord", "payload"), fields, lambda order, payload: ((order, *x) for x in split_quant(payload)))


def quant_tables(segs: DataFrame) -> DataFrame:
    """``image_id, table_id, q``: steps in row order; the last definition counts."""
    last = last_definition(all_quant(segs).filter("error is null"), ["image_id", "table_id"], "ord", "place")
    return last.select("image_id", "table_id", dezigzag(F.col("scan")).alias("q"))


def all_huffman(segs: DataFrame) -> DataFrame:
    """As ``all_quant``, of DHT segments."""
    if "huffman" in segs.columns:
        return segs.select("image_id", "ord", F.explode("huffman").alias("x")).select("image_id", "ord", "x.*")
    ints = pa.list_(pa.int32())
    fields = [("ord", "int", pa.int32()), ("place", "int", pa.int32()), ("table_class", "int", pa.int32()), ("table_id", "int", pa.int32()), ("counts", "array<int>", ints), ("symbols", "array<int>", ints), ("error", "string", pa.string())]
    return mapped(of_kind(segs, DHT).select("image_id", "ord", "payload"), fields, lambda order, payload: ((order, *x) for x in split_huffman(payload)))


def huffman_tables(segs: DataFrame) -> DataFrame:
    """``image_id, table_class, table_id, counts, symbols``; the last definition counts."""
    last = last_definition(all_huffman(segs).filter("error is null"), ["image_id", "table_class", "table_id"], "ord", "place")
    return last.select("image_id", "table_class", "table_id", "counts", "symbols")


def canonical_codes(tables: DataFrame) -> DataFrame:
    """``image_id, table_class, table_id, idx, symbol, code_len, code``: codes count up, and double with each length."""
    key = ["image_id", "table_class", "table_id"]
    lengths = tables.select(*key, "symbols", F.posexplode("counts").alias("pos", "n")).withColumn("code_len", F.col("pos") + 1)
    before = W.partitionBy(*key).orderBy("code_len").rowsBetween(W.unboundedPreceding, -1)
    weight = F.sum(F.col("n").cast("bigint") * F.call_function("shiftleft", F.lit(1).cast("bigint"), 16 - F.col("code_len"))).over(before)
    first = F.call_function("shiftright", F.coalesce(weight, F.lit(0).cast("bigint")), 16 - F.col("code_len"))
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    rows = lengths.select(*key, "symbols", "code_len", first.alias("first"), start.alias("start"), "n")
    rows = rows.select(*key, "symbols", "code_len", "first", "start", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))).alias("k"))
    idx = (F.col("start") + F.col("k")).cast("int")
    return rows.select(*key, idx.alias("idx"), F.get("symbols", idx).alias("symbol"), "code_len", (F.col("first") + F.col("k")).cast("int").alias("code"))
