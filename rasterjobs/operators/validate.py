"""Header rules: a table of violations, the first one of each image, and the verdict."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments as S

ERRORS = "image_id, code, detail, ord, step"
_ERROR = "code string, detail string, ord int, step int"
WALK = ("bad_soi", "expected_marker", "truncated", "unknown_marker")


def _at(payload: bytes, i: int) -> int | None:
    return payload[i] if i < len(payload) else None


def _be16(payload: bytes, i: int) -> int | None:
    return int.from_bytes(payload[i : i + 2], "big") if i + 2 <= len(payload) else None


def _text(sep: str, *values) -> str:
    return sep.join(str(v) for v in values if v is not None)


def violations(segs) -> list[tuple[str, str | None, int, int]]:
    """(code, detail, ord, step) of every rule that the segments of one header break.

    ``segs``: (ord, marker, length, offset, payload, error, quant, huffman) in order,
    the last two as ``split_quant`` and ``split_huffman`` give them. ``step`` follows
    the order in which a reader meets the rules of one segment.
    """
    out: list[tuple[str, str | None, int, int]] = []
    known: set[tuple] = set()  # tables that were defined, in any segment
    quant_of: dict[int, int | None] = {}  # table of a component, by the last frame that has it
    frame, frames, scan = None, 0, None

    def fire(when, code, detail, order, step):
        if when:
            out.append((code, None if detail is None else str(detail), order, step))

    for order, marker, length, offset, p, error, quant, huffman in segs:
        if error is not None:
            fire(True, error, offset, order, WALK.index(error))
            continue
        if marker in (S.SOF0, S.SOF2):
            frames += 1
            precision, height, width, n, first = _at(p, 0), _be16(p, 1), _be16(p, 3), _at(p, 5), _at(p, 6)
            frame = (marker - S.SOF0, n, first == 0)
            usual = n is not None and 1 <= n <= 3
            short = length < 8 or (n is not None and length < 8 + 3 * n)
            fire(frames > 1, "multiple_sof", frames, order, 10)
            fire(length < 8, "truncated", length, order, 11)
            fire(precision is not None and precision != 8, "bad_precision", precision, order, 12)
            fire(height == 0 or width == 0, "bad_dimensions", _text("x", width, height), order, 13)
            fire(n == 4, "cmyk", n, order, 14)
            fire(n == 0, "no_components", n, order, 15)
            fire(usual and short, "truncated", length, order, 16)
            seen: set = set()
            for i in range(n or 0):
                own, sampling, table = (_at(p, 6 + 3 * i + k) for k in range(3))
                component = None if own is None else own + (first == 0)
                if component is not None:
                    quant_of[component] = table
                if not usual:
                    continue
                h, v = (None, None) if sampling is None else (sampling >> 4, sampling & 15)
                fire(component in (4, 5), "yiq", component, order, 20)
                fire(component == 0 or (component or 0) > 3, "bad_component_id", component, order, 21)
                fire(component in seen, "dup_component", component, order, 22)
                fire(sampling is not None and not (h in (1, 2) and v in (1, 2) if component == 1 else h == v == 1), "bad_sampling", _text("x", h, v), order, 23)
                fire(table is not None and table > 3, "bad_quant_ref", table, order, 24)
                seen.add(component)
            fire(usual and not short and length != 8 + 3 * n, "bad_sof_length", length, order, 30)
        elif marker == S.DQT:
            for _, table, _, wrong in quant:
                if wrong is None:
                    known.add(("q", table))
                else:
                    fire(True, wrong, table, order, 40 + ("bad_quant_id", "bad_dqt_length").index(wrong))
        elif marker == S.DHT:
            for _, kind, table, _, _, wrong in huffman:
                if wrong is None:
                    known.add((kind, table))
                else:
                    fire(True, wrong, table, order, 50 + ("bad_huffman_id", "huffman_too_many", "bad_dht_length").index(wrong))
        elif marker == S.DRI:
            fire(length != 4, "bad_dri_length", length, order, 60)
        elif marker == S.SOS:
            scan = (order, length, p)
    if scan is None:
        return out
    order, length, p = scan
    n = _at(p, 0)
    if frame is None:
        fire(True, "sos_before_sof", "", order, 70)
        return out
    cut = length < 3 or (n is not None and length < 6 + 2 * n)
    fire(length < 3, "truncated", length, order, 71)
    fire(n == 0, "empty_scan", n, order, 72)
    fire(bool(n) and cut, "truncated", length, order, 73)
    if cut or not n:
        return out
    kind, count, zero_based = frame
    ss, se, a = (_at(p, 1 + 2 * n + k) for k in range(3))
    ah, al = a >> 4, a & 15
    seen = set()
    for i in range(n):
        component, tables = _at(p, 1 + 2 * i) + zero_based, _at(p, 2 + 2 * i)
        dc, ac, quant = tables >> 4, tables & 15, quant_of.get(component)
        fire(component == 0 or (count is not None and component > count) or quant is None, "bad_scan_component", component, order, 80)
        fire(component in seen, "dup_scan_component", component, order, 81)
        fire(dc > 3, "bad_dc_table_id", dc, order, 82)
        fire(ac > 3, "bad_ac_table_id", ac, order, 83)
        fire(quant is not None and quant <= 3 and ("q", quant) not in known, "unset_quant", quant, order, 95)
        fire(dc <= 3 and ss == 0 and (0, dc) not in known, "unset_dc", dc, order, 96)
        fire(ac <= 3 and se > 0 and (1, ac) not in known, "unset_ac", ac, order, 97)
        seen.add(component)
    baseline = kind == 0
    fire((ss, se) != (0, 63) if baseline else ss > se or se > 63 or (ss == 0 and se != 0) or (ss != 0 and n != 1), "bad_spectral", _text("..", ss, se), order, 90)
    fire((ah, al) != (0, 0) if baseline else ah != 0 and al != ah - 1, "bad_approx", _text("/", ah, al), order, 91)
    fire(length != 6 + 2 * n, "bad_sos_length", length, order, 99)
    return out


def _checksum(source: bytes | str | None) -> int:
    data = source.encode() if isinstance(source, str) else source or b""
    return zlib.crc32(data) << 31 | len(data) & 0x7FFFFFFF


def once(segs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """``segs`` (``checked_segments``, written down) with one file of each id, the ids that differ, and whether any id is repeated.

    Rows of ``files`` that share an id and their bytes are one file. Of files that
    share an id and differ none is kept: an error ``repeated_id`` stands for them.
    """
    many = segs.filter("broken is not null").groupBy("image_id").agg(F.count("*").alias("n"), F.count_distinct("file").alias("different")).filter("n > 1")
    if many.isEmpty():
        return segs, many.select("image_id"), False
    differ = many.filter("different > 1").select("image_id")
    return segs.join(differ, "image_id", "left_anti").dropDuplicates(["image_id", "ord"]), differ, True


def checked_segments(files: DataFrame) -> DataFrame:
    """Segments that matter for decoding, parsed and checked in one pass over the headers of ``files``.

    As ``drop_ignorable(segments(files))`` with ``quant, huffman``, the tables of a
    segment, and in its last row with ``broken``, all rules that the header breaks, and
    ``file``, a checksum of the bytes (of the path, where they are not read).
    ``files`` have ``content``, or ``path`` of files that are not read yet.
    """

    def rows(source):
        segs = []
        for order, marker, offset, length, payload, error in S.walk(source, S.IGNORED):
            good = error is None
            quant = list(S.split_quant(payload)) if good and marker == S.DQT else None
            huffman = list(S.split_huffman(payload)) if good and marker == S.DHT else None
            segs.append((order, marker, length, offset, payload, error, quant, huffman))
        broken = violations(segs)
        for i, (order, marker, length, offset, payload, error, quant, huffman) in enumerate(segs):
            last = i == len(segs) - 1
            yield order, marker, offset, length, payload, error, quant, huffman, *((broken, _checksum(source)) if last else (None, None))

    text, ints = pa.string(), pa.list_(pa.int32())
    tables = [
        ("quant", f"array<struct<{S.QUANT}>>", pa.list_(pa.struct([("place", pa.int32()), ("table_id", pa.int32()), ("scan", ints), ("error", text)]))),
        ("huffman", f"array<struct<{S.HUFFMAN}>>", pa.list_(pa.struct([("place", pa.int32()), ("table_class", pa.int32()), ("table_id", pa.int32()), ("counts", ints), ("symbols", ints), ("error", text)]))),
        ("broken", f"array<struct<{_ERROR}>>", pa.list_(pa.struct([("code", text), ("detail", text), ("ord", pa.int32()), ("step", pa.int32())]))),
    ]
    tables.append(("file", "bigint", pa.int64()))
    return S.mapped(files.select("image_id", "content" if "content" in files.columns else "path"), [*S.SEGMENT, *tables], rows)


def validate(segs: DataFrame) -> DataFrame:
    """``image_id, code, detail, ord, step`` of every rule that a header breaks (``segs``: ``checked_segments``).

    Entropy bytes are never read.
    """
    return segs.select("image_id", F.explode("broken").alias("x")).select("image_id", "x.*")


def scan_errors(intervals: DataFrame) -> DataFrame:
    """Violations in entropy data: a foreign marker, or no end of image."""
    return intervals.filter("error is not null").select("image_id", F.col("error").alias("code"), F.col("interval_no").cast("string").alias("detail"), F.lit(1_000_000).alias("ord"), F.lit(100).alias("step"))


def first_error(errors: DataFrame) -> DataFrame:
    """``image_id, code, detail`` of the first violation, where a reader would stop.

    An unknown marker alone does not stop a reader.
    """
    fatal = errors.filter("code <> 'unknown_marker'")
    return fatal.groupBy("image_id").agg(F.min_by(F.struct("code", "detail"), F.struct("ord", "step", "code", "detail")).alias("x")).select("image_id", "x.code", "x.detail")


def error_report(errors: DataFrame) -> DataFrame:
    """``code, images``: images by the violation at which a reader stops."""
    return first_error(errors).groupBy("code").agg(F.count("*").alias("images"))


def image_status(images: DataFrame, errors: DataFrame) -> DataFrame:
    """``images`` with ``valid`` and the first ``code`` and ``detail``."""
    return images.join(first_error(errors), "image_id", "left").withColumn("valid", F.col("code").isNull())


def valid_images(images: DataFrame, errors: DataFrame) -> DataFrame:
    """``images`` without a fatal violation."""
    return images.join(errors.filter("code <> 'unknown_marker'").select("image_id").distinct(), "image_id", "left_anti")
