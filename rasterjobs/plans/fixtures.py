"""Image tables derived from the given tables, for queries and tests (FIXTURES.md)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.arrays import ZIGZAG
from ..operators import segments as S
from ..sources.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.get(F.array(*(F.lit(x) for x in (".jpg", ".jpeg", ".x.jpg", ""))), (F.col("doc_id") % 4).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), path.alias("path"), F.col("n_chars").alias("length"), "source")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.col("n_chars"), F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("image_id"), (1 + n % 500).cast("int").alias("width"), (1 + (n * 7 + d) % 400).cast("int").alias("height"),
        F.when(d % 5 == 0, 1).otherwise(3).alias("num_components"), (1 + d % 2).cast("int").alias("h_samp"), (1 + F.floor(d / 2) % 2).cast("int").alias("v_samp"),
        F.concat(F.col("source"), F.lit("/"), d.cast("string")).alias("path"), n.alias("length"), "source",
    )


#: SQL of ``images``.
IMAGES_SQL = """SELECT doc_id AS image_id, (1 + n_chars % 500)::INT AS width, (1 + (n_chars * 7 + doc_id) % 400)::INT AS height,
  CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 3 END AS num_components, (1 + doc_id % 2)::INT AS h_samp, (1 + (doc_id // 2) % 2)::INT AS v_samp,
  source || '/' || doc_id AS path, n_chars AS length, source FROM documents"""


def _hex(x: Column, digits: int) -> Column:
    return F.lpad(F.hex(x.cast("bigint")), digits, "0")


def header_parts(img: DataFrame) -> DataFrame:
    """``soi, dqt, sof, dht, dri, sos`` of each image as hex text; the defects of bad headers are swapped in later."""
    steps = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: _hex(1 + (i + F.col("image_id")) % 200, 2)), "")
    n = F.col("num_components")
    chroma = F.when(n == 3, F.lit("021100031100")).otherwise("")
    sof = F.concat(F.lit("FFC0"), _hex(8 + 3 * n, 4), F.lit("08"), _hex(F.col("height"), 4), _hex(F.col("width"), 4), _hex(n, 2), F.lit("01"), _hex(F.col("h_samp") * 16 + F.col("v_samp"), 2), F.lit("00"), chroma)
    dht = F.lit("FFC4" + f"{2 + 2 * 17 + 4 + 4:04X}" + "00" + _counts_hex(2, 4) + "00010203" + "10" + _counts_hex(3, 4) + "00010211")
    sos = F.concat(F.lit("FFDA"), _hex(6 + 2 * n, 4), _hex(n, 2), F.lit("0100"), F.when(n == 3, F.lit("02000300")).otherwise(""), F.lit("003F00"))
    return img.select("*", F.lit("FFD8").alias("soi"), F.concat(F.lit("FFDB004300"), steps).alias("dqt"), sof.alias("sof"), dht.alias("dht"), F.concat(F.lit("FFDD0004"), _hex(F.col("image_id") % 7, 4), F.lit("FFDD0004"), _hex(F.col("image_id") % 11 + 1, 4)).alias("dri"), sos.alias("sos"))


def _counts_hex(length: int, n: int) -> str:
    """16 counts with ``n`` codes of one length."""
    return "".join(f"{n if k == length else 0:02X}" for k in range(1, 17))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header-only files: ``image_id, content``."""
    p = header_parts(images(spark, sf_dir))
    return p.select("image_id", F.unhex(F.concat("soi", "dqt", "sof", "dht", "dri", "sos", F.lit("FFD9"))).alias("content"))


def bad_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with one defect by ``image_id % 8``: none, start, precision, height, components, sampling, no table, cut."""
    p = header_parts(images(spark, sf_dir)).withColumn("k", F.col("image_id") % 8)
    sof = F.col("sof")
    sof = (
        F.when(F.col("k") == 2, F.overlay(sof, F.lit("0C"), 9)).when(F.col("k") == 3, F.overlay(sof, F.lit("0000"), 11))
        .when(F.col("k") == 4, F.overlay(sof, F.lit("04"), 19)).when(F.col("k") == 5, F.overlay(sof, F.lit("31"), 23)).otherwise(sof)
    )
    soi = F.when(F.col("k") == 1, "FFD9").otherwise(F.col("soi"))
    dqt = F.when(F.col("k") == 6, "").otherwise(F.col("dqt"))
    rest = F.when(F.col("k") == 7, F.lit("FFC4")).otherwise(F.concat("dht", "dri", "sos", F.lit("FFD9")))
    return p.select("image_id", F.unhex(F.concat(soi, dqt, sof, rest)).alias("content"))


def _put(part: str, at: int, digits: str) -> str:
    """SQL of a header part with hex digits replaced from place ``at`` on."""
    return f"overlay({part} PLACING '{digits}' FROM {at})"


def _longer(part: str) -> str:
    """SQL of a header part with a byte too many, which its length counts."""
    return f"substring({part}, 1, 4) || lpad(hex(1 + cast(conv(substring({part}, 5, 4), 16, 10) AS bigint)), 4, '0') || substring({part}, 9) || '00'"


#: Code of the violation at which a reader stops (none: it goes on), and the header parts that cause it, as SQL.
DEFECTS: list[tuple[str | None, dict[str, str]]] = [
    (None, {}), (None, {"soi": "'FFD8FFE00004ABCDFFFE0003AA'"}), (None, {"soi": "'FFD8FFC8'"}), (None, {"sof": _put("sof", 1, "FFC2"), "sos": _put("sos", 23, "000001")}),
    ("bad_soi", {"soi": "'FFD9'"}), ("expected_marker", {"soi": "'FFD800'"}), ("expected_marker", {"soi": "'FFD8FFC10002'"}),
    ("truncated", {"soi": "'FFD8FFE0FFFF'"}), ("truncated", {"sof": "'FFC000040800'"}), ("truncated", {"sos": "'FFDA00040301'"}),
    ("sos_before_sof", {"sof": "''"}), ("multiple_sof", {"sof": "sof || sof"}), ("bad_precision", {"sof": _put("sof", 9, "0C")}),
    ("bad_dimensions", {"sof": _put("sof", 11, "0000")}), ("bad_dimensions", {"sof": _put("sof", 15, "0000")}), ("cmyk", {"sof": _put("sof", 19, "04")}), ("no_components", {"sof": _put("sof", 19, "00")}),
    ("yiq", {"sof": _put("sof", 21, "04")}), ("bad_component_id", {"sof": _put("sof", 27, "09")}), ("dup_component", {"sof": _put("sof", 27, "01")}),
    ("bad_sampling", {"sof": _put("sof", 23, "31")}), ("bad_sampling", {"sof": _put("sof", 29, "21")}), ("bad_quant_ref", {"sof": _put("sof", 25, "07")}), ("bad_sof_length", {"sof": _longer("sof")}),
    ("bad_quant_id", {"dqt": _put("dqt", 9, "05")}), ("bad_dqt_length", {"dqt": f"'FFDB0010{'00' * 14}' || dqt"}),
    ("bad_huffman_id", {"dht": _put("dht", 9, "04")}), ("huffman_too_many", {"dht": _put("dht", 11, "C8")}), ("bad_dht_length", {"dht": "'FFC40005000000' || dht"}),
    ("bad_dri_length", {"dri": "'FFDD0005000100'"}), ("empty_scan", {"sos": _put("sos", 9, "00")}), ("bad_scan_component", {"sos": _put("sos", 11, "09")}), ("dup_scan_component", {"sos": _put("sos", 15, "01")}),
    ("bad_dc_table_id", {"sos": _put("sos", 13, "40")}), ("bad_ac_table_id", {"sos": _put("sos", 13, "04")}), ("unset_quant", {"dqt": "''"}), ("unset_dc", {"sos": _put("sos", 13, "10")}), ("unset_ac", {"sos": _put("sos", 13, "01")}),
    ("bad_spectral", {"sos": _put("sos", 25, "3E")}), ("bad_spectral", {"sof": _put("sof", 1, "FFC2"), "sos": _put("sos", 23, "013F")}),
    ("bad_approx", {"sos": _put("sos", 27, "01")}), ("bad_approx", {"sof": _put("sof", 1, "FFC2"), "sos": _put("sos", 23, "000031")}), ("bad_sos_length", {"sos": _longer("sos")}),
]


def defective_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour headers, each with the defect ``image_id % len(DEFECTS)``."""
    p = header_parts(images(spark, sf_dir).withColumn("num_components", F.lit(3))).withColumn("k", F.col("image_id") % len(DEFECTS))
    parts = []
    for name in ("soi", "dqt", "sof", "dht", "dri", "sos"):
        x = F.col(name)
        for k, (_, swaps) in enumerate(DEFECTS):
            x = F.when(F.col("k") == k, F.expr(swaps[name])).otherwise(x) if name in swaps else x
        parts.append(x)
    return p.select("image_id", F.unhex(F.concat(*parts, F.lit("FFD9"))).alias("content"))


def annotated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with ``image_id % 5`` application segments before the tables and a comment after them."""
    p = header_parts(images(spark, sf_dir))
    notes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i < F.col("image_id") % 5, F.concat(F.lit("FFE"), F.hex(i.cast("bigint")), F.lit("0004ABCD"))).otherwise("")), "")
    return p.select("image_id", F.unhex(F.concat("soi", notes, "dqt", "sof", "dht", F.lit("FFFE0003AA"), "dri", "sos", F.lit("FFD9"))).alias("content"))


def table_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with two DQT (8 and 16 bit, the first id again) and two DHT per document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"))
    i = F.col("image_id")

    def quant(k: int, digits: int) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: _hex(1 + (x * k + i) % 250, digits)), "")

    dqt1 = F.concat(F.lit("00"), quant(1, 2), F.lit("01"), quant(2, 2))
    dqt2 = F.concat(F.lit("10"), quant(3, 4))
    n = 1 + i % 3
    counts = F.concat(F.lit("00"), _hex(n, 2), _hex(n + 1, 2), F.lit("00" * 13))
    symbols = F.array_join(F.transform(F.sequence(F.lit(0), (2 * n).cast("int")), lambda x: _hex((x * 3 + i) % 250, 2)), "")
    dht1 = F.concat(F.lit("00" + _counts_hex(2, 3) + "010203" + "11" + _counts_hex(1, 1) + "05"))
    dht2 = F.concat(F.lit("00"), counts, symbols)
    parts = [(S.DQT, dqt1), (S.DQT, dqt2), (S.DHT, dht1), (S.DHT, dht2)]
    rows = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("ord"), F.lit(m).alias("marker"), F.unhex(x).alias("payload")) for k, (m, x) in enumerate(parts))))
    return d.select("image_id", rows.alias("x")).select("image_id", "x.*", F.lit(None).cast("string").alias("error"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as coefficient blocks, four in a row, an image per label."""
    w = W.partitionBy("label").orderBy("vec_id")
    coef = F.transform("embedding", lambda x: F.floor(x.cast("double") * 400).cast("smallint"))
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), (F.row_number().over(w) - 1).alias("n"), coef.alias("coef"))
    return e.select("image_id", F.lit(1).alias("component"), F.floor(F.col("n") / 4).cast("int").alias("du_row"), (F.col("n") % 4).cast("int").alias("du_col"), "coef")


BLOCKS_SQL = """SELECT label AS image_id, 1 AS component, (n // 4)::INT AS du_row, (n % 4)::INT AS du_col, coef FROM (
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, [floor(x::DOUBLE * 400)::INT for x in embedding] AS coef FROM embeddings)"""


def color_blocks(spark: SparkSession, sf_dir: str, h: int = 2, v: int = 2) -> DataFrame:
    """``blocks`` and chroma at the anchors, from the same vectors reversed and negated."""
    b = blocks(spark, sf_dir)
    at = b.filter((F.col("du_row") % v == 0) & (F.col("du_col") % h == 0))
    cb = at.withColumn("component", F.lit(2)).withColumn("coef", F.reverse("coef"))
    cr = at.withColumn("component", F.lit(3)).withColumn("coef", F.transform("coef", lambda x: (-x).cast("smallint")))
    return b.unionByName(cb).unionByName(cr)


def rgb_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shifted(k: int) -> Column:
        return F.transform("coef", lambda x: F.pmod(x.cast("int") + k, F.lit(256)).cast("smallint"))

    return blocks(spark, sf_dir).select("image_id", "du_row", "du_col", shifted(0).alias("r"), shifted(64).alias("g"), shifted(128).alias("b"))


def raster_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the images of ``blocks``: 29 wide, and 3 rows short of the last unit."""
    n = blocks(spark, sf_dir).groupBy("image_id").agg(F.max("du_row").alias("m"))
    return n.select("image_id", F.lit(29).alias("width"), (F.col("m") * 8 + 5).alias("height"))


RASTER_IMAGES_SQL = f"SELECT image_id, 29 AS width, max(du_row) * 8 + 5 AS height FROM ({BLOCKS_SQL}) GROUP BY image_id"


def ycc(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").select(*keys, (F.col("l_quantity").cast("int") * 5 - 128).alias("y"), (F.col("l_partkey") % 256 - 128).cast("int").alias("cb"), (F.col("l_suppkey") % 256 - 128).cast("int").alias("cr"))


# --------------------------------------------------------------------------
# Encoder of baseline files


class BitWriter:
    def __init__(self):
        self.value, self.n, self.whole = 0, 0, bytearray()

    def put(self, v: int, k: int) -> None:
        self.value, self.n = self.value << k | v & ((1 << k) - 1), self.n + k
        if self.n >= 512:  # whole bytes are put aside, or each bit would cost as much as all before it
            rest = self.n % 8
            self.whole += (self.value >> rest).to_bytes(self.n // 8, "big")
            self.value, self.n = self.value & ((1 << rest) - 1), rest

    def data(self) -> bytes:
        """The bits, filled up with ones, with zero bytes after FF."""
        pad = -self.n % 8
        last = (self.value << pad | (1 << pad) - 1).to_bytes((self.n + pad) // 8, "big") if self.n else b""
        return bytes(self.whole + last).replace(b"\xff", b"\xff\x00")


#: Flat tables: 12 DC symbols of four bits, 162 AC symbols (EOB, ZRL, run and size) of eight.
DC_SYMBOLS = list(range(12))
AC_SYMBOLS = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11)]
_AC_CODES = {s: code for code, s in enumerate(AC_SYMBOLS)}


def _magnitude(v: int) -> tuple[int, int]:
    k = abs(v).bit_length()
    return k, v if v >= 0 else v + (1 << k) - 1


def _unit(out: BitWriter, coef, before: int) -> int:
    """One data unit in row order; returns its DC."""
    scan = [int(coef[i]) for i in ZIGZAG]
    k, bits = _magnitude(scan[0] - before)
    out.put(DC_SYMBOLS.index(k), 4)
    out.put(bits, k)
    run = 0
    for v in scan[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            out.put(_AC_CODES[0xF0], 8)
            run -= 16
        k, bits = _magnitude(v)
        out.put(_AC_CODES[run << 4 | k], 8)
        out.put(bits, k)
        run = 0
    if run:
        out.put(_AC_CODES[0x00], 8)
    return scan[0]


def _segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(payload) + 2).to_bytes(2, "big") + payload


def encode(units: dict, width: int, height: int, *, h: int = 1, v: int = 1, restart: int = 0, quant=None, components: int = 3) -> bytes:
    """A baseline file; ``units`` maps (component, du_row, du_col) to 64 coefficients, missing ones are zero."""
    steps = [[1] * 64, [1] * 64] if quant is None else quant
    dqt = b"".join(bytes([i]) + bytes(int(q[z]) for z in ZIGZAG) for i, q in enumerate(steps))
    sampling = [h << 4 | v, 0x11, 0x11]
    sof = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([components]) + b"".join(bytes([c + 1, sampling[c], min(c, 1)]) for c in range(components))
    dht = bytes([0x00] + [12 if k == 4 else 0 for k in range(1, 17)] + DC_SYMBOLS + [0x10] + [162 if k == 8 else 0 for k in range(1, 17)] + AC_SYMBOLS)
    head = b"\xff\xd8" + _segment(S.DQT, dqt) + _segment(S.SOF0, sof) + _segment(S.DHT, dht)
    if restart:
        head += _segment(S.DRI, restart.to_bytes(2, "big"))
    sos = bytes([components]) + b"".join(bytes([c + 1, 0]) for c in range(components)) + b"\x00\x3f\x00"
    across, down = -(-width // 8), -(-height // 8)
    if components == 1:
        h = v = 1
    out, dc, mcu, body = BitWriter(), [0] * 4, 0, b""
    zero = [0] * 64
    for row in range(0, down, v):
        for col in range(0, across, h):
            if restart and mcu and mcu % restart == 0:
                body += out.data() + bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
                out, dc = BitWriter(), [0] * 4
            for c in range(1, components + 1):
                for y in range(v if c == 1 else 1):
                    for x in range(h if c == 1 else 1):
                        dc[c] = _unit(out, units.get((c, row + y, col + x), zero), dc[c])
            mcu += 1
    return head + _segment(S.SOS, sos) + body + out.data() + b"\xff\xd9"


def jpegs(spark: SparkSession, sf_dir: str, *, restart: int = 4, color: bool = True, h: int = 2, v: int = 2, down: int = 8) -> DataFrame:
    """``image_id, content``: a file for each ``down`` rows of units of every label, so files grow in number, not in size. Written down, as files are read more than once."""
    b = color_blocks(spark, sf_dir, h, v) if color else blocks(spark, sf_dir)
    part = F.floor(F.col("du_row") / down).cast("int")
    b = b.select((F.col("image_id").cast("bigint") * 1_000_000 + part).alias("image_id"), "component", (F.col("du_row") - part * down).alias("du_row"), "du_col", "coef")

    def write(key, group: pa.Table) -> pa.Table:
        units = dict(zip(zip(*(group.column(c).to_pylist() for c in ("component", "du_row", "du_col")), strict=True), group.column("coef").to_pylist(), strict=True))
        rows = max(r for _, r, _ in units) + 1
        quant = [[1 + (i + t) % 24 for i in range(64)] for t in range(2)]
        data = encode(units, 32, rows * 8, h=h, v=v, restart=restart, quant=quant, components=3 if color else 1)
        return pa.table({"image_id": [key[0].as_py()], "content": [data]})

    b = b.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")  # the planner would put few bytes into few tasks
    return stage(b.groupBy("image_id").applyInArrow(lambda key, group: write(key, group), "image_id bigint, content binary"), "jpegs")


#: Why the entropy data of a file can't be decoded; none: it can.
FAILURES = [None, "bad_dc_symbol", "bad_ac_symbol", "exhausted", "zero_run", "marker_in_scan", "truncated", "dc_length", "ac_length"]


def broken_jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray files; label and part name one of ``FAILURES``, for which data or a table is swapped."""
    plain = encode({}, 8, 8, quant=[[1] * 64] * 2, components=1)
    sos = plain.index(bytes([0xFF, S.SOS]))
    start = sos + 2 + int.from_bytes(plain[sos + 2 : sos + 4], "big")
    dc = plain.index(bytes([0xFF, S.DHT])) + 4 + 17  # the first symbol of each table
    ac = dc + len(DC_SYMBOLS) + 17
    i = F.col("image_id")
    k = (F.floor(i / 1_000_000) + i % 1_000_000) % len(FAILURES)
    x = F.hex("content")
    head, body = F.substring(x, 1, 2 * start), F.substring(x, 2 * start + 1, 1 << 30)
    ones, zeros = "C0" * 64, "00" * 64
    content = (
        F.when(k == 1, F.concat(head, F.lit(ones + "FFD9"))).when(k == 2, F.concat(head, F.lit("0F5" + "0" * 125 + "FFD9"))).when(k == 3, F.concat(head, F.lit("FFD9")))
        .when(k == 4, F.concat(head, F.lit("0" + "01" * 4 + "0" * 119 + "FFD9"))).when(k == 5, F.concat(head, F.substring(body, 1, F.length(body) - 4), F.lit("FFDAFFD9")))
        .when(k == 6, F.substring(x, 1, F.length(x) - 4)).when(k == 7, F.concat(F.overlay(head, F.lit("0C"), 2 * dc + 1), F.lit(zeros + "FFD9")))
        .when(k == 8, F.concat(F.overlay(head, F.lit("0B"), 2 * ac + 1), F.lit(zeros + "FFD9"))).otherwise(x)
    )
    return jpegs(spark, sf_dir, restart=0, color=False).select("image_id", F.unhex(content).alias("content"))


# --------------------------------------------------------------------------
# Encoder of progressive files with one scan

#: Runs of ends of band, ZRL, and run and size, in eight bits each.
BAND_SYMBOLS = [r << 4 for r in range(15)] + [0xF0] + [r << 4 | s for r in range(16) for s in range(1, 10)]
#: ``ss, se, ah, al`` of the scan kinds: DC first, DC refined, AC first, AC refined.
SCANS = [(0, 0, 0, 1), (0, 0, 1, 0), (1, 63, 0, 1), (1, 63, 2, 1)]
#: Least size of the coefficients that a refining AC scan makes known.
STRONG = 100


def _bands(out: BitWriter, units: list[list[int]], refine: bool) -> None:
    """AC values of units in scan order; units without further values are counted and follow as runs."""
    ends = 0

    def flush() -> None:
        nonlocal ends
        if ends:
            k = ends.bit_length() - 1
            out.put(BAND_SYMBOLS.index(k << 4), 8)
            out.put(ends - (1 << k), k)
            ends = 0

    for values in units:
        run = 0
        for v in values:
            if not v:
                run += 1
                continue
            flush()
            while run > 15:
                out.put(BAND_SYMBOLS.index(0xF0), 8)
                run -= 16
            k, bits = _magnitude(v)
            out.put(BAND_SYMBOLS.index(run << 4 | k), 8)
            out.put(int(v > 0) if refine else bits, k)
            run = 0
        ends += run > 0
    flush()


def progressive(units: list, width: int, height: int, scan: tuple[int, int, int, int]) -> bytes:
    """A gray file with one progressive scan of ``units`` (64 coefficients each, in the order of the image)."""
    ss, se, ah, al = scan
    rows = [[int(u[i]) for i in ZIGZAG] for u in units]
    out, before = BitWriter(), 0
    if ss:
        cut = (lambda v: (v > 0) - (v < 0) if abs(v) >= STRONG else 0) if ah else (lambda v: abs(v) // (1 << al) * (1 if v > 0 else -1))
        _bands(out, [[cut(v) for v in r[ss : se + 1]] for r in rows], ah > 0)
    for dc in (r[0] >> al for r in rows if not ss):
        if ah:
            out.put(dc & 1, 1)
            continue
        k, bits = _magnitude(dc - before)
        out.put(DC_SYMBOLS.index(k), 4)
        out.put(bits, k)
        before = dc
    sof = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    dht = bytes([0x00] + [12 if k == 4 else 0 for k in range(1, 17)] + DC_SYMBOLS + [0x10] + [160 if k == 8 else 0 for k in range(1, 17)] + BAND_SYMBOLS)
    head = b"\xff\xd8" + _segment(S.DQT, bytes([0] + [1] * 64)) + _segment(S.SOF2, sof) + _segment(S.DHT, dht)
    return head + _segment(S.SOS, bytes([1, 1, 0, ss, se, ah << 4 | al])) + out.data() + b"\xff\xd9"


def progressive_jpegs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, content``: files as in ``jpegs``, gray; label and part name the kind of scan."""
    part = F.floor(F.col("du_row") / 8).cast("int")
    b = blocks(spark, sf_dir).select((F.col("image_id").cast("bigint") * 1_000_000 + part).alias("image_id"), (F.col("du_row") - part * 8).alias("du_row"), "du_col", "coef")

    def write(key, group: pa.Table) -> pa.Table:
        i = key[0].as_py()
        known = dict(zip(zip(group.column("du_row").to_pylist(), group.column("du_col").to_pylist(), strict=True), group.column("coef").to_pylist(), strict=True))
        rows = max(r for r, _ in known) + 1
        units = [known.get((r, c), [0] * 64) for r in range(rows) for c in range(4)]
        return pa.table({"image_id": [i], "content": [progressive(units, 32, rows * 8, SCANS[(i // 1_000_000 + i % 1_000_000) % len(SCANS)])]})

    return b.groupBy("image_id").applyInArrow(lambda key, group: write(key, group), "image_id bigint, content binary")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("bigint").alias("seconds"))
