"""Queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays as A
from .operators import batches, coefficients, raster, segments, transform, validate
from .plans import fixtures as X
from .plans.decode import decode, triage
from .sources import files, sink
from .sources.staging import shared_dir
from .streaming.decode import stream_decode

SLOTS = 40


def _text(arr: Column) -> Column:
    return F.array_join(arr, ",")


# --------------------------------------------------------------------------
# Files and batches


def order_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files in the order of the sort, each with its place in it."""
    rows = files.order_by_size(X.files(spark, sf_dir)).withColumn("at", F.monotonically_increasing_id())
    return files.numbered(rows, "at").select("image_id", "length", F.col("place"))


def size_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.size_rank(X.files(spark, sf_dir), ["source"]).select("image_id", "source", "length", "size_rank")


FILES_SQL = "SELECT doc_id AS image_id, source || '/' || doc_id || ['.jpg', '.jpeg', '.x.jpg', ''][1 + doc_id % 4] AS path, n_chars AS length, source FROM documents"
OUT_SQL = r"regexp_replace(path, '\.[^./]*$', '') || '.bmp'"


def output_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.files(spark, sf_dir).select("image_id", files.output_path(F.col("path")).alias("out_path"))


def output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host and directory as files, so that many share an output name."""
    p = X.table(spark, sf_dir, "pages").select(F.concat(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), (F.col("page_id") % 7).cast("string"), F.when(F.col("page_id") % 2 == 0, ".jpg").otherwise(".jpeg")).alias("path"))
    return files.output_collisions(p)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.work_units(batches.grid(X.images(spark, sf_dir)))


UNITS_SQL = f"""SELECT *, ((du_width_pad + du_width_pad % 2) * (du_height_pad + du_height_pad % 2) + 99) // 100 AS units FROM (
  SELECT *, CASE WHEN h_samp = 2 THEN du_width + du_width % 2 ELSE du_width END AS du_width_pad, CASE WHEN v_samp = 2 THEN du_height + du_height % 2 ELSE du_height END AS du_height_pad
  FROM (SELECT *, (width + 7) // 8 AS du_width, (height + 7) // 8 AS du_height FROM ({X.IMAGES_SQL})))"""


def grid_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, errors = batches.reject_oversized(_units(spark, sf_dir), 20)
    cols = ["image_id", "du_width", "du_height", "du_width_pad", "du_height_pad", "units"]
    return fits.select(*cols, F.lit(None).cast("string").alias("code")).unionByName(_units(spark, sf_dir).join(errors.select("image_id", "code"), "image_id").select(*cols, "code"))


def pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits, _ = batches.reject_oversized(_units(spark, sf_dir), SLOTS)
    return batches.pack_batches(fits, SLOTS, ["source"]).select("source", "image_id", "units", "batch_id")


PACK_SQL = f"""WITH RECURSIVE u AS (SELECT source, image_id, units, row_number() OVER (PARTITION BY source ORDER BY length, path) AS k FROM ({UNITS_SQL}) WHERE units <= {SLOTS}),
r AS (
  SELECT source, image_id, units, k, 0 AS batch_id, {SLOTS} - units AS free FROM u WHERE k = 1
  UNION ALL
  SELECT u.source, u.image_id, u.units, u.k, r.batch_id + (u.units > r.free)::INT, CASE WHEN u.units > r.free THEN {SLOTS} ELSE r.free END - u.units FROM r JOIN u ON u.source = r.source AND u.k = r.k + 1)
SELECT source, image_id, units, batch_id FROM r"""


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.batch_report(pack_batches(spark, sf_dir), SLOTS, ["source"])


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.run_report(X.metrics(spark, sf_dir))


RUN_SQL = """SELECT stage, count(*) AS calls, sum(s)::BIGINT AS total, min(s) AS least, max(s) AS most, list_sort(list(s))[1 + (count(*) // 2)::INT] AS median
FROM (SELECT event_type AS stage, round(value * 100)::BIGINT AS s FROM events) GROUP BY stage"""


# --------------------------------------------------------------------------
# Headers


def frame_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.frame_header(segments.segments(X.headers(spark, sf_dir))).select("image_id", "frame_type", "precision", "height", "width", "num_components", "zero_based")


def frame_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.frame_components(segments.segments(X.headers(spark, sf_dir))).select("image_id", "component", "h", "v", "quant_id")


def scan_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = segments.segments(X.headers(spark, sf_dir))
    h = segments.scan_header(segs).select("image_id", "components_in_scan", "ss", "se", "ah", "al")
    return h.join(segments.scan_components(segs).select("image_id", "scan_id", "dc_id", "ac_id"), "image_id")


def restart_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.restart_interval(segments.segments(X.headers(spark, sf_dir)))


def quant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.quant_tables(X.table_segments(spark, sf_dir)).select("image_id", "table_id", _text(F.col("q")).alias("q"))


_SCAN_OF = "[" + ", ".join(map(str, A.UNZIGZAG)) + "]"
QUANT_SQL = f"""SELECT doc_id AS image_id, t AS table_id, array_to_string([1 + (p * (CASE t WHEN 0 THEN 3 ELSE 2 END) + doc_id) % 250 for p in {_SCAN_OF}], ',') AS q
FROM documents, (SELECT unnest([0, 1]) AS t)"""


def huffman_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = segments.huffman_tables(X.table_segments(spark, sf_dir))
    return t.select("image_id", "table_class", "table_id", _text(F.col("counts")).alias("counts"), _text(F.col("symbols")).alias("symbols"))


HUFF_SQL = """SELECT doc_id AS image_id, 0 AS table_class, 0 AS table_id, array_to_string([0, n, n + 1] || [0 for i in range(13)], ',') AS counts,
  array_to_string([(x * 3 + doc_id) % 250 for x in range(2 * n + 1)], ',') AS symbols FROM (SELECT doc_id, 1 + doc_id % 3 AS n FROM documents)
UNION ALL SELECT doc_id, 1, 1, array_to_string([1] || [0 for i in range(15)], ','), '5' FROM documents"""


def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.canonical_codes(segments.huffman_tables(X.table_segments(spark, sf_dir)))


CODES_SQL = """WITH d AS (SELECT doc_id, 1 + doc_id % 3 AS n FROM documents)
SELECT doc_id AS image_id, 0 AS table_class, 0 AS table_id, i AS idx, (i * 3 + doc_id) % 250 AS symbol, CASE WHEN i < n THEN 2 ELSE 3 END AS code_len,
  CASE WHEN i < n THEN i ELSE 2 * n + i - n END AS code FROM (SELECT doc_id, n, unnest(range(2 * n + 1)) AS i FROM d)
UNION ALL SELECT doc_id, 1, 1, 0, 5, 1, 0 FROM d"""


def image_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage(X.bad_headers(spark, sf_dir)).images.select("image_id", "valid", "code")


_CODE = "['bad_soi', 'bad_precision', 'bad_dimensions', 'cmyk', 'bad_sampling', 'unset_quant', 'truncated']"
STATUS_SQL = f"SELECT doc_id AS image_id, doc_id % 8 = 0 AS valid, {_CODE}[doc_id % 8] AS code FROM documents"


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage(X.bad_headers(spark, sf_dir)).report


REPORT_SQL = f"SELECT code, count(*) AS images FROM ({STATUS_SQL}) WHERE NOT valid GROUP BY code"


def valid_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triage(X.bad_headers(spark, sf_dir))
    return validate.valid_images(t.headers, t.errors).select("image_id", "width", "height", "du_width_pad", "du_height_pad")


VALID_SQL = f"""SELECT image_id, width, height, CASE WHEN num_components = 3 THEN du_width_pad ELSE du_width END AS du_width_pad,
  CASE WHEN num_components = 3 THEN du_height_pad ELSE du_height END AS du_height_pad FROM ({UNITS_SQL}) WHERE image_id % 8 = 0"""


def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on headers that break each rule in turn."""
    return triage(X.defective_headers(spark, sf_dir)).images.select("image_id", "valid", "code")


def _pick_sql(values: list[str | None], k: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][1 + {k}]"


RULES_SQL = f"""SELECT image_id, code IS NULL AS valid, code FROM (
  SELECT doc_id AS image_id, {_pick_sql([c for c, _ in X.DEFECTS], f"doc_id % {len(X.DEFECTS)}")} AS code FROM documents)"""


def drop_ignorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that are left in each header, and the place of the first."""
    segs = segments.drop_ignorable(segments.segments(X.annotated_headers(spark, sf_dir)))
    rows = segs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.hex("marker").alias("marker")))).alias("x"))  # a header has few segments
    return rows.select("image_id", F.array_join(F.col("x.marker"), ",").alias("markers"), F.get("x", 0)["ord"].alias("place"))


KEPT_SQL = "SELECT doc_id AS image_id, 'DB,C0,C4,DD,DD,DA' AS markers, (1 + doc_id % 5)::INT AS place FROM documents"


# --------------------------------------------------------------------------
# Coefficients

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def dc_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "lineitem").select(*_KEYS, F.col("l_suppkey").alias("image_id"), (F.col("l_linenumber") % 3).alias("component"), (F.col("l_partkey") % 4).alias("interval_no"), (F.col("l_quantity").cast("int") - 25).alias("dc_diff"))
    return coefficients.dc_predict(d, *_KEYS).select(*_KEYS, "dc")


DC_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity::INT - 25) OVER (PARTITION BY l_suppkey, l_linenumber % 3, l_partkey % 4
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS dc FROM lineitem"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (1 + F.col("l_suppkey") % 8).cast("int")
    return X.table(spark, sf_dir, "lineitem").select(*_KEYS, F.col("l_orderkey").alias("unit_id"), (F.col("l_partkey") % 4).cast("int").alias("run"), size.alias("size"), (F.col("l_partkey") % F.pow(F.lit(2), size).cast("bigint")).cast("int").alias("bits"))


def ac_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficients.ac_positions(_tokens(spark, sf_dir), *_KEYS).select(*_KEYS, "position")


AC_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_partkey % 4 + 1) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS position FROM lineitem"""


def extend_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select(*_KEYS, A.extend_sign(F.col("bits"), F.col("size")).alias("value"))


SIGN_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN bits < (1 << (size - 1)) THEN bits - (1 << size) + 1 ELSE bits END)::INT AS value
FROM (SELECT *, (1 + l_suppkey % 8)::INT AS size, (l_partkey % (1 << (1 + l_suppkey % 8)::INT))::INT AS bits FROM lineitem)"""


def dezigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", _text(A.dezigzag(F.transform("embedding", lambda x: F.floor(x.cast("double") * 400).cast("int")))).alias("row_order"))


ZIGZAG_SQL = f"SELECT vec_id, array_to_string([floor(embedding[p + 1]::DOUBLE * 400)::INT for p in {_SCAN_OF}], ',') AS row_order FROM embeddings"


def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of a vector as tokens, in a mixed order, put back at their places."""
    e = X.table(spark, sf_dir, "embeddings")
    pos = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((5 * i + F.col("vec_id")) % 64).cast("int"))
    val = F.transform(pos, lambda p: F.floor(F.get("embedding", p).cast("double") * 400).cast("int"))
    return e.select("vec_id", _text(A.densify(pos, val)).alias("dense"))


DENSE_SQL = "SELECT vec_id, array_to_string([floor(embedding[i + 1]::DOUBLE * 400)::INT for i in range(64)], ',') AS dense FROM embeddings"


def _quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.blocks(spark, sf_dir)
    ids = b.select("image_id").distinct()
    tables = ids.select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("table_id")).withColumn("q", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (1 + (i + F.col("image_id") * 3 + F.col("table_id")) % 24).cast("int")))
    parts = ids.select("image_id", F.lit(1).alias("component"), (F.col("image_id") % 2).alias("quant_id"))
    return transform.with_quant(b, parts, tables)


def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantized(spark, sf_dir).select("image_id", "du_row", "du_col", _text(A.dequantize(F.col("coef"), F.col("q"))).alias("coef"))


DEQUANT_SQL = f"""SELECT image_id, du_row, du_col, [(((coef[i + 1] * (1 + (i + image_id * 3 + image_id % 2) % 24) + 32768) & 65535) - 32768)::INT for i in range(64)] AS coef FROM ({X.BLOCKS_SQL})"""


def idct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.samples(_quantized(spark, sf_dir)).select("image_id", "du_row", "du_col", _text(F.col("sample")).alias("sample"))


def _pass_sql(source: str, key: str) -> str:
    """SQL of one pass over rows ``key, x`` (8 values), by the arithmetic of ``transform``."""
    s = ", ".join(f"(x[{i + 1}] * {f}) >> {k} AS s{i}" for i, (f, k) in enumerate(transform.INPUT))

    def times(x: str, f: tuple[int, int]) -> str:
        return f"((({x}) * {f[0]}) >> {f[1]})"

    a = f"SELECT {key}, {s} FROM {source}"
    b = f"SELECT {key}, s0 + s4 AS top, s0 - s4 AS low, s2 + s6 AS p26, {times('s2 - s6', transform.HALF)} - s2 - s6 AS m26, s1 + s7 + s5 + s3 AS total, {times('s5 - s3 + s1 - s7', transform.BOTH)} AS turn, {times('s1 + s7 - s5 - s3', transform.HALF)} + s1 + s7 + s5 + s3 AS across, {times('s1 - s7', transform.COSINE)} AS c17, {times('s5 - s3', transform.SINE)} AS s53 FROM ({a})"
    c = f"SELECT {key}, [top + p26, low + m26, low - m26, top - p26] AS e, total, c17 - turn AS steep, across - c17 + turn AS third, s53 + turn AS rise FROM ({b})"
    d = f"SELECT {key}, e, [total, steep - total, third, rise - third] AS o FROM ({c})"
    values = "[e[i] + o[i] for i in range(1, 5)] || [e[5 - i] - o[5 - i] for i in range(1, 5)]"
    return f"SELECT {key}, [((((v >> {transform.OUTPUT_SHIFT}) + 32768) & 65535) - 32768)::INT for v in {values}] AS x FROM ({d})"


def _turned(source: str) -> str:
    """Columns of the rows of ``source`` (image_id, du_row, du_col, i, x) as new rows."""
    return f"SELECT image_id, du_row, du_col, j AS i, list(v ORDER BY i) AS x FROM (SELECT image_id, du_row, du_col, i, unnest(x) AS v, unnest(range(8)) AS j FROM ({source})) GROUP BY image_id, du_row, du_col, j"


_KEY = "image_id, du_row, du_col, i"
#: The inverse transform of ``b`` (image_id, du_row, du_col, coef) as rows ``w``.
IDCT_WITH = f"""r AS MATERIALIZED (SELECT image_id, du_row, du_col, i, coef[8 * i + 1 : 8 * i + 8] AS x FROM b, (SELECT unnest(range(8)) AS i)),
h AS MATERIALIZED ({_turned(_pass_sql("r", _KEY))}), w AS MATERIALIZED ({_turned(_pass_sql("h", _KEY))})"""
IDCT_SQL = f"""WITH b AS MATERIALIZED ({DEQUANT_SQL}), {IDCT_WITH}
SELECT image_id, du_row, du_col, array_to_string(flatten(list(x ORDER BY i)), ',') AS sample FROM w GROUP BY image_id, du_row, du_col"""
DEQUANT_TEXT_SQL = f"SELECT image_id, du_row, du_col, array_to_string(coef, ',') AS coef FROM ({DEQUANT_SQL})"


def ycc_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, cb, cr = (F.col(c) for c in ("y", "cb", "cr"))
    return X.ycc(spark, sf_dir).select(*_KEYS, A.red(y, cb, cr).alias("r"), A.green(y, cb, cr).alias("g"), A.blue(y, cb, cr).alias("b"))


def _scaled_sql(factor: int, x: str) -> str:
    return f"(({factor} * {x}) >> {A.SHIFT})"


RGB_COLUMNS = f"""greatest(0, least(255, y + {_scaled_sql(A.RED_CR, 'cr')} + 128)) AS r,
  greatest(0, least(255, y - {_scaled_sql(A.GREEN_CB, 'cb')} - {_scaled_sql(A.GREEN_CR, 'cr')} + 128)) AS g, greatest(0, least(255, y + {_scaled_sql(A.BLUE_CB, 'cb')} + 128)) AS b"""
RGB_SQL = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {RGB_COLUMNS}
FROM (SELECT *, l_quantity::BIGINT * 5 - 128 AS y, l_partkey % 256 - 128 AS cb, l_suppkey % 256 - 128 AS cr FROM lineitem)"""


def _sampled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.blocks(spark, sf_dir).select("image_id").distinct().select("image_id", F.lit(2).alias("h_samp"), (1 + F.col("image_id") % 2).alias("v_samp"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.color_blocks(spark, sf_dir, 2, 1).filter("component = 1 or du_row % (1 + image_id % 2) = 0")
    return transform.pair_chroma(b, _sampled_images(spark, sf_dir), "coef")


def pair_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("image_id", "du_row", "du_col", _text(F.col("y")).alias("y"), _text(F.col("cb")).alias("cb"), _text(F.col("cr")).alias("cr"))


PAIR_BASE = f"""WITH b AS MATERIALIZED ({X.BLOCKS_SQL})
SELECT y.image_id, y.du_row, y.du_col, y.coef AS y, list_reverse(c.coef) AS cb, [-x for x in c.coef] AS cr, 1 + y.image_id % 2 AS v
FROM b y JOIN b c ON c.image_id = y.image_id AND c.du_col = y.du_col - y.du_col % 2 AND c.du_row = y.du_row - y.du_row % (1 + y.image_id % 2)"""
PAIR_SQL = f"SELECT image_id, du_row, du_col, array_to_string(y, ',') AS y, array_to_string(cb, ',') AS cb, array_to_string(cr, ',') AS cr FROM ({PAIR_BASE})"


def upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = A.upsample(F.col("cb"), F.col("du_row"), F.col("du_col"), F.col("h"), F.col("v"))
    return _pairs(spark, sf_dir).select("image_id", "du_row", "du_col", _text(up).alias("cb"))


UPSAMPLE_SQL = f"SELECT image_id, du_row, du_col, array_to_string([cb[(1 + 8 * ((p // 8) // v + 4 * (du_row % v)) + (p % 8) // 2 + 4 * (du_col % 2))::INT] for p in range(64)], ',') AS cb FROM ({PAIR_BASE})"


def _plan_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    img = batches.grid(X.images(spark, sf_dir).withColumn("h_samp", F.when(F.col("num_components") == 1, 1).otherwise(F.col("h_samp"))).withColumn("v_samp", F.when(F.col("num_components") == 1, 1).otherwise(F.col("v_samp"))))
    img = img.withColumn("restart_interval", (F.col("image_id") % 4).cast("int"))
    parts = img.select("image_id", F.explode(F.sequence(F.lit(1), F.col("num_components"))).alias("component")).withColumn("place", F.col("component") - 1)
    return img, parts


def scan_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every image, summed up by component and restart interval."""
    plan = coefficients.scan_plan(*_plan_images(spark, sf_dir))
    check = F.sum(F.col("seq") * (F.col("du_row") * 101 + F.col("du_col"))).cast("bigint")
    return plan.groupBy("image_id", "component", "interval_no").agg(F.count("*").alias("units"), check.alias("check"))


PLAN_SQL = f"""WITH i AS (SELECT image_id, num_components AS n, h, v, (width + 7) // 8 AS w8, (height + 7) // 8 AS h8, (image_id % 4)::INT AS gap FROM (
    SELECT *, CASE WHEN num_components = 1 THEN 1 ELSE h_samp END AS h, CASE WHEN num_components = 1 THEN 1 ELSE v_samp END AS v FROM ({X.IMAGES_SQL}))),
m AS (SELECT *, (w8 + h - 1) // h AS across, (h8 + v - 1) // v AS down, CASE WHEN n = 3 THEN h * v + 2 ELSE 1 END AS per FROM i),
u AS (SELECT *, unnest(range(across * down * per)) AS seq FROM m),
k AS (SELECT *, seq // per AS mcu, seq % per AS k FROM u),
c AS (SELECT *, CASE WHEN k < h * v THEN 1 ELSE 2 + k - h * v END AS component FROM k)
SELECT image_id, component, CASE WHEN gap > 0 THEN mcu // greatest(gap, 1) ELSE 0 END AS interval_no, count(*) AS units,
  sum(seq * (((mcu // across) * v + CASE WHEN component = 1 THEN k // h ELSE 0 END) * 101 + (mcu % across) * h + CASE WHEN component = 1 THEN k % h ELSE 0 END))::BIGINT AS "check"
FROM c GROUP BY ALL"""


def tile_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.blocks(spark, sf_dir).withColumn("du_width", F.lit(4))
    return coefficients.tile_address(b).select("image_id", "du_row", "du_col", "tile_row", "tile_col", "tile_pos", "tile_index")


TILE_SQL = f"SELECT image_id, du_row, du_col, du_row // 2 AS tile_row, du_col // 2 AS tile_col, du_row % 2 * 2 + du_col % 2 AS tile_pos, du_row // 2 * 2 + du_col // 2 AS tile_index FROM ({X.BLOCKS_SQL})"


def entropy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of encoded files, of the units that the table has."""
    blocks = decode(X.jpegs(spark, sf_dir, color=False)).coefficients
    row = F.col("du_row") + (F.col("image_id") % 1_000_000) * 8
    return blocks.select(F.floor(F.col("image_id") / 1_000_000).alias("image_id"), row.alias("du_row"), "du_col", _text(F.col("coef")).alias("coef"))


ROUND_SQL = f"""WITH b AS ({X.BLOCKS_SQL}), g AS (SELECT image_id, unnest(range(max(du_row) + 1)) AS du_row FROM b GROUP BY image_id)
SELECT image_id, du_row, du_col, coalesce(array_to_string(coef, ','), array_to_string([0 for i in range(64)], ',')) AS coef
FROM (SELECT image_id, du_row, unnest(range(4)) AS du_col FROM g) LEFT JOIN b USING (image_id, du_row, du_col)"""


def unmarked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of colour files without restart markers, each decoded in chunks of 256 bytes."""
    blocks = decode(X.jpegs(spark, sf_dir, restart=0, down=64), chunk_bytes=256).coefficients
    return blocks.select("image_id", "component", "du_row", "du_col", _text(F.col("coef")).alias("coef"))


#: Files of up to 64 rows of units, as wide as four; rows and columns are even, as the sampling is 2 x 2.
UNMARKED_SQL = f"""WITH f AS MATERIALIZED (SELECT image_id::BIGINT * 1000000 + du_row // 64 AS image_id, du_row % 64 AS du_row, du_col, coef FROM ({X.BLOCKS_SQL})),
g AS (SELECT image_id, du_row, unnest(range(4)) AS du_col FROM (SELECT image_id, unnest(range(down + down % 2)) AS du_row FROM (SELECT image_id, max(du_row) + 1 AS down FROM f GROUP BY image_id))),
k AS MATERIALIZED (SELECT image_id, du_row, du_col, coalesce(coef, [0 for i in range(64)]) AS coef FROM g LEFT JOIN f USING (image_id, du_row, du_col))
SELECT image_id, c AS component, du_row::INT AS du_row, du_col::INT AS du_col, array_to_string(CASE c WHEN 1 THEN coef WHEN 2 THEN list_reverse(coef) ELSE [-x for x in coef] END, ',') AS coef
FROM k, (SELECT unnest([1, 2, 3]) AS c) WHERE c = 1 OR du_row % 2 = 0 AND du_col % 2 = 0"""


def decode_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why files with broken entropy data can't be decoded."""
    broken = X.broken_jpegs(spark, sf_dir)
    return validate.image_status(broken.select("image_id"), decode(broken).errors).select("image_id", "valid", "code")


FAILURES_SQL = f"""SELECT image_id, code IS NULL AS valid, code FROM (
  SELECT DISTINCT image_id::BIGINT * 1000000 + du_row // 8 AS image_id, {_pick_sql(X.FAILURES, f"(image_id + du_row // 8) % {len(X.FAILURES)}")} AS code FROM ({X.BLOCKS_SQL}))"""


def progressive_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients that whole progressive files hold, each with one scan of one of four kinds."""
    blocks = decode(X.progressive_jpegs(spark, sf_dir)).coefficients
    return blocks.select("image_id", "du_row", "du_col", _text(F.col("coef")).alias("coef"))


SCANS_SQL = f"""WITH f AS (SELECT image_id::BIGINT * 1000000 + du_row // 8 AS image_id, (image_id + du_row // 8) % 4 AS k, du_row % 8 AS du_row, du_col, coef FROM ({X.BLOCKS_SQL})),
g AS (SELECT image_id, k, du_row, unnest(range(4)) AS du_col FROM (SELECT image_id, k, unnest(range(max(du_row) + 1)) AS du_row FROM f GROUP BY image_id, k))
SELECT image_id, du_row::INT AS du_row, du_col::INT AS du_col, array_to_string(CASE k
  WHEN 0 THEN [CASE WHEN i = 1 THEN (c[1] >> 1) * 2 ELSE 0 END for i in range(1, 65)] WHEN 1 THEN [CASE WHEN i = 1 THEN c[1] & 1 ELSE 0 END for i in range(1, 65)]
  WHEN 2 THEN [CASE WHEN i = 1 THEN 0 ELSE sign(c[i])::INT * (abs(c[i]) // 2) * 2 END for i in range(1, 65)]
  ELSE [CASE WHEN i = 1 OR abs(c[i]) < {X.STRONG} THEN 0 ELSE sign(c[i])::INT * 2 END for i in range(1, 65)] END, ',') AS coef
FROM (SELECT image_id, k, du_row, du_col, coalesce(coef, [0 for i in range(64)]) AS c FROM g LEFT JOIN f USING (image_id, k, du_row, du_col))"""


# --------------------------------------------------------------------------
# Pixels


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixels(X.rgb_blocks(spark, sf_dir), X.raster_images(spark, sf_dir))


def _mod_sql(k: int) -> str:
    return f"((coef[p + 1] + {k}) % 256 + 256) % 256"


PIXEL_BASE = f"""SELECT image_id, du_col * 8 + p % 8 AS x, du_row * 8 + p // 8 AS y, {_mod_sql(0)} AS r, {_mod_sql(64)} AS g, {_mod_sql(128)} AS b, width, height
FROM ({X.BLOCKS_SQL}) JOIN ({X.RASTER_IMAGES_SQL}) USING (image_id), (SELECT unnest(range(64)) AS p)"""
PIXEL_SQL = f"SELECT image_id, x, y, r, g, b FROM ({PIXEL_BASE}) WHERE x < width AND y < height"
ROWS_BASE = f"SELECT image_id, y, any_value(width) AS width, any_value(height) AS height, string_agg(printf('%02X%02X%02X', b, g, r), '' ORDER BY x) || repeat('00', (any_value(width) % 4)::INT) AS hex FROM ({PIXEL_BASE}) WHERE x < width AND y < height GROUP BY image_id, y"


def raster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.raster_rows(X.rgb_blocks(spark, sf_dir), X.raster_images(spark, sf_dir)).select("image_id", "y", F.hex("bytes").alias("hex"))


def to_bmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    img = X.raster_images(spark, sf_dir)
    return raster.to_bmp(raster.raster_rows(X.rgb_blocks(spark, sf_dir), img), img).select("image_id", F.md5(F.hex("bmp")).alias("digest"), F.length("bmp").alias("size"))


def _le_sql(x: str, n: int) -> str:
    return " || ".join(f"printf('%02X', (({x}) >> {8 * i}) & 255)" for i in range(n))


BMP_HEAD = f"'424D' || {_le_sql('26 + h * w * 3 + (w % 4) * h', 4)} || '00000000' || '1A000000' || '0C000000' || {_le_sql('w', 2)} || {_le_sql('h', 2)} || '0100' || '1800'"
BMP_SQL = f"""SELECT image_id, md5(head || body) AS digest, (length(head || body) // 2)::INT AS size FROM (
  SELECT image_id, {BMP_HEAD} AS head, body
  FROM (SELECT image_id, any_value(width)::BIGINT AS w, any_value(height)::BIGINT AS h, string_agg(hex, '' ORDER BY y DESC) AS body FROM ({ROWS_BASE}) GROUP BY image_id))"""


def _decoded_sql(color: bool) -> str:
    """SQL of ``image_id, width, height, size, digest`` of the BMP files of ``X.jpegs``, from its blocks on.

    Files have four units across and up to eight down; units that the table lacks
    are zero. The transform takes a component as part of the image's id.
    """
    parts = ["SELECT image_id * 4 + 1 AS image_id, du_row, du_col, coef, 0 AS t FROM k"]
    y, cb, cr = "y.v[p + 1]", "0::BIGINT", "0::BIGINT"
    sources = "(SELECT * FROM s WHERE component = 1) y"
    if color:
        for k, x in ((2, "list_reverse(coef)"), (3, "[-x for x in coef]")):
            parts.append(f"SELECT image_id * 4 + {k}, du_row, du_col, {x}, 1 FROM k WHERE du_row % 2 = 0 AND du_col % 2 = 0")
            sources += f" JOIN s c{k} ON c{k}.component = {k} AND c{k}.image_id = y.image_id AND c{k}.du_row = y.du_row - y.du_row % 2 AND c{k}.du_col = y.du_col - y.du_col % 2"
        at = "[1 + 8 * (p // 16 + 4 * (y.du_row % 2)) + p % 8 // 2 + 4 * (y.du_col % 2)]"
        cb, cr = f"c2.v{at}", f"c3.v{at}"
    return f"""WITH f AS MATERIALIZED (SELECT image_id::BIGINT * 1000000 + du_row // 8 AS image_id, du_row % 8 AS du_row, du_col, coef FROM ({X.BLOCKS_SQL})),
n AS (SELECT image_id, max(du_row) + 1 AS down FROM f GROUP BY image_id),
g AS (SELECT image_id, du_row, unnest(range(4)) AS du_col FROM (SELECT image_id, unnest(range(down)) AS du_row FROM n)),
k AS MATERIALIZED (SELECT image_id, du_row, du_col, coalesce(coef, [0 for i in range(64)]) AS coef FROM g LEFT JOIN f USING (image_id, du_row, du_col)),
b AS MATERIALIZED (SELECT image_id, du_row, du_col, [(((coef[i + 1] * (1 + (i + t) % 24) + 32768) & 65535) - 32768)::INT for i in range(64)] AS coef FROM ({" UNION ALL ".join(parts)})),
{IDCT_WITH},
s AS MATERIALIZED (SELECT image_id // 4 AS image_id, image_id % 4 AS component, du_row, du_col, flatten(list(x ORDER BY i))::BIGINT[] AS v FROM w GROUP BY image_id, du_row, du_col),
v AS (SELECT y.image_id, y.du_row * 8 + p // 8 AS line, y.du_col * 8 + p % 8 AS place, {y} AS y, {cb} AS cb, {cr} AS cr FROM {sources}, (SELECT unnest(range(64)) AS p)),
q AS (SELECT image_id, string_agg(printf('%02X%02X%02X', b, g, r), '' ORDER BY line DESC, place) AS body FROM (SELECT image_id, line, place, {RGB_COLUMNS} FROM v) GROUP BY image_id)
SELECT image_id, w::INT AS width, h::INT AS height, (length(head || body) // 2)::INT AS size, md5(unhex(head || body)) AS digest
FROM (SELECT image_id, w, h, {BMP_HEAD} AS head FROM (SELECT image_id, 32 AS w, down * 8 AS h FROM n)) JOIN q USING (image_id)"""


def decode_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour files with restart markers, decoded to BMP: sizes and digests, null for images too large for a row."""
    done = decode(X.jpegs(spark, sf_dir))
    out = done.bmps.select("image_id", F.length("bmp").alias("size"), F.md5("bmp").alias("digest"))
    return done.images.select("image_id", "width", "height").join(out, "image_id", "left")


def stream_decode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from the table, decoded by a stream that takes what has arrived."""
    folder = tempfile.mkdtemp(prefix="stream-", dir="/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    bmps = X.jpegs(spark, sf_dir, color=False, h=1, v=1).select(F.concat("image_id", F.lit(".jpg")).alias("out_path"), F.col("content").alias("bmp"))
    files.export_files(bmps, folder)
    stream_decode(spark, f"file://{folder}", f"file://{folder}/out", f"file://{folder}/checkpoint").awaitTermination()
    done = spark.read.parquet(f"file://{folder}/out/bmps")
    return done.select(F.element_at(F.split("out_path", "/"), -1).alias("name"), F.length("bmp").alias("size"), F.md5("bmp").alias("digest"))


def decode_listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from the table, listed, read in ranges, decoded, and their BMP files written beside them and read back."""
    folder = tempfile.mkdtemp(prefix="listed-", dir="/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    files.export_files(X.jpegs(spark, sf_dir, color=False, h=1, v=1).select(F.concat("image_id", F.lit(".jpg")).alias("out_path"), F.col("content").alias("bmp")), folder)
    bmps = decode(files.list_images(spark, f"file://{folder}"), range_bytes=1000).bmps
    files.export_files(bmps.select(files.output_path(F.col("image_id")).alias("out_path"), "bmp"))
    done = files.read_images(spark, f"file://{folder}", glob="*.bmp")
    return done.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").cast("int").alias("size"), F.md5("content").alias("digest"))


def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents a file, written as files, read as images, and stored as rows."""
    folder = tempfile.mkdtemp(prefix="files-", dir="/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    docs = X.table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("k"))
    text = docs.agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    text = text.select(F.concat(F.col("k").cast("string"), F.lit(".jpg")).alias("out_path"), F.array_join(F.col("x.text"), "").cast("binary").alias("bmp"))
    files.export_files(text, folder)
    files.write_images(files.read_images(spark, f"file://{folder}"), f"file://{folder}/images")
    done = spark.read.parquet(f"file://{folder}/images")
    return done.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.md5("content").alias("digest"))


BACK_SQL = """SELECT doc_id // 50 || '.jpg' AS name, strlen(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS length,
  md5(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY doc_id // 50"""


def exported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents a file, in seven folders with equal names, written into one folder and read back."""
    folder = tempfile.mkdtemp(prefix="names-", dir="/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    docs = X.table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 50).alias("k"))
    text = docs.agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    path = F.concat(F.lit("/in/s"), (F.col("k") % 7).cast("string"), F.lit("/f"), F.floor(F.col("k") / 3).cast("string"), F.lit(".bmp"))
    done = files.export_files(text.select(path.alias("out_path"), F.array_join(F.col("x.text"), "").cast("binary").alias("bmp")), folder)
    back = files.read_images(spark, f"file://{folder}", glob="*.bmp").select(sink.plain_path(F.col("path")).alias("target"), F.md5("content").alias("digest"))
    return done.join(back, "target").select("out_path", F.element_at(F.split("target", "/"), -1).alias("name"), "size", "digest")


NAMES_SQL = """WITH t AS (SELECT doc_id // 50 AS k, string_agg(coalesce(text, ''), '' ORDER BY doc_id) AS x FROM documents GROUP BY doc_id // 50),
p AS (SELECT '/in/s' || k % 7 || '/f' || k // 3 || '.bmp' AS out_path, 'f' || k // 3 AS stem, x FROM t)
SELECT out_path, stem || CASE WHEN row_number() OVER (PARTITION BY stem ORDER BY out_path) = 1 THEN '' ELSE '-' || substr(md5(out_path), 1, 12) END || '.bmp' AS name,
  strlen(x) AS size, md5(x) AS digest FROM p"""

_ALL = [
    (order_by_size, f"SELECT image_id, length, row_number() OVER (ORDER BY length, path) AS place FROM ({FILES_SQL})"),
    (size_rank, f"SELECT image_id, source, length, row_number() OVER (PARTITION BY source ORDER BY length, path)::INT AS size_rank FROM ({FILES_SQL})"),
    (output_path, f"SELECT image_id, {OUT_SQL} AS out_path FROM ({FILES_SQL})"),
    (output_collisions, r"SELECT regexp_extract(url, '://([^/?#]*)', 1) || '/' || page_id % 7 || '.bmp' AS out_path, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1"),
    (grid_units, f"SELECT image_id, du_width, du_height, du_width_pad, du_height_pad, units, CASE WHEN units > 20 THEN 'oversized' END AS code FROM ({UNITS_SQL})"),
    (pack_batches, PACK_SQL),
    (batch_report, f"SELECT source, batch_id, count(*) AS images, sum(units)::BIGINT AS units, {SLOTS} - sum(units)::BIGINT AS free FROM ({PACK_SQL}) GROUP BY source, batch_id"),
    (run_report, RUN_SQL),
    (frame_header, f"SELECT image_id, 0 AS frame_type, 8 AS precision, height, width, num_components, false AS zero_based FROM ({X.IMAGES_SQL})"),
    (frame_components, f"SELECT image_id, c AS component, CASE WHEN c = 1 THEN h_samp ELSE 1 END AS h, CASE WHEN c = 1 THEN v_samp ELSE 1 END AS v, 0 AS quant_id FROM (SELECT *, unnest(range(1, num_components + 1)) AS c FROM ({X.IMAGES_SQL}))"),
    (scan_header, f"SELECT image_id, num_components AS components_in_scan, 0 AS ss, 63 AS se, 0 AS ah, 0 AS al, c AS scan_id, 0 AS dc_id, 0 AS ac_id FROM (SELECT *, unnest(range(1, num_components + 1)) AS c FROM ({X.IMAGES_SQL}))"),
    (restart_last_wins, "SELECT doc_id AS image_id, doc_id % 11 + 1 AS restart_interval FROM documents"),
    (quant_tables, QUANT_SQL), (huffman_tables, HUFF_SQL), (canonical_codes, CODES_SQL),
    (header_rules, RULES_SQL), (drop_ignorable, KEPT_SQL), (decode_failures, FAILURES_SQL), (unmarked_files, UNMARKED_SQL), (progressive_scans, SCANS_SQL), (read_back, BACK_SQL), (exported_names, NAMES_SQL),
    (image_status, STATUS_SQL), (error_report, REPORT_SQL), (valid_images, VALID_SQL),
    (dc_predict, DC_SQL), (ac_positions, AC_SQL), (extend_sign, SIGN_SQL), (dezigzag, ZIGZAG_SQL), (densify, DENSE_SQL),
    (dequantize, DEQUANT_TEXT_SQL), (idct, IDCT_SQL), (ycc_to_rgb, RGB_SQL), (pair_chroma, PAIR_SQL), (upsample, UPSAMPLE_SQL),
    (scan_plan, PLAN_SQL), (tile_address, TILE_SQL), (entropy_roundtrip, ROUND_SQL), (pixels, PIXEL_SQL),
    (raster_rows, f"SELECT image_id, y, hex FROM ({ROWS_BASE})"), (to_bmp, BMP_SQL), (decode_corpus, _decoded_sql(True)),
    (decode_listed_files, f"SELECT image_id || '.bmp' AS name, size, digest FROM ({_decoded_sql(False)})"),
    (stream_decode_files, f"SELECT image_id || '.bmp' AS name, size, digest FROM ({_decoded_sql(False)})"),
]
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL if sql}
