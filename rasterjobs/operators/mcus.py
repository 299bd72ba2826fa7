"""Minimum coded units as rows: decoded blocks, and what comes of them without a join.

A row holds all blocks of one MCU, luma and chroma, with what is needed to make
pixels of them: the place in the grid, the sampling and the quantization steps. The
decoder has each MCU whole and knows the DC values before it, so nothing is dealt
out, summed or paired between the entropy data and RGB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import BLUE_CB, GREEN_CB, GREEN_CR, RED_CR, SHIFT, ZIGZAG
from . import huffman
from .transform import idct8x8

#: Blocks of which a task makes rows, or pixels, at once.
UNITS = 1 << 11

_FIELDS = {
    "interval_no": "int", "mcu": "bigint", "du_row": "int", "du_col": "int", "h": "int", "v": "int",
    "components": "array<int>", "quant": "binary", "got": "int", "error": "string",
}
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.string()]


def decode_mcus(intervals: DataFrame, tables: DataFrame, chunk_bytes: int = huffman.CHUNK) -> DataFrame:
    """A row for each MCU with ``image_id``, ``interval_no``, ``mcu`` and:

    * ``du_row, du_col, h, v``: the place of its first luma unit, luma units across and down;
    * ``components, coef``: the component of each block, and the blocks one after another,
      in row order with their DC values (16 bits, wrapping around);
    * ``quant``: the steps of each block as little-endian 16-bit numbers, null where a table lacks;
    * ``got, error``: blocks decoded before the data failed, and why; the others are zero.

    ``tables`` are those of ``huffman.decode_units``, with ``q`` in ``cells`` and ``step_h,
    step_v, across``. An MCU belongs to the chunk that it begins in. ``intervals`` are written down.
    """
    info = [*huffman._INFO, "step_h", "step_v", "across"]
    first, *more = [_rows(df.select("image_id", "interval_no", "data", *info, *huffman._BEGIN)) for df in huffman.decodable(intervals, tables.select("image_id", *info), chunk_bytes)]
    return first.unionByName(more[0]) if more else first


def _rows(df: DataFrame) -> DataFrame:
    kind = df.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            steps = [batch.column(c).to_pylist() for c in ("step_h", "step_v", "across")]
            rows = _Rows()
            for place, r, use, seq, units in huffman.decoded_rows(batch, whole=True):
                h, v, across = (x[place] for x in steps)
                n, order = len(use), huffman.components(use)
                parts = [c[0] for c in use]
                q = [c["q"] for c in r["cells"]]
                quant = None if None in q else np.array(q, "<u2").tobytes()
                sums = dict(zip(order, r["sums"] or [0] * len(order), strict=True))
                baseline, adds = r["frame_type"] == 0, r["frame_type"] == 0 or (r["ss"] == 0 and r["ah"] == 0)
                shift = 0 if baseline else r["al"]
                skip = -r["cell"] % n  # the rest of an MCU that the chunk before has
                for k, (component, diff, pos, vals, error) in enumerate(units, -skip):
                    if adds:
                        sums[component] += diff
                    if k < 0:
                        continue
                    if k % n == 0:
                        mcu = (seq + skip + k) // n
                        if rows.units >= UNITS:
                            yield rows.pack(batch)
                            rows = _Rows()
                        rows.open(place, (r["interval_no"], mcu, mcu // across * v, mcu % across * h, h, v, parts, quant), n)
                    if error is None:
                        rows.add(k % n, (sums[component] if adds else diff) << shift, pos, vals)
                    else:
                        rows.fail(error)
            if rows.units:
                yield rows.pack(batch)

    return df.mapInArrow(run, f"image_id {kind}, {', '.join(f'{k} {t}' for k, t in _FIELDS.items())}, coef array<smallint>")


class _Rows:
    """MCU rows on their way to a batch."""

    zigzag = np.array(ZIGZAG)

    def __init__(self):
        self.at, self.rows, self.sizes, self.got, self.error = [], [], [], [], []
        self.units, self.base = 0, 0
        self.where, self.dc, self.count, self.pos, self.vals = [], [], [], [], []

    def open(self, place, row, n):
        self.at.append(place)
        self.rows.append(row)
        self.sizes.append(64 * n)
        self.got.append(0)
        self.error.append(None)
        self.base, self.units = self.units, self.units + n

    def add(self, cell, dc, pos, vals):
        self.got[-1] += 1
        self.where.append(self.base + cell)
        self.dc.append(dc)
        self.count.append(len(pos))
        self.pos += pos
        self.vals += vals

    def fail(self, error):
        self.error[-1] = error

    def pack(self, batch):
        coef = np.zeros(64 * self.units, np.int16)
        where = 64 * np.array(self.where, np.int64)
        coef[np.repeat(where, self.count) + self.zigzag[np.array(self.pos, np.int64)]] = np.array(self.vals, np.int64).astype(np.int16)
        coef[where] = np.array(self.dc, np.int64).astype(np.int16)
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.sizes)]), pa.int32()), pa.array(coef))
        cols = [*zip(*self.rows, strict=True), self.got, self.error]
        return pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(self.at)), *(pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)), flat], ["image_id", *_FIELDS, "coef"])


def decode_errors(mcus: DataFrame) -> DataFrame:
    """Rows of ``errors`` for images whose entropy data can't be decoded."""
    seq = F.col("mcu") * F.size("components") + F.col("got")
    return mcus.filter("error is not null").select("image_id", F.col("error").alias("code"), F.concat_ws("/", "interval_no", seq).alias("detail"), F.lit(1_500_000).alias("ord"), F.lit(105).alias("step"))


def _block(values: str, k) -> F.Column:
    return F.slice(values, 64 * k + 1, 64)


def blocks(mcus: DataFrame) -> DataFrame:
    """``image_id, component, du_row, du_col, coef`` of every decoded block; chroma at luma coordinates."""
    df = mcus.select("image_id", "du_row", "du_col", "h", "got", "coef", F.posexplode("components").alias("k", "component")).filter("k < got")
    inside = F.when(F.col("component") == 1, F.col("k")).otherwise(0)  # luma comes first
    return df.select("image_id", "component", (F.col("du_row") + F.floor(inside / F.col("h"))).cast("int").alias("du_row"), (F.col("du_col") + inside % F.col("h")).cast("int").alias("du_col"), _block("coef", F.col("k")).alias("coef"))


def with_missing(mcus: DataFrame, scans: DataFrame) -> DataFrame:
    """``mcus`` and a row for each MCU that an image of ``scans`` lacks, without ``coef`` and ``quant``.

    Only images with fewer rows than MCUs are laid out.
    """
    got = mcus.groupBy("image_id").agg(F.count("*").alias("_n"))
    short = scans.join(got, "image_id", "left").filter(F.coalesce("_n", F.lit(0)) < F.col("mcus"))
    parts = F.transform("cells", lambda c: c["component"]).alias("components")
    g = short.select("image_id", "across", F.col("step_h").alias("h"), F.col("step_v").alias("v"), parts, F.explode(F.sequence(F.lit(0), F.col("mcus") - 1)).alias("mcu"))
    g = g.withColumn("du_row", (F.floor(F.col("mcu") / F.col("across")) * F.col("v")).cast("int")).withColumn("du_col", (F.col("mcu") % F.col("across") * F.col("h")).cast("int"))
    g = g.withColumn("mcu", F.col("mcu").cast("bigint")).drop("across").join(mcus.select("image_id", "mcu"), ["image_id", "mcu"], "left_anti")
    return mcus.unionByName(g, allowMissingColumns=True)


def _planes(coef: np.ndarray, quant: np.ndarray, components: list[int], h: int, v: int) -> list[np.ndarray]:
    """R, G, B of the luma units of MCUs of one layout, each (MCUs, units, 64).

    ``coef`` and ``quant`` are (MCUs, blocks, 64). Products wrap around to 16 bits.
    """
    x = idct8x8((coef.astype(np.int32) * quant).astype(np.int16).reshape(-1, 64)).reshape(coef.shape).astype(np.int64)
    luma = [k for k, c in enumerate(components) if c == 1]
    n = 1 if components == [1] else h * v
    y = np.zeros((len(x), n, 64), np.int64)
    y[:, : len(luma)] = x[:, luma]
    row, col = np.divmod(np.arange(64), 8)
    covers = np.array([8 * (row // v + 4 * (k // h)) + col // h + 4 * (k % h) for k in range(n)])  # the nearest chroma sample
    cb, cr = (x[:, components.index(k)][:, covers] if k in components else np.zeros_like(y) for k in (2, 3))
    planes = y + (RED_CR * cr >> SHIFT), y - (GREEN_CB * cb >> SHIFT) - (GREEN_CR * cr >> SHIFT), y + (BLUE_CB * cb >> SHIFT)
    return [np.clip(p + 128, 0, 255).astype(np.int16) for p in planes]


def rgb(mcus: DataFrame) -> DataFrame:
    """``image_id, du_row, du_col, r, g, b`` of every luma unit, as ``rgb_blocks`` gives them for paired units.

    An MCU has its chroma beside its luma, so this is one pass over rows, batch by
    batch. Missing blocks, and blocks without steps, are zero. A scan of chroma alone
    has the luma units that its blocks cover.
    """
    kind = mcus.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            layouts: dict = {}
            for i, (h, v, parts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("h", "v", "components")), strict=True)):
                layouts.setdefault((h, v, tuple(parts)), []).append(i)
            for (h, v, parts), rows in layouts.items():
                step = max(1, UNITS // len(parts))
                for at in range(0, len(rows), step):
                    yield part(batch.take(pa.array(rows[at : at + step])), h, v, list(parts))

    def part(batch, h, v, parts):
        zero = bytes(128 * len(parts))
        known = pc.and_(batch.column("coef").is_valid(), batch.column("quant").is_valid()).to_numpy(zero_copy_only=False)
        coef = np.zeros((batch.num_rows, len(parts), 64), np.int16)
        coef[known] = batch.column("coef").filter(pa.array(known)).flatten().to_numpy().reshape(-1, len(parts), 64)
        quant = np.frombuffer(b"".join(q or zero for q in batch.column("quant").to_pylist()), "<u2").reshape(coef.shape).astype(np.int32)
        planes = _planes(coef, quant, parts, h, v)
        n = planes[0].shape[1]
        k = np.tile(np.arange(n), batch.num_rows)
        row, col = (np.repeat(batch.column(c).to_numpy(), n) for c in ("du_row", "du_col"))
        ends = pa.array(np.arange(0, 64 * len(k) + 1, 64), pa.int32())
        ids = batch.column("image_id").take(pa.array(np.repeat(np.arange(batch.num_rows), n)))
        return pa.RecordBatch.from_arrays([ids, pa.array(row + k // h, pa.int32()), pa.array(col + k % h, pa.int32()), *(pa.ListArray.from_arrays(ends, pa.array(p.reshape(-1))) for p in planes)], ["image_id", "du_row", "du_col", "r", "g", "b"])

    return mcus.select("image_id", "du_row", "du_col", "h", "v", "components", "quant", "coef").mapInArrow(run, f"image_id {kind}, du_row int, du_col int, r array<smallint>, g array<smallint>, b array<smallint>")
