"""Dequantization, inverse transform and colour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.arrays import dequantize, upsample, ycc_to_rgb

#: Factor and right shift of each input of a pass, then those of the inner products.
INPUT = ((181, 5), (251, 5), (59, 3), (213, 5), (181, 5), (71, 4), (49, 4), (25, 4))
HALF, SINE, COSINE, BOTH = (181, 7), (277, 8), (669, 8), (49, 6)
OUTPUT_SHIFT = 4


def _times(x: np.ndarray, factor: tuple[int, int]) -> np.ndarray:
    return (x * factor[0]) >> factor[1]


def _pass(x: np.ndarray) -> np.ndarray:
    """One-dimensional inverse transform along the last axis; shifts round down, results wrap to 16 bits."""
    s = [_times(x[..., i], f) for i, f in enumerate(INPUT)]
    # even inputs
    sum26, diff26 = s[2] + s[6], _times(s[2] - s[6], HALF)
    top, low = s[0] + s[4], s[0] - s[4]
    even = (top + sum26, low + diff26 - sum26, low - diff26 + sum26, top - sum26)
    # odd inputs
    sum17, diff17, sum35, diff53 = s[1] + s[7], s[1] - s[7], s[5] + s[3], s[5] - s[3]
    total, turn = sum17 + sum35, _times(diff53 + diff17, BOTH)
    across = _times(sum17 - sum35, HALF) + total
    steep = _times(diff17, COSINE) - turn
    third = across - steep
    odd = (total, steep - total, third, _times(diff53, SINE) + turn - third)
    out = [e + o for e, o in zip(even, odd, strict=True)] + [e - o for e, o in zip(even[::-1], odd[::-1], strict=True)]
    return (np.stack(out, -1) >> OUTPUT_SHIFT).astype(np.int16).astype(np.int32)


def idct8x8(blocks: np.ndarray) -> np.ndarray:
    """Rows, then columns, of blocks shaped (n, 64); int16."""
    x = _pass(blocks.reshape(-1, 8, 8).astype(np.int32))
    return _pass(x.transpose(0, 2, 1)).transpose(0, 2, 1).reshape(-1, 64).astype(np.int16)


@pandas_udf(T.ArrayType(T.ShortType()))
def idct(coef: pd.Series) -> pd.Series:
    """Inverse transform of each block, a batch of blocks at a time."""
    if not len(coef):
        return coef
    return pd.Series(list(idct8x8(np.stack(coef.to_numpy()))))


def with_quant(blocks: DataFrame, components: DataFrame, tables: DataFrame) -> DataFrame:
    """``blocks`` with their component's steps ``q``. The tables of an image travel as one small row."""
    per = components.join(tables, (components["image_id"] == tables["image_id"]) & (components["quant_id"] == tables["table_id"])).select(components["image_id"], "component", "q")
    return blocks.join(per, ["image_id", "component"])


def samples(blocks: DataFrame) -> DataFrame:
    """Dequantized and inverse-transformed blocks: ``image_id, component, du_row, du_col, sample``."""
    return blocks.select("image_id", "component", "du_row", "du_col", idct(dequantize(F.col("coef"), F.col("q"))).alias("sample"))


def pair_chroma(blocks: DataFrame, images: DataFrame, value: str = "sample") -> DataFrame:
    """``image_id, du_row, du_col, h, v, y, cb, cr``: luma units with the chroma units that cover them.

    Chroma units stand at luma coordinates whose remainders by the sampling are 0.
    Missing chroma (grayscale) is zero. The join key spreads a large image.
    """
    size = images.select("image_id", F.col("h_samp").alias("h"), F.col("v_samp").alias("v"))
    anchor = [(F.col("du_row") - F.col("du_row") % F.col("v")).alias("ar"), (F.col("du_col") - F.col("du_col") % F.col("h")).alias("ac")]
    luma = blocks.filter("component = 1").join(size, "image_id").select("image_id", "du_row", "du_col", "h", "v", F.col(value).alias("y"), *anchor)
    other = blocks.filter("component in (2, 3)").groupBy("image_id", F.col("du_row").alias("ar"), F.col("du_col").alias("ac"))
    chroma = other.agg(*(F.first(F.when(F.col("component") == k, F.col(value)), ignorenulls=True).alias(n) for k, n in ((2, "cb"), (3, "cr"))))
    zero = F.array_repeat(F.lit(0).cast("smallint"), 64)
    both = luma.join(chroma, ["image_id", "ar", "ac"], "left")
    return both.select("image_id", "du_row", "du_col", "h", "v", "y", F.coalesce("cb", zero).alias("cb"), F.coalesce("cr", zero).alias("cr"))


def rgb_blocks(pairs: DataFrame) -> DataFrame:
    """``image_id, du_row, du_col, r, g, b`` of paired units."""
    cb, cr = (upsample(F.col(c), F.col("du_row"), F.col("du_col"), F.col("h"), F.col("v")) for c in ("cb", "cr"))
    df = pairs.select("image_id", "du_row", "du_col", "y", cb.alias("cb"), cr.alias("cr"))
    return df.select("image_id", "du_row", "du_col", ycc_to_rgb(F.col("y"), F.col("cb"), F.col("cr")).alias("c")).select("image_id", "du_row", "du_col", "c.r", "c.g", "c.b")
