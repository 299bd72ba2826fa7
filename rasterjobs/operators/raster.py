"""Pixels, raster rows and BMP files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import le_hex

#: An image whose BMP would be larger is no row of ``to_bmp`` but one of ``too_large``. A task and the
#: JVM hold some three copies of a file each.
MOST_BYTES = 1 << 28


def pixels(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """``image_id, x, y, r, g, b`` of the pixels inside the image."""
    df = blocks.join(images.select("image_id", "width", "height"), "image_id")
    df = df.select("image_id", "width", "height", "du_row", "du_col", F.posexplode(F.arrays_zip("r", "g", "b")).alias("p", "c"))
    df = df.withColumn("x", F.col("du_col") * 8 + F.col("p") % 8).withColumn("y", F.col("du_row") * 8 + F.floor(F.col("p") / 8).cast("int"))
    return df.filter("x < width and y < height").select("image_id", "x", "y", "c.r", "c.g", "c.b")


def raster_rows(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """``image_id, y, bytes``: B, G, R of a pixel row, cut to the width, then ``width % 4`` zero bytes.

    Blocks are dealt out once, by image and row of units; a task holds one such row
    of an image at a time, and joins its blocks as bytes.
    """
    df = blocks.join(images.select("image_id", "width", "height"), "image_id").select("image_id", "du_row", "du_col", "width", "height", "r", "g", "b")
    df = df.repartition("image_id", "du_row").sortWithinPartitions("image_id", "du_row", "du_col")
    kind = df.schema["image_id"].dataType.simpleString()

    def lines(image, row, width, height, parts):
        pixels = np.concatenate(parts, axis=1)[:, :width]
        pad = bytes(width % 4)
        n = min(8, height - 8 * row)
        data = [pixels[y].tobytes() + pad for y in range(n)]
        return pa.RecordBatch.from_arrays([pa.array([image] * n, image_type[0]), pa.array(range(8 * row, 8 * row + n), pa.int32()), pa.array(data, pa.binary())], ["image_id", "y", "bytes"])

    image_type = []

    def run(batches):
        place, parts = None, []
        for batch in batches:
            image_type[:] = [batch.schema.field("image_id").type]
            n = batch.num_rows
            planes = [batch.column(c).values.slice(batch.column(c).offset * 64, n * 64).to_numpy().astype(np.uint8).reshape(n, 8, 8) for c in "bgr"]
            pixels = np.stack(planes, -1)
            for i, now in enumerate(zip(*(batch.column(c).to_pylist() for c in ("image_id", "du_row", "width", "height")), strict=True)):
                if now != place:
                    if parts and place[3] > 8 * place[1]:
                        yield lines(*place, parts)
                    place, parts = now, []
                parts.append(pixels[i])
        if parts and place[3] > 8 * place[1]:
            yield lines(*place, parts)

    return df.mapInArrow(run, f"image_id {kind}, y int, bytes binary")


def bmp_header(width, height):
    """26 bytes as hex text: magic, size, offset, core header with 16-bit sizes, 1 plane, 24 bits."""
    size = (26 + height * width * 3 + (width % 4) * height).bitwiseAND((1 << 32) - 1)
    return F.concat(F.lit("424D"), le_hex(size, 4), F.lit("00000000"), le_hex(F.lit(26), 4), le_hex(F.lit(12), 4), le_hex(width, 2), le_hex(height, 2), le_hex(F.lit(1), 2), le_hex(F.lit(24), 2))


def bmp_size():
    return 26 + F.col("height").cast("bigint") * (F.col("width") * 3 + F.col("width") % 4)


def too_large(images: DataFrame) -> DataFrame:
    """Rows of ``errors`` for the images that ``to_bmp`` leaves out; ``bmp_rows`` has their parts."""
    return images.filter(bmp_size() > MOST_BYTES).select("image_id", F.lit("bmp_too_large").alias("code"), bmp_size().cast("string").alias("detail"), F.lit(3_000_000).alias("ord"), F.lit(120).alias("step"))


def bmp_rows(rows: DataFrame, images: DataFrame) -> DataFrame:
    """``image_id, at, bytes, size``: parts of the BMP files of the images that are too large for ``to_bmp``, the header before the lowest row."""
    big = images.filter(bmp_size() > MOST_BYTES).select("image_id", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))
    df = rows.join(big, "image_id").withColumn("size", bmp_size())
    low = F.col("y") == F.col("height") - 1
    head = F.when(low, F.unhex(bmp_header(F.col("width"), F.col("height")))).otherwise(F.unhex(F.lit("")))
    at = F.when(low, 0).otherwise(26 + (F.col("height") - 1 - F.col("y")) * (F.col("width") * 3 + F.col("width") % 4))
    return df.select("image_id", at.cast("bigint").alias("at"), F.concat(head, "bytes").alias("bytes"), "size")


def to_bmp(rows: DataFrame, images: DataFrame) -> DataFrame:
    """``image_id, bmp``: the rows of an image bottom-up behind a header. Larger images are left out (see ``too_large``).

    Rows are dealt out by image, lowest first, the header before them; a task appends
    them to the one file that it holds. An image without rows has no file.
    """
    fits = images.filter(bmp_size() <= MOST_BYTES).select("image_id", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"))
    head = fits.select("image_id", F.col("height").alias("y"), F.unhex(bmp_header(F.col("width"), F.col("height"))).alias("bytes"))
    body = rows.join(fits.select("image_id", "height"), "image_id").select("image_id", F.col("y").cast("bigint").alias("y"), "bytes")
    df = body.unionByName(head).repartition("image_id").sortWithinPartitions("image_id", F.desc("y"))
    kind = df.schema["image_id"].dataType.simpleString()

    def run(batches):
        image, data, n = None, bytearray(), 0
        for batch in batches:
            if image is None and batch.num_rows:
                image = batch.column("image_id").slice(0, 1)
            for i, x in zip(batch.column("image_id"), batch.column("bytes"), strict=True):
                if i != image[0]:
                    if n > 1:
                        yield pa.RecordBatch.from_arrays([image, pa.array([data], pa.binary())], ["image_id", "bmp"])
                    image, data, n = pa.array([i.as_py()], i.type), bytearray(), 0
                data += x.as_buffer()
                n += 1
        if n > 1:
            yield pa.RecordBatch.from_arrays([image, pa.array([data], pa.binary())], ["image_id", "bmp"])

    return df.mapInArrow(run, f"image_id {kind}, bmp binary")
