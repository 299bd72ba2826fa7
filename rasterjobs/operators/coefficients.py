"""From entropy tokens to coefficient blocks: prediction, positions, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.staging import range_slices, shard_key

#: Units of a scan plan that a task lays out.
PLAN_UNITS = 1 << 20


def dc_predict(units: DataFrame, *order: str, segment: Column | None = None) -> DataFrame:
    """``dc``: running sum of ``dc_diff`` of an image's component within a restart interval.

    An interval is summed in segments, so a long one is many tasks: the sum inside a
    segment and the sums of those before it. ``segment`` numbers the segments of an
    interval along ``order``; without it, rows are dealt to ranges of about equal size.
    """
    keys = ["image_id", "component", "interval_no"]
    if segment is None:
        rows = range_slices(units, keys, [F.col(c).asc() for c in order])
    else:
        rows = units.withColumn("_key", shard_key(keys)).withColumn("_slice", segment)
    sums = rows.groupBy("_key", "_slice").agg(F.sum("dc_diff").alias("_sum"))
    # a row for each segment of an interval
    before = sums.select("_key", "_slice", (F.sum("_sum").over(W.partitionBy("_key").orderBy("_slice")) - F.col("_sum")).alias("_before"))
    inside = F.sum("dc_diff").over(W.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("_inside", inside).join(before, ["_key", "_slice"])
    return out.select(*units.columns, (F.col("_inside") + F.col("_before")).alias("dc"))


def ac_positions(tokens: DataFrame, *order: str) -> DataFrame:
    """``position`` of each AC token: running sum of ``run + 1`` in its unit."""
    w = W.partitionBy("unit_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return tokens.withColumn("position", F.sum(F.col("run") + 1).over(w))


def tile_address(df: DataFrame) -> DataFrame:
    """``tile_row, tile_col, tile_pos, tile_index`` of a data unit; tiles are 2 x 2 units."""
    row, col = F.col("du_row"), F.col("du_col")
    across = F.ceil(F.col("du_width") / 2)
    df = df.withColumn("tile_row", F.floor(row / 2).cast("int")).withColumn("tile_col", F.floor(col / 2).cast("int"))
    return df.withColumn("tile_pos", (row % 2 * 2 + col % 2).cast("int")).withColumn("tile_index", (F.col("tile_row") * across + F.col("tile_col")).cast("int"))


def scan_plan(images: DataFrame, components: DataFrame) -> DataFrame:
    """``image_id, seq, interval_no, component, du_row, du_col``: the units of a scan in decoding order.

    ``images`` needs ``du_height, du_width, h_samp, v_samp, restart_interval``,
    ``components`` the components of the scan in order (``place``). A scan of
    several components interleaves h x v luma units with one unit of each chroma
    component per MCU; a scan of one component takes its units one by one. Chroma
    units have luma coordinates. Image sizes only drive sequences: no join of units.

    Images are dealt out by ``image_id`` before they are laid out, to one task for each
    ``PLAN_UNITS`` units (counted first): units are made where their image is, and
    sums by image and what else tells its units apart need no exchange of them.
    """
    c = components.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("place", "component"))).alias("cs"))
    df = images.join(c, "image_id")
    many = F.size("cs") > 1
    # a lone chroma component is stored at the anchors of the luma grid
    lone = F.get("cs", 0)["component"]
    h, v = F.col("h_samp"), F.col("v_samp")
    df = df.withColumn("step_h", F.when(many | (lone != 1), h).otherwise(1)).withColumn("step_v", F.when(many | (lone != 1), v).otherwise(1))
    df = df.withColumn("across", F.ceil(F.col("du_width") / F.col("step_h")).cast("int")).withColumn("down", F.ceil(F.col("du_height") / F.col("step_v")).cast("int"))
    luma = F.flatten(F.transform(F.sequence(F.lit(0), F.col("step_v") - 1), lambda y: F.transform(F.sequence(F.lit(0), F.col("step_h") - 1), lambda x: F.struct(y.alias("y"), x.alias("x")))))
    one = F.array(F.struct(F.lit(0).alias("y"), F.lit(0).alias("x")))
    # the units of an MCU are the same all over an image
    cells = F.flatten(F.transform("cs", lambda k: F.transform(F.when(many & (k["component"] == 1), luma).otherwise(one), lambda p: F.struct(k["component"].alias("component"), p["y"].alias("y"), p["x"].alias("x")))))
    df = df.withColumn("cells", cells)
    units = df.agg(F.sum(F.col("across").cast("bigint") * F.col("down") * F.size("cells"))).first()[0] or 0
    keep = ["image_id", "cells", "step_h", "step_v", "across", "restart_interval"]
    df = df.select(*keep, "down").repartition(max(-(-units // PLAN_UNITS), images.sparkSession.sparkContext.defaultParallelism), "image_id")
    df = df.select(*keep, F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("mr"))
    df = df.select(*keep, "mr", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("mc"))
    df = df.withColumn("mcu", F.col("mr") * F.col("across") + F.col("mc"))
    df = df.select(*keep, "mr", "mc", "mcu", F.size("cells").alias("per"), F.posexplode("cells").alias("k", "cell"))
    gap = F.coalesce(F.col("restart_interval"), F.lit(0))
    interval = F.when(gap > 0, F.floor(F.col("mcu") / F.when(gap > 0, gap))).otherwise(0).cast("int")
    return df.select(
        "image_id", (F.col("mcu") * F.col("per") + F.col("k")).alias("seq"), interval.alias("interval_no"), F.col("cell.component").alias("component"),
        (F.col("mr") * F.col("step_v") + F.col("cell.y")).alias("du_row"), (F.col("mc") * F.col("step_h") + F.col("cell.x")).alias("du_col"),
    )


def with_missing(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """``blocks`` and a block of zeros for each unit of the padded grid that an image lacks.

    Only images with fewer blocks than units are laid out as a grid. Chroma units
    stand at the anchors of the luma grid.
    """
    h, v = F.col("h_samp"), F.col("v_samp")
    units = F.col("du_width_pad") * F.col("du_height_pad")
    count = units + F.when(F.col("num_components") > 1, (F.col("num_components") - 1) * (units / (h * v))).otherwise(0)
    got = blocks.groupBy("image_id").agg(F.count("*").alias("_n"))
    short = images.join(got, "image_id", "left").filter(F.coalesce("_n", F.lit(0)) < count)
    g = short.select("image_id", "h_samp", "v_samp", "du_width_pad", "du_height_pad", F.explode(F.sequence(F.lit(1), F.col("num_components").cast("int"))).alias("component"))
    step = [F.when(F.col("component") == 1, 1).otherwise(c) for c in (v, h)]
    g = g.select("image_id", "component", "h_samp", "du_width_pad", F.explode(F.sequence(F.lit(0), F.col("du_height_pad") - 1, step[0])).alias("du_row"))
    g = g.select("image_id", "component", "du_row", F.explode(F.sequence(F.lit(0), F.col("du_width_pad") - 1, step[1])).alias("du_col"))
    keys = ["image_id", "component", "du_row", "du_col"]
    types = {f.name: f.dataType for f in blocks.schema}
    missing = g.select(*(F.col(c).cast(types[c]) for c in keys)).join(blocks.select(*keys), keys, "left_anti")
    zeros = F.array_repeat(F.lit(0), 64).cast(types["coef"])
    return blocks.unionByName(missing.withColumn("coef", zeros), allowMissingColumns=True)
