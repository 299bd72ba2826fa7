"""Grids, work units and capacity batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.staging import range_slices, shard_key, stage

CAPACITY = 100


def _even(x):
    return x + x % 2


def grid(images: DataFrame) -> DataFrame:
    """``du_width, du_height`` in data units, and padded to even where the luma sampling is 2."""
    w, h = F.ceil(F.col("width") / 8).cast("int"), F.ceil(F.col("height") / 8).cast("int")
    df = images.withColumn("du_width", w).withColumn("du_height", h)
    return df.withColumn("du_width_pad", F.when(F.col("h_samp") == 2, _even(F.col("du_width"))).otherwise(F.col("du_width"))).withColumn("du_height_pad", F.when(F.col("v_samp") == 2, _even(F.col("du_height"))).otherwise(F.col("du_height")))


def work_units(images: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``units`` of an image: its padded grid, even both ways, over the capacity, rounded up."""
    cells = _even(F.col("du_width_pad")) * _even(F.col("du_height_pad"))
    return images.withColumn("units", F.ceil(cells / capacity).cast("int"))


def reject_oversized(images: DataFrame, slots: int) -> tuple[DataFrame, DataFrame]:
    """Images that fit into ``slots``, and rows of ``errors`` for the others."""
    big = images.filter(F.col("units") > slots)
    errors = big.select("image_id", F.lit("oversized").alias("code"), F.col("units").cast("string").alias("detail"), F.lit(2_000_000).alias("ord"), F.lit(110).alias("step"))
    return images.filter(F.col("units") <= slots), errors


def _fold(units: np.ndarray, slots: int, free: int) -> tuple[np.ndarray, int]:
    """Next-fit from ``free`` slots: batches opened up to each image, and what is free at the end (-1 for less than none)."""
    batch, out = 0, []
    for need in units.tolist():
        if need > free:
            batch, free = batch + 1, slots
        free = max(free - need, -1)
        out.append(batch)
    return np.array(out, np.int64), free


def _transitions(units: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Batches opened and slots free after all of ``units``, for each start from -1 to ``slots`` free.

    The first image beyond the free slots opens a batch, whatever came before, so
    one pass from the end over the images that open one serves all starts.
    """
    n, upto = len(units), np.cumsum(units)
    base = upto - units
    then = np.maximum(np.searchsorted(upto, base + slots, "right"), np.arange(1, n + 1)).tolist()
    opened, left = np.ones(n, np.int64), np.maximum(slots - (upto[-1] - base), -1)
    for i in range(n - 1, -1, -1):
        if then[i] < n:
            opened[i], left[i] = opened[then[i]] + 1, left[then[i]]
    start = np.arange(-1, slots + 1)
    first = np.searchsorted(upto, start, "right")
    at = np.minimum(first, n - 1)
    return np.where(first < n, opened[at], 0), np.where(first < n, left[at], start - upto[-1])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch, np.ndarray]]:
    """Stretches of a batch with one shard and range, and their units."""
    keys = list(zip(batch.column("_key").to_pylist(), batch.column("_slice").to_pylist(), strict=True))
    cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = batch.slice(lo, hi - lo)
        yield keys[lo], part, part.column("units").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def pack_batches(images: DataFrame, slots: int, shard_cols: list[str] | None = None) -> DataFrame:
    """``shard columns, image_id, path, length, units, batch_id``: next-fit in ascending size order.

    A shard is sorted into ranges. Each range is folded for every possible number
    of free slots, these tables are followed in order to each range's true start,
    and the ranges are folded again from there. Tasks read ranges an Arrow batch
    at a time; without shard columns there is one shard and the order is global.
    """
    shard = shard_cols or []
    order = [F.col("length").asc_nulls_last(), F.col("path").asc_nulls_last()]
    narrow = images.select(*shard, "image_id", "path", "length", "units")
    rows = range_slices(narrow, shard, order)

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("_slice").sortWithinPartitions("_slice", "_key", *order, "image_id", "units")

    def table(batches):
        now, opened, free = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([opened.tolist()], pa.list_(pa.int64())), pa.array([free.tolist()], pa.list_(pa.int64()))], ["_key", "_slice", "opened", "free"])

        for batch in batches:
            for key, _, units in _runs(batch):
                if key != now:
                    if now:
                        yield out()
                    now, opened, free = key, np.zeros(slots + 2, np.int64), np.arange(-1, slots + 1)
                more, left = _transitions(units, slots)
                opened, free = opened + more[free + 1], left[free + 1]
        if now:
            yield out()

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, batch, free, starts = pdf.sort_values("_slice"), 0, slots, []
        for opened, left in zip(pdf["opened"], pdf["free"], strict=True):
            starts.append((batch, free))
            batch, free = batch + int(opened[free + 1]), int(left[free + 1])
        return pdf[["_key", "_slice"]].assign(_batch=[b for b, _ in starts], _free=[f for _, f in starts])

    def fold(batches):
        now, first, free = None, 0, slots
        for batch in batches:
            for key, part, units in _runs(batch):
                if key != now:
                    now, first, free = key, part.column("_batch")[0].as_py(), part.column("_free")[0].as_py()
                opened, free = _fold(units, slots, free)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(first + opened, pa.int32())], [*columns, "batch_id"])
                first += int(opened[-1])

    columns = narrow.columns
    tables = in_order(rows).select("_key", "_slice", "units").mapInArrow(table, "_key string, _slice int, opened array<long>, free array<long>")
    starts = stage(tables.groupBy("_key").applyInPandas(follow, "_key string, _slice int, _batch long, _free long"), "starts")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema)
    return in_order(rows.join(starts, ["_key", "_slice"])).mapInArrow(fold, f"{kinds}, batch_id int")


def batch_report(batches: DataFrame, slots: int, shard_cols: list[str] | None = None) -> DataFrame:
    """``images, units, free`` of each batch."""
    return batches.groupBy(*(shard_cols or []), "batch_id").agg(F.count("*").alias("images"), F.sum("units").alias("units"), (F.lit(slots) - F.sum("units")).alias("free"))


def run_report(metrics: DataFrame) -> DataFrame:
    """``stage``: calls, total, least, most and upper median (element n div 2) of seconds.

    The median is found in counts of equal seconds: first its range by the counts
    of earlier ranges, then its place in the range.
    """
    totals = stage(metrics.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.expr("count(seconds) div 2").alias("_k")).withColumn("_key", shard_key(["stage"])), "totals")
    counts = metrics.filter("seconds is not null").groupBy("stage", "seconds").agg(F.count("*").alias("_n"))
    counts = range_slices(counts, ["stage"], [F.col("seconds").asc()])
    slices = counts.groupBy("_key", "_slice").agg(F.sum("_n").alias("_size"))
    slices = slices.withColumn("_before", F.sum("_size").over(W.partitionBy("_key").orderBy("_slice")) - F.col("_size"))
    here = slices.join(totals.select("_key", "_k"), "_key").filter("_before <= _k and _k < _before + _size").select("_key", "_slice", "_before", "_k")
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy("_key", "_slice").orderBy("seconds"))
    median = counts.join(here, ["_key", "_slice"]).withColumn("_upto", upto).filter("_upto > _k").groupBy("_key").agg(F.min("seconds").alias("median"))
    return totals.join(median, "_key", "left").select("stage", "calls", "total", "least", "most", "median")
