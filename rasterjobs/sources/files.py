"""Image files as tables, and results as tables or files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import sink
from .staging import range_slices, stage

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_images(spark: SparkSession, paths, glob: str = "*.jp*g") -> DataFrame:
    """``image_id, path, length, content`` of files; the path is the id."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    return df.select(F.col("path").alias("image_id"), "path", "length", "content")


def list_images(spark: SparkSession, paths, glob: str = "*.jp*g") -> DataFrame:
    """``image_id, path, length`` of files that are listed and not read; for ``triage``."""
    return read_images(spark, paths, glob).drop("content")  # Spark reads no content that nobody selects


def output_path(path: Column) -> Column:
    """The extension of the last path part replaced by .bmp, or .bmp appended."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".bmp"))


def output_collisions(files: DataFrame) -> DataFrame:
    """``out_path, n`` of output names that several inputs share."""
    return files.groupBy(output_path(F.col("path")).alias("out_path")).agg(F.count("*").alias("n")).filter("n > 1")


def order_by_size(files: DataFrame) -> DataFrame:
    """``files`` by ascending size, then path (a distributed range sort)."""
    return files.orderBy("length", "path")


def numbered(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` with ``place`` from 1 on, in the order of ``at`` (a ``monotonically_increasing_id``), which is dropped.

    An id holds its partition and its row there, so only one count a partition is summed.
    """
    rows = stage(rows, "sorted")
    part = F.shiftright(F.col(at), 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    place = F.col("_before") + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", place).drop(at, "_part", "_before")


def size_rank(files: DataFrame, shard: list[str]) -> DataFrame:
    """``size_rank`` within shards, in the order of ``order_by_size``: the rank in a range and the rows of earlier ranges."""
    rows = range_slices(files, shard, [F.col("length").asc(), F.col("path").asc()])
    sizes = rows.groupBy("_key", "_slice").agg(F.count("*").alias("_n"))
    before = sizes.select("_key", "_slice", (F.sum("_n").over(W.partitionBy("_key").orderBy("_slice")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_key", "_slice").orderBy("length", "path")) + F.col("_before")
    return rows.join(before, ["_key", "_slice"]).select(*files.columns, rank.cast("int").alias("size_rank"))


def write_images(df: DataFrame, out: str) -> None:
    """One row per image, as Parquet."""
    df.write.mode("overwrite").parquet(out)


def export_files(bmps: DataFrame, folder: str | None = None, *, base: str | None = None, clash: str = "number") -> DataFrame:
    """Write each ``bmp`` to its ``out_path`` or below ``folder``; see ``sink.write_files``."""
    return sink.write_files(bmps.select("out_path", F.col("bmp").alias("data")), folder, base=base, clash=clash)


def export_rows(parts: DataFrame, folder: str | None = None, *, base: str | None = None, clash: str = "number") -> DataFrame:
    """Write files in ranges of rows from ``out_path, at, bytes, size``, named as by ``sink.write_files``; returns ``out_path, target, error``.

    Names are given first, from the paths alone. Ranges of a file go to one unfinished
    file of this run; a repeated task writes the same bytes to the same place. ``parts``
    are read once; files are moved when all ranges are written, which can be repeated.
    """
    run = uuid.uuid4().hex
    parts = parts.select(sink.plain_path(F.col("out_path")).alias("out_path"), "at", "bytes", "size")
    named = stage(sink.targets(parts.select("out_path").distinct(), folder, base, clash), "names")

    def write(rows):
        f, path = None, None
        for r in rows:
            if r.target != path:
                if f:
                    f.close()
                path = r.target
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                f = os.fdopen(os.open(f"{path}.{run}.tmp", os.O_RDWR | os.O_CREAT, 0o666), "r+b")
                f.truncate(r.size)
            f.seek(r.at)
            f.write(r.bytes)
        if f:
            f.close()

    def finish(rows):
        for r in rows:
            sink.move(f"{r.target}.{run}.tmp", r.target)

    good = named.filter("target is not null")
    bound = parts.join(good.select("out_path", "target"), "out_path")
    bound.repartitionByRange("target", "at").sortWithinPartitions("target", "at").foreachPartition(write)
    good.select("target").foreachPartition(finish)
    return named
