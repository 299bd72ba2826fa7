"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, for local masters only."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


_runs: list[list[str]] = []


@contextmanager
def run_tables(spark: SparkSession):
    """Tables that are staged inside are removed at the end, whether the result was written or given up.

    What is read from them has to be written, or collected, before. Runs may be nested.
    """
    _runs.append([])
    try:
        yield
    finally:
        for path in _runs.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that it is made once and its lineage ends.

    Inside ``run_tables`` it is removed with the run.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _runs:
        _runs[-1].append(path)  # noted before it is written
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shard_key(shard: list[str]) -> Column:
    """The shard as text that is never null."""
    return F.to_json(F.array(*(F.col(c).cast("string") for c in shard))) if shard else F.lit("")


def range_slices(df: DataFrame, shard: list[str], order: list[Column]) -> DataFrame:
    """``df``, written down, with ``_key``, the shard as text, and ``_slice``, the number of its range.

    Ranges follow one another by shard, then ``order``, and are about equal, so a
    large shard has many. Rows of equal shard and order share a range.
    """
    out = df.withColumn("_key", shard_key(shard)).repartitionByRange(F.col("_key").asc(), *order)
    return stage(out.withColumn("_slice", F.spark_partition_id()), "slices")
