"""Decode files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.decode import decode
from ..sources.files import FILES, output_path
from ..sources.staging import run_tables


def stream_decode(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, glob: str = "*.jp*g", files_per_batch: int | None = None, **trigger):
    """Start a query that decodes new files of ``in_dir`` into ``out_dir``; returns the StreamingQuery.

    Every micro-batch is one decoding job with two results, ``bmps`` and
    ``errors``, each partitioned by batch and overwritten if a batch is repeated.
    Its staged tables are removed with it. ``files_per_batch`` bounds a micro-batch.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob)
    files = (files.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else files).load(in_dir)

    def write(batch: DataFrame, number: int) -> None:
        with run_tables(spark):
            done = decode(batch.select(F.col("path").alias("image_id"), "content"))
            bmps = done.bmps.withColumn("out_path", output_path(F.col("image_id")))
            for name, df in (("bmps", bmps), ("errors", done.errors)):
                df.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
