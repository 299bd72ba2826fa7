"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, HERE)

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rasterjobs.plans import fixtures  # noqa: E402
from rasterjobs.plans.decode import decode  # noqa: E402
from rasterjobs.queries import QUERIES  # noqa: E402
from rasterjobs.sources.staging import stage  # noqa: E402

HEADLINE = ["dc_predict", "ycc_to_rgb", "extend_sign", "idct", "pixels", "pack_batches", "image_status", "entropy_roundtrip", "decode_corpus"]


#: Copies of each fixture file in the measure of throughput.
COPIES = 20


def throughput(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Bytes of colour files a second, from the files to RGB blocks; each file stands ``COPIES`` times, without restart markers."""
    files = stage(fixtures.jpegs(spark, sf_dir, restart=0, down=64), "bench")
    many = files.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).select((F.col("image_id") * COPIES + F.col("copy")).alias("image_id"), "content")
    many = stage(many.repartition(2 * spark.sparkContext.defaultParallelism), "bench")
    size = many.agg(F.sum(F.length("content"))).first()[0]
    began = time.time()
    decode(many).rgb.write.format("noop").mode("overwrite").save()
    took = time.time() - began
    return {"decode_sec": round(took, 3), "decode_mb": round(size / 1e6, 3), "decode_mb_per_sec": round(size / 1e6 / took, 3)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16)).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    extra = throughput(spark, sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "throughput": extra}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
