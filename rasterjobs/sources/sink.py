"""Files written by tasks that may be repeated: a data source writer, and names that may clash.

Each attempt of a task writes files of its own, named by the attempt, after it has
noted them in its list. Spark commits one attempt of each task; the commit moves its
list from ``begun`` to ``committed``. Only then are names given, in a job over the
lists alone, so that two rows never share a name, and files are moved to their names.
Moving is repeatable. What lost attempts have noted is removed in the end.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.window import Window as W

from .staging import shared_dir, stage

_LIST = "out_path string, file string, size long"


def plain_path(path: Column) -> Column:
    """A path without the scheme of local files."""
    return F.regexp_replace(path, r"^file:/+", "/")


@dataclass
class Attempt(WriterCommitMessage):
    name: str


class FileWriter(DataSourceWriter):
    """Writes rows (``out_path, data``) as files of an attempt, below ``work`` or, with ``beside``, next to their target."""

    def __init__(self, work: str, beside: bool):
        self.work, self.beside = work, beside

    def write(self, iterator) -> Attempt:
        name = uuid.uuid4().hex
        own = os.path.join(self.work, "files", name)
        if not self.beside:
            os.makedirs(own)
        with open(os.path.join(self.work, "begun", name), "w", encoding="utf-8") as listed:
            for n, row in enumerate(iterator):
                data = bytes(row.data or b"")
                file = os.path.join(os.path.dirname(row.out_path), f".{name}-{n}.tmp") if self.beside else os.path.join(own, str(n))
                listed.write(json.dumps({"out_path": row.out_path, "file": file, "size": len(data)}) + "\n")
                listed.flush()  # noted before it exists
                with open(file, "wb") as f:
                    f.write(data)
        return Attempt(name)

    def commit(self, messages) -> None:
        for m in messages:  # one for each task
            if m is not None:
                os.replace(os.path.join(self.work, "begun", m.name), os.path.join(self.work, "committed", m.name))

    def abort(self, messages) -> None:
        remove_attempts(self.work)


class FileSink(DataSource):
    """``df.write.format("imagefiles")`` with the options ``work`` and ``beside``."""

    @classmethod
    def name(cls) -> str:
        return "imagefiles"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["work"], self.options.get("beside") == "true")


def remove_attempts(work: str) -> None:
    """Removes the files that attempts have noted and that were not committed, and ``work`` itself."""
    begun = os.path.join(work, "begun")
    for name in os.listdir(begun) if os.path.isdir(begun) else ():  # attempts that were lost
        with open(os.path.join(begun, name), encoding="utf-8") as listed:
            for line in listed:
                if line.endswith("\n"):
                    file = json.loads(line)["file"]
                    if os.path.exists(file):
                        os.remove(file)
    shutil.rmtree(work, ignore_errors=True)


def targets(paths: DataFrame, folder: str | None, base: str | None, clash: str) -> DataFrame:
    """``paths`` (``out_path`` and what else tells rows apart) with ``target`` and ``error``.

    Without ``folder`` a file goes to its path. With it, to its path below ``base``,
    or without ``base`` to its last part. Of rows with one target the first, by path,
    has it; the others get their path's md5, and a number if the path is the same too
    (``clash`` "number"), or all of them get the error ``output_clash`` and no target
    ("report").
    """
    if clash not in ("number", "report"):
        raise ValueError(clash)
    others = [F.col(f"`{c}`") for c in paths.columns if c != "out_path"]
    path = plain_path(F.col("out_path"))
    if folder is None:
        wanted = path
    else:
        below = F.element_at(F.split(path, "/"), -1) if base is None else F.when(F.startswith(path, F.lit(base.rstrip("/") + "/")), F.substring(path, F.lit(len(base.rstrip("/")) + 2), F.length(path))).otherwise(F.ltrim(path, F.lit("/")))
        wanted = F.concat(F.lit(folder.rstrip("/") + "/"), below)
    d = paths.withColumn("target", wanted)
    if clash == "report":
        many = F.count("*").over(W.partitionBy("target")) > 1
        return d.withColumn("error", F.when(many, "output_clash")).withColumn("target", F.when(F.col("error").isNull(), F.col("target")))
    place = F.row_number().over(W.partitionBy("target").orderBy("out_path", *others))
    again = F.row_number().over(W.partitionBy("target", "out_path").orderBy(*others, F.lit(0)))
    mark = F.concat(F.lit("-"), F.substring(F.md5("out_path"), 1, 12), F.when(F.col("_again") > 1, F.concat(F.lit("-"), F.col("_again"))).otherwise(""))
    d = d.withColumn("_place", place).withColumn("_again", again)
    stem, end = (F.regexp_extract("target", r"^(.*?)(\.[^./]*)?$", k) for k in (1, 2))
    named = F.when(F.col("_place") == 1, F.col("target")).otherwise(F.concat(stem, mark, end))
    return d.withColumn("target", named).withColumn("error", F.lit(None).cast("string")).drop("_place", "_again")


def move(file: str, target: str) -> None:
    """Moves a finished file to its name; done before, it is left alone."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    try:
        os.replace(file, target)
    except FileNotFoundError:
        if not os.path.exists(target):
            raise


def new_work(spark: SparkSession, folder: str | None) -> str:
    """A folder for the lists of a run, and for its files if they are bound for ``folder``."""
    where = folder or "/" + shared_dir(spark).removeprefix("file:").lstrip("/")
    work = os.path.join(where, f"_attempts-{uuid.uuid4().hex}")
    for part in ("begun", "committed", "files"):
        os.makedirs(os.path.join(work, part))
    return work


def publish(spark: SparkSession, work: str, folder: str | None, base: str | None, clash: str) -> DataFrame:
    """Gives the committed files of ``work`` their names; ``out_path, target, size, error`` of each."""
    listed = spark.read.schema(_LIST).json(f"file://{work}/committed")
    plan = stage(targets(listed, folder, base, clash), "published")
    twice = plan.filter("target is not null").groupBy("target").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"two files would be named {twice.first().target}")

    def run(rows):
        for r in rows:
            if r.target is not None:
                move(r.file, r.target)
            elif os.path.exists(r.file):
                os.remove(r.file)

    plan.foreachPartition(run)
    remove_attempts(work)
    return plan.drop("file")


def write_files(rows: DataFrame, folder: str | None = None, *, base: str | None = None, clash: str = "number") -> DataFrame:
    """Write each ``data`` to its ``out_path``, or below ``folder`` (see ``targets``), on storage that all executors mount.

    Returns ``out_path, target, size, error``. Null data are an empty file; a null
    path is an error of the job. An earlier file of the same name is replaced. If the
    job fails, no file is left.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    if folder is not None:
        folder = "/" + folder.removeprefix("file:").lstrip("/")
        os.makedirs(folder, exist_ok=True)
    work = new_work(spark, folder)
    try:
        out = rows.select(plain_path(F.col("out_path")).alias("out_path"), F.col("data").cast("binary").alias("data"))
        out.write.format("imagefiles").option("work", work).option("beside", str(folder is None).lower()).mode("append").save()
        return publish(spark, work, folder, base, clash)
    except BaseException:
        remove_attempts(work)
        raise
