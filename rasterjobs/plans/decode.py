"""Whole jobs: triage of headers, and decoding a corpus to blocks, pixels or files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batches, coefficients, huffman, mcus, raster, segments, validate
from ..sources.staging import stage


def image_table(segs: DataFrame) -> DataFrame:
    """One row per image with a frame: header fields, grid, sampling and scan parameters."""
    frame = segments.last_definition(segments.frame_header(segs), ["image_id"], "ord")
    parts = segments.last_definition(segments.frame_components(segs), ["image_id", "component"], "ord")
    luma = parts.filter("component = 1").select("image_id", F.col("h").alias("h_samp"), F.col("v").alias("v_samp"))
    scan = segments.scan_header(segs).select("image_id", "components_in_scan", "ss", "se", "ah", "al")
    df = frame.select("image_id", "frame_type", "precision", "height", "width", "num_components", "zero_based")
    df = df.join(luma, "image_id", "left").join(scan, "image_id", "left").join(segments.restart_interval(segs), "image_id", "left")
    df = df.withColumn("restart_interval", F.coalesce("restart_interval", F.lit(0)))
    # a grayscale image is one unit per MCU, whatever sampling it names
    lone = F.col("num_components") == 1
    df = df.withColumn("h_samp", F.when(lone, 1).otherwise(F.col("h_samp"))).withColumn("v_samp", F.when(lone, 1).otherwise(F.col("v_samp")))
    return batches.grid(df)


def _scan_tables(segs: DataFrame, images: DataFrame) -> DataFrame:
    """``images`` with ``cells, step_h, step_v, across, mcus`` of their scan; a cell has its component's tables."""
    c = segments.scan_components(segs).join(images.select("image_id", "zero_based", "h_samp", "v_samp", "components_in_scan"), "image_id")
    c = c.withColumn("component", F.col("scan_id") + F.col("zero_based").cast("int"))
    c = huffman.with_huffman(c, segments.huffman_tables(segs))
    parts = segments.last_definition(segments.frame_components(segs), ["image_id", "component"], "ord").select("image_id", "component", "quant_id")
    c = c.join(parts, ["image_id", "component"], "left").join(segments.quant_tables(segs).select("image_id", F.col("table_id").alias("quant_id"), "q"), ["image_id", "quant_id"], "left")
    times = F.when((F.col("component") == 1) & (F.col("components_in_scan") > 1), F.col("h_samp") * F.col("v_samp")).otherwise(1)
    cell = F.struct("component", "dc_counts", "dc_symbols", "ac_counts", "ac_symbols", "q")
    c = c.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("place", F.array_repeat(cell, times).alias("cells")))).alias("x"))
    c = c.select("image_id", F.flatten(F.transform("x", lambda x: x["cells"])).alias("cells"))
    df = images.join(c, "image_id")
    many = F.col("components_in_scan") > 1
    chroma = F.get("cells", 0)["component"] != 1
    for side in ("h", "v"):
        df = df.withColumn(f"step_{side}", F.when(many | chroma, F.col(f"{side}_samp")).otherwise(1))
    df = df.withColumn("across", F.ceil(F.col("du_width") / F.col("step_h")).cast("int"))
    return df.withColumn("mcus", (F.col("across") * F.ceil(F.col("du_height") / F.col("step_v"))).cast("int"))


@dataclass
class Triage:
    """Headers of a corpus; entropy bytes are never read. ``headers`` has the images with a frame, ``images`` all."""

    segs: DataFrame
    headers: DataFrame
    images: DataFrame
    errors: DataFrame
    repeated: bool = False

    @property
    def report(self) -> DataFrame:
        return validate.error_report(self.errors)


def triage(files: DataFrame, slots: int | None = None, capacity: int = batches.CAPACITY) -> Triage:
    """Which files will decode, and how large they are.

    ``files`` have ``content``, or without it ``path``: then only headers are read.
    A file that is listed twice is one image; files that share an id and differ are
    none, with an error ``repeated_id``.
    """
    segs, differ, repeated = validate.once(stage(validate.checked_segments(files), "segments"))
    segs = stage(segs, "segments-once") if repeated else segs
    images = stage(batches.work_units(image_table(segs), capacity), "images")
    errors = validate.validate(segs)
    if repeated:
        errors = errors.unionByName(differ.select("image_id", F.lit("repeated_id").alias("code"), F.lit(None).cast("string").alias("detail"), F.lit(-1).alias("ord"), F.lit(0).alias("step")))
    if slots is not None:
        errors = errors.unionByName(batches.reject_oversized(images, slots)[1].select(*errors.columns))
    return Triage(segs, images, validate.image_status(files.select("image_id").distinct(), errors).join(images, "image_id", "left"), errors, repeated)


@dataclass
class Decoded:
    """The tables of a decoded corpus."""

    images: DataFrame
    errors: DataFrame
    coefficients: DataFrame
    rgb: DataFrame

    @property
    def pixels(self) -> DataFrame:
        return raster.pixels(self.rgb, self.images)

    @property
    def rows(self) -> DataFrame:
        return raster.raster_rows(self.rgb, self.images)

    @property
    def bmps(self) -> DataFrame:
        return raster.to_bmp(self.rows, self.images)

    @property
    def bmp_rows(self) -> DataFrame:
        return raster.bmp_rows(self.rows, self.images)


def decode(files: DataFrame, *, slots: int | None = None, keep_partial: bool = False, chunk_bytes: int = huffman.CHUNK, range_bytes: int = segments.RANGE) -> Decoded:
    """Decode ``files`` (``image_id, content``, or as ``list_images`` gives them: then large files are read by several tasks).

    Files with a fatal violation are left out and reported. A file whose entropy
    data fails is left out too, unless ``keep_partial`` keeps what was decoded
    (missing units are zero), as it is for a file that ends early without an error. An image that is too large for ``bmps`` is decoded
    and has a row ``bmp_too_large`` in ``errors``; ``bmp_rows`` has its file in parts.
    A file that is listed twice is decoded once (see ``triage``).
    Entropy data of more than ``chunk_bytes`` between restart markers are decoded by several tasks,
    and a listed file is read in ranges of ``range_bytes``.
    """
    t = triage(files, slots)
    fine = validate.valid_images(t.headers, t.errors)
    chosen = t.segs.join(fine.select("image_id"), "image_id", "left_semi")
    scans = stage(_scan_tables(chosen, fine), "scans")
    intervals = stage(segments.entropy_intervals(files) if "content" in files.columns else segments.entropy_ranges(files, chosen, range_bytes), "intervals")
    if t.repeated:  # files with this id are equal, or not among the images
        intervals = stage(intervals.join(scans.select("image_id"), "image_id", "left_semi").dropDuplicates(["image_id", "interval_no"]), "intervals-once")
    rows = stage(mcus.decode_mcus(intervals, scans, chunk_bytes), "mcus")
    late = validate.scan_errors(intervals).join(scans.select("image_id"), "image_id", "left_semi").unionByName(mcus.decode_errors(rows))
    # a baseline scan that leaves components out, or ends before its last MCU
    got = rows.filter("error is null").groupBy("image_id").agg(F.count("*").alias("n"))
    short = scans.join(got, "image_id", "left").filter((F.col("frame_type") == 0) & ((F.col("components_in_scan") != F.col("num_components")) | (F.coalesce("n", F.lit(0)) < F.col("mcus"))))
    late = late.unionByName(short.select("image_id", F.lit("incomplete_scan").alias("code"), F.col("components_in_scan").cast("string").alias("detail"), F.lit(1_600_000).alias("ord"), F.lit(107).alias("step")))
    late = stage(late, "errors")
    errors = t.errors.unionByName(late)
    if not keep_partial:
        bad = late.select("image_id").distinct()
        rows, scans, fine = (df.join(bad, "image_id", "left_anti") for df in (rows, scans, fine))
    errors = errors.unionByName(raster.too_large(fine))
    blocks = coefficients.with_missing(mcus.blocks(rows), fine)
    return Decoded(fine, errors, blocks, mcus.rgb(mcus.with_missing(rows, scans)))
