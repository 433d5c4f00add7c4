"""Image folders as DataFrames of image records, with hashes and measures where pixels can be decoded."""

from __future__ import annotations

import mmap
import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructType

from viewlake.config import IMAGE_SUFFIXES, AuditConfig
from viewlake.functions import kernels
from viewlake.functions.columns import quality_flags
from viewlake.schema import IMAGE_RECORD
from viewlake.session import Scratch, local_path, shared_dir
from viewlake.sources.headers import NotAnImage, is_deep_gray, ppm_pixels, read_header

#: Formats whose pixels the JVM decodes.
JVM_FORMATS = ("PNG", "BMP", "TIFF", "JPEG")
#: Decoded images that a Python worker gets at a time.
IMAGES_AT_ONCE = 2
METRICS = ["blur_score", "exposure_mean", "exposure_std", "clipped_ratio", "noise_score", "sky_reflective_ratio"]


def is_supported(name: str) -> bool:
    return Path(name).suffix.lower() in IMAGE_SUFFIXES


def list_images(root: str, recursive: bool = False) -> list[str]:
    """Image files below a folder in component order, links resolved; two links to one file give it twice.

    Built-in file sources leave out names that begin with _ or ., which count here.
    """
    base = Path(root)
    found = base.rglob("*") if recursive else base.glob("*")
    return [str(p) for p in sorted(p.resolve() for p in found if p.is_file() and is_supported(p.name))]


def decode(data: bytes):
    """BGR pixels; only PPM is decoded in Python."""
    return ppm_pixels(data)


def _measured(bgr: np.ndarray) -> dict:
    measures = {k: float(v[0]) for k, v in kernels.measures(bgr[None]).items()}
    return {"perceptual_hash": f"{kernels.average_hash(bgr):016x}", "quality_metrics": measures | {"blur_type": "laplacian_variance"}}


def scan(spark: SparkSession, paths: list[str], base: str, *, pixels: bool = True, partitions: int | None = None) -> DataFrame:
    """Image records of the given files.

    A file that can't be read becomes a row with readable false, size 0 and a note. Where
    ``pixels`` is asked for, hash and measures are taken from the pixels: of PPM from the
    same bytes, of ``JVM_FORMATS`` in a second read, by the JVM. What stays undecoded has
    a note. Paths must be visible to all executors.
    """
    n = partitions or max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame(list(enumerate(paths)), "ord bigint, path string").repartition(n)
    root = str(Path(base).resolve())
    links = _link_folder(spark) if pixels else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for order, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = os.path.dirname(path)
                parent = "." if folder == root else os.path.relpath(folder, root) if folder.startswith(root + "/") else os.path.basename(folder)
                row = {"ord": order, "path": path, "width": 0, "height": 0, "readable": False, "source_exists": os.path.exists(path), "parent_relative": parent, "notes": [], "by_jvm": False}
                try:
                    with open(path, "rb") as f, _mapped(f) as data:  # of a header only the pages it is on are read
                        kind, w, h, exif = read_header(data)
                        row |= {"format": kind, "width": w, "height": h, "readable": True, "exif": exif or None}
                        if pixels:
                            try:
                                if kind in JVM_FORMATS:
                                    if is_deep_gray(data):
                                        raise NotAnImage("gray of more than 8 bits")
                                    if links is None:
                                        raise NotAnImage("the shared folder takes no links")
                                    row["by_jvm"] = True
                                    _link(path, f"{links}/{order}")
                                else:
                                    row |= _measured(decode(data[:]))
                            except NotAnImage as e:
                                row["notes"].append(f"pixels were not decoded: {e}")
                except (OSError, NotAnImage) as e:
                    row["notes"].append(f"could not be read: {e}")
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = StructType([*IMAGE_RECORD.fields]).add("by_jvm", BooleanType())
    arrow = to_arrow_schema(schema)
    records = rows.mapInArrow(run, schema)
    if not pixels:
        return records.drop("by_jvm")
    scratch = Scratch(spark)
    try:
        records, told = scratch.write_observed(records, "headers", {"by_jvm": F.count(F.when(F.col("by_jvm"), 1))})
        if not told["by_jvm"]:
            return records.drop("by_jvm")
        measured = _measures_by_jvm(spark, scratch, links).select("ord", F.col("perceptual_hash").alias("_hash"), F.col("quality_metrics").alias("_metrics"))
    finally:
        if links:
            shutil.rmtree(links, ignore_errors=True)
    out = records.join(measured, "ord", "left")
    note = F.array(F.lit("pixels were not decoded: the JVM can't"))
    return out.select(
        *(
            F.coalesce("perceptual_hash", "_hash").alias(c) if c == "perceptual_hash" else F.coalesce("quality_metrics", "_metrics").alias(c) if c == "quality_metrics"
            else F.when(F.col("by_jvm") & F.col("_hash").isNull(), F.concat("notes", note)).otherwise(F.col("notes")).alias(c) if c == "notes" else F.col(c)
            for c in IMAGE_RECORD.names
        )
    )


def _mapped(file):
    try:
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    except ValueError as e:
        raise NotAnImage("empty file") from e


def _link(path: str, link: str) -> None:
    """A symbolic link; one that an earlier attempt of the task left is as good."""
    try:
        os.symlink(path, link)
    except FileExistsError:
        pass


def _link_folder(spark: SparkSession) -> str | None:
    try:
        links = local_path(f"{shared_dir(spark)}/links-{uuid.uuid4().hex}")
    except ValueError:
        return None
    os.makedirs(links)
    return links


def _measures_by_jvm(spark: SparkSession, scratch: Scratch, links: str) -> DataFrame:
    """(ord, perceptual_hash, quality_metrics) of the files that the JVM decodes.

    Files are given to the reader as links named by their place, in the shared folder: so
    names that it leaves out (_, .) or takes for patterns count, and rows find their records.
    """
    schema = StructType([f for f in IMAGE_RECORD.fields if f.name in ("ord", "perceptual_hash", "quality_metrics")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for order, h, w, channels, data in zip(*(batch.column(i) for i in range(5))):
                px = np.frombuffer(data.as_buffer(), np.uint8).reshape(h.as_py(), w.as_py(), channels.as_py())
                bgr = np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px[..., :3]  # without alpha
                out.append({"ord": order.as_py()} | _measured(bgr))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    decoded = scan_with_jvm(spark, f"file://{links}").where("w > 0 AND h > 0")
    decoded = decoded.select(F.regexp_extract("path", r"(\d+)$", 1).cast("bigint").alias("ord"), "h", "w", "channels", "data")
    # pixels are large: a batch of the usual number of rows wouldn't fit
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, IMAGES_AT_ONCE)
    try:
        return scratch.write(decoded.mapInArrow(run, schema), "measured")
    finally:
        spark.conf.set(setting, before)


def with_quality(records: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Records with flags from unrounded measures, and then the measures rounded to four places."""
    q = F.col("quality_metrics")
    fields = [F.round(q[m], 4).alias(m) for m in METRICS]
    rated = F.struct(fields[0], q["blur_type"].alias("blur_type"), *fields[1:], quality_flags(q, config).alias("flags"))
    return records.withColumn("quality_metrics", F.when(q.isNotNull(), rated))


def scan_with_jvm(spark: SparkSession, folder: str) -> DataFrame:
    """(path, h, w, bgr) of PNG, BMP, TIFF and JPEG files, decoded by the JVM; undecodable files have w -1 or, if damaged, no row."""
    rows = spark.read.format("image").option("dropInvalid", False).option("ignoreCorruptFiles", True).load(folder)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
