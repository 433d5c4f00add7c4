"""Streams of image files and of scan records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlake.functions import kernels
from viewlake.sources.headers import NotAnImage, ppm_pixels, read_header

SCHEMA = "path string, format string, width int, height int, readable boolean, perceptual_hash string, blur_score double, exposure_mean double, clipped_ratio double, noise_score double, sky_reflective_ratio double"


def measured(files: DataFrame) -> DataFrame:
    """Measures of (path, content) rows; stateless, so it works on streams in append mode as on tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = dict.fromkeys(names) | {"path": path, "width": 0, "height": 0, "readable": False}
                try:
                    kind, w, h, _ = read_header(data or b"")
                    row |= {"format": kind, "width": w, "height": h, "readable": True}
                    bgr = ppm_pixels(data)
                    row["perceptual_hash"] = f"{kernels.average_hash(bgr):016x}"
                    row |= {k: float(v[0]) for k, v in kernels.measures(bgr[None]).items() if k in names}
                except NotAnImage:
                    pass
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def stream_folder(spark: SparkSession, folder: str, pattern: str = "*.ppm") -> DataFrame:
    """New image files of a folder as a stream of measures."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(folder)
    return measured(files)


def scans_per_window(records: DataFrame, time: str = "scanned_at", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Scans and unreadable scans per folder and window of event time, on a stream of image records with late rows."""
    rows = records.withWatermark(time, late)
    return rows.groupBy(F.window(time, window), "parent_relative").agg(F.count(F.lit(1)).alias("scans"), F.count_if(~F.coalesce("readable", F.lit(False))).alias("unreadable"))
