"""Sparse camera models: text and binary files."""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Callable, Iterator
from functools import partial
from itertools import dropwhile, islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from viewlake.config import MODEL_FILES
from viewlake.operators.stats import with_cameras
from viewlake.schema import MODEL_IMAGE, ORDERED_CAMERA

#: Records per batch, and bytes read ahead for a name.
PIECE, NAME_BYTES = 10_000, 128
# fixed values: number of parameters per camera model id
PARAMETERS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}


def detect_model(folder: str) -> str | None:
    """'binary' or 'text' if a folder holds all files of a model (binary first), else None."""
    if not os.path.isdir(folder):
        return None
    names = {e.name for e in os.scandir(folder) if e.is_file()}
    for kind, ending in (("binary", ".bin"), ("text", ".txt")):
        if {f + ending for f in MODEL_FILES} <= names:
            return kind
    return None


class Reader:
    """Little-endian fields of an open file, read in turn; ValueError at its end."""

    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, io.SEEK_END)
        file.seek(0)

    def take(self, fmt: str) -> tuple:
        size = struct.calcsize(fmt)
        data = self.file.read(size)
        if len(data) < size:
            raise ValueError("file ends in the middle of a record")
        return struct.unpack(fmt, data)

    def skip(self, size: int) -> None:
        if self.file.seek(size, io.SEEK_CUR) > self.size:
            raise ValueError("file ends in the middle of a record")

    def name(self) -> str:
        at, out = self.file.tell(), b""
        while b"\0" not in out:
            more = self.file.read(NAME_BYTES)
            if not more:
                raise ValueError("file ends in the middle of a name")
            out += more
        out = out[: out.index(b"\0")]
        self.file.seek(at + len(out) + 1)
        return out.decode("utf-8")


def cameras_binary(file: BinaryIO) -> Iterator[tuple[int, int, int, int]]:
    """(ord, camera_id, width, height) in file order."""
    r = Reader(file)
    for i in range(r.take("<Q")[0]):
        camera, kind, width, height = r.take("<iiQQ")
        if kind not in PARAMETERS:
            raise ValueError(f"unknown camera model {kind}")
        r.skip(8 * PARAMETERS[kind])
        yield i, camera, width, height


def images_binary(file: BinaryIO) -> Iterator[tuple[int, int, int, str]]:
    """(ord, image_id, camera_id, name) in file order; points are skipped unread."""
    r = Reader(file)
    for i in range(r.take("<Q")[0]):
        (image,) = r.take("<i")
        r.skip(7 * 8)
        (camera,) = r.take("<i")
        name = r.name()
        r.skip(24 * r.take("<Q")[0])
        yield i, image, camera, name


def _lines(file: BinaryIO) -> Iterator[str]:
    for line in io.TextIOWrapper(file, encoding="utf-8"):
        line = line.rstrip("\n")
        if not line.startswith("#"):
            yield line.strip(" \t\r")


def _field(parts: list[str], at: int) -> str:
    if at >= len(parts):
        raise ValueError("a line has too few fields")
    return parts[at]


def cameras_lines(file: BinaryIO) -> Iterator[tuple[int, int, int, int]]:
    """(ord, camera_id, width, height) of cameras.txt; comments and blank lines skipped."""
    for i, line in enumerate(x for x in _lines(file) if x and not x.startswith("#")):
        parts = line.split()
        yield i, int(parts[0]), int(_field(parts, 2)), int(_field(parts, 3))


def images_lines(file: BinaryIO, keep_empty_points: bool = False) -> Iterator[tuple[int, int, int, str]]:
    """(ord, image_id, camera_id, name) of images.txt.

    Every second line is an image. By default blank lines are dropped before counting,
    so an image whose line of points is empty shifts the rest; with
    ``keep_empty_points`` only leading and comment lines are dropped and such images are read right.
    A name with blanks ends at the first one.
    """
    lines = _lines(file)
    lines = dropwhile(lambda x: not x, lines) if keep_empty_points else (x for x in lines if x)
    for pos, line in enumerate(lines):
        if pos % 2 == 0 and line:
            parts = line.split()
            yield pos // 2, int(parts[0]), int(_field(parts, 8)), _field(parts, 9)


READERS = {("binary", "cameras"): cameras_binary, ("binary", "images"): images_binary, ("text", "cameras"): cameras_lines, ("text", "images"): images_lines}


def read_cameras_binary(data: bytes) -> list[tuple[int, int, int]]:
    """(camera_id, width, height); a later camera of the same id replaces an earlier one."""
    return list({c: (c, w, h) for _, c, w, h in cameras_binary(io.BytesIO(data))}.values())


def read_images_binary(data: bytes) -> list[tuple[int, int, int, str]]:
    """(ord, image_id, camera_id, name) in file order."""
    return list(images_binary(io.BytesIO(data)))


def _path(folder: str, kind: str, part: str) -> str:
    return os.path.join(folder, part + (".bin" if kind == "binary" else ".txt"))


def check_model(folder: str, kind: str) -> None:
    """ValueError if a file of the model is damaged. The files are walked through once, record by record, and nothing of them is kept."""
    for part in MODEL_FILES[:2]:
        with open(_path(folder, kind, part), "rb") as f:
            for _ in READERS[kind, part](f):
                pass


def _parsed(spark: SparkSession, path: str, read: Callable, schema: T.StructType) -> DataFrame:
    """Records of one file, read by one task in pieces: they vary in length, so it can't be split. The file must be visible to all executors."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open(name, "rb") as f:
                    rows = read(f)
                    while piece := list(islice(rows, PIECE)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*piece), arrow.types)], schema=arrow)

    return spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(run, schema)


def _last(cameras: DataFrame) -> DataFrame:
    last = cameras.groupBy("camera_id").agg(F.max(F.struct("ord", "width", "height")).alias("r"))
    return last.select("camera_id", "r.width", "r.height")


def cameras_text(spark: SparkSession, path: str) -> DataFrame:
    """camera_id, width, height of cameras.txt; the last row of an id counts."""
    return _last(_parsed(spark, path, cameras_lines, ORDERED_CAMERA))


def images_text(spark: SparkSession, path: str, keep_empty_points: bool = False) -> DataFrame:
    """ord, image_id, camera_id, name of images.txt, as ``images_lines``."""
    return _parsed(spark, path, partial(images_lines, keep_empty_points=keep_empty_points), MODEL_IMAGE)


def read_model(spark: SparkSession, folder: str) -> tuple[str, DataFrame, DataFrame]:
    """(kind, cameras, images) of a model folder; ValueError if it is none. points3D is required but not read."""
    kind = detect_model(folder)
    if kind is None:
        raise ValueError(f"no sparse model in {folder}")
    cameras, images = (_path(folder, kind, part) for part in MODEL_FILES[:2])
    return kind, _last(_parsed(spark, cameras, READERS[kind, "cameras"], ORDERED_CAMERA)), _parsed(spark, images, READERS[kind, "images"], MODEL_IMAGE)


def model_records(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Image records of a model: the name as path, the size of the camera (0 by 0 if missing), no known source."""
    rows = with_cameras(images, cameras, ["camera_id"])
    none = lambda kind: F.lit(None).cast(kind)
    from viewlake.schema import EXIF, QUALITY

    return rows.select(
        "ord", F.col("name").alias("path"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), none(EXIF).alias("exif"), none("string").alias("converted_path"),
        none("string").alias("format"), F.lit(True).alias("readable"), none("boolean").alias("source_exists"), none("string").alias("parent_relative"), none("string").alias("perceptual_hash"),
        F.array(F.lit("from a sparse model; the file was not opened")).alias("notes"), none(QUALITY).alias("quality_metrics"),
    )
