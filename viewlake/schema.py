"""Schemas of image records and sparse models."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}


def fields(text: str, **nested: T.DataType) -> T.StructType:
    """A struct from 'name kind, ...'; nested types by name. Needs no session, unlike DDL."""
    pairs = (x.split() for x in text.split(", "))
    return T.StructType([T.StructField(name, nested.get(kind) or _KINDS[kind]) for name, kind in pairs])


EXIF = fields("make string, model string, focal_length_mm double, gps_latitude double, gps_longitude double")
QUALITY = fields(
    "blur_score double, blur_type string, exposure_mean double, exposure_std double, clipped_ratio double, noise_score double, sky_reflective_ratio double, flags strings"
)
IMAGE_RECORD = fields(
    "ord bigint, path string, width int, height int, exif exif, converted_path string, format string, readable boolean, source_exists boolean, parent_relative string, "
    "perceptual_hash string, notes strings, quality_metrics quality",
    exif=EXIF, quality=QUALITY,
)
ORDERED_CAMERA = fields("ord bigint, camera_id int, width bigint, height bigint")
MODEL_IMAGE = fields("ord bigint, image_id int, camera_id int, name string")
