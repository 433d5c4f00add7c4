"""Statistics of image collections: one row per collection, one pass over the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewlake.config import FOLDER_IMAGES
from viewlake.functions.columns import has_exif, has_size, orientation, pixels, resolution_label
from viewlake.session import Scratch


def _sized(records: DataFrame) -> DataFrame:
    return records.where(has_size(F.col("readable"), F.col("width"), F.col("height")))


def unreadable(records: DataFrame) -> DataFrame:
    return records.where(~F.coalesce("readable", F.lit(False)))


def unique_resolutions(records: DataFrame, group: str) -> DataFrame:
    """(group, resolution, images), resolutions of readable images with a size."""
    return _sized(records).groupBy(group, resolution_label(F.col("width"), F.col("height")).alias("resolution")).agg(F.count(F.lit(1)).alias("images"))


def orientations(records: DataFrame, group: str, order: str) -> DataFrame:
    """(group, orientation, images, first_seen): histogram with the order in which the kinds first appear."""
    return _sized(records).groupBy(group, orientation(F.col("width"), F.col("height")).alias("orientation")).agg(F.count(F.lit(1)).alias("images"), F.min(order).alias("first_seen"))


def resolution_variation(records: DataFrame, group: str) -> DataFrame:
    """(group, images, pixel_count_variation)."""
    p = pixels(F.col("width"), F.col("height")).cast("decimal(19,0)")
    t = _sized(records).groupBy(group).agg(F.count(F.lit(1)).alias("images"), F.sum(p).cast("decimal(38,0)").alias("s"), F.sum((p * p).cast("decimal(38,0)")).cast("decimal(38,0)").alias("q"))
    var = (F.col("images").cast("double") * F.col("q").cast("double") - F.col("s").cast("double") * F.col("s").cast("double"))
    ratio = F.coalesce(F.try_divide(F.sqrt(F.greatest(var, F.lit(0.0))), F.col("s").cast("double")), F.lit(0.0))
    return t.select(group, "images", F.round(ratio, 4).alias("pixel_count_variation"))


def exif_counts(records: DataFrame, group: str) -> DataFrame:
    """(group, readable, with_exif, with_focal, with_position) of readable images."""
    e = F.col("exif")
    rows = records.where("readable")
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("readable"), F.count_if(has_exif(e)).alias("with_exif"), F.count_if(e["focal_length_mm"].isNotNull()).alias("with_focal"),
        F.count_if(e["gps_latitude"].isNotNull() & e["gps_longitude"].isNotNull()).alias("with_position"),
    )


def folders(records: DataFrame, group: str, least: int = FOLDER_IMAGES) -> DataFrame:
    """(group, parent_relative, images) of folders with at least ``least`` readable images; null and '' are no folder, '.' is one."""
    named = records.where(F.coalesce("readable", F.lit(False)) & (F.col("parent_relative") != ""))
    return named.groupBy(group, "parent_relative").agg(F.count(F.lit(1)).alias("images")).where(F.col("images") >= least)


def focal_ratio(records: DataFrame, group: str) -> DataFrame:
    """(group, shortest, longest, ratio) of focal lengths of readable images; ratio null unless the shortest is above 0. NaN is no focal length."""
    f = F.col("exif.focal_length_mm")
    rows = records.where(F.col("readable") & f.isNotNull() & ~F.isnan(f))
    t = rows.groupBy(group).agg(F.min(f).alias("shortest"), F.max(f).alias("longest"))
    return t.withColumn("ratio", F.when(F.col("shortest") > 0, F.col("longest") / F.col("shortest")))


def last_rows(rows: DataFrame, key: list[str], order: Column, values: list[str]) -> DataFrame:
    """The last row of each key; ties go to the largest values."""
    t = rows.groupBy(*key).agg(F.max(F.struct(order.alias("_o"), *values)).alias("r"))
    return t.select(*key, *(F.col(f"r.{v}").alias(v) for v in values))


def with_cameras(images: DataFrame, cameras: DataFrame, keys: list[str]) -> DataFrame:
    """Model images with the size of their camera, 0 by 0 where it is missing. cameras: one row per key."""
    out = images.join(cameras.select(*keys, "width", "height"), keys, "left")
    return out.withColumn("width", F.coalesce("width", F.lit(0))).withColumn("height", F.coalesce("height", F.lit(0)))


def keep_first(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each value of a group once, at the place where it first appears."""
    return rows.groupBy(group, value).agg(F.min(order).alias(order))


def first_per_bucket(rows: DataFrame, key: str, time: str, seconds: float, tie: str) -> DataFrame:
    """The first row of each key and time bucket: a frame rate of 1 / seconds."""
    bucket = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(int(seconds * 1_000_000))).cast("bigint")
    t = rows.withColumn("bucket", bucket)
    first = F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(time, tie))
    return t.where(F.col(time).isNotNull()).groupBy(key, "bucket").agg(first.alias("r")).select(key, "bucket", "r.*")


def component_order(records: DataFrame, group: str, path: str, key: Column) -> DataFrame:
    """Place (from 1) of each path of a group in the order of ``key``, then path.

    The rows are range-partitioned by group and key, so a large group is sorted in several tasks;
    a place is the row's position in its part plus the rows of its group in parts before.
    """
    scratch = Scratch(records.sparkSession)
    rows = records.withColumn("_key", key)
    sorted_rows = rows.repartitionByRange(F.col(group), F.col("_key"), F.col(path)).sortWithinPartitions(group, "_key", path).drop("_key")
    numbered = scratch.write(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "sorted")
    # the upper bits of the number are the part, the lower 33 the position in it
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    parts = numbered.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    joined = numbered.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("place", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_group", "_p", "_first", "_before")
