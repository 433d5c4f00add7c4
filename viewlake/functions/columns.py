"""Column expressions over image records; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewlake.config import IMAGE_SUFFIXES, AuditConfig


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last component, '' for none; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def is_supported_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def path_order(path: Column) -> Column:
    """Sort key of a path: component by component, so /a/b/x comes before /a/b.c/x."""
    return F.split(path, "/")


def parent_key(path: Column, base: str) -> Column:
    """Folder of a file relative to ``base``: '.' for base itself; a folder outside keeps only its last component."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    root = base.rstrip("/")
    inside = F.substring(folder, len(root) + 2, 1 << 30)
    return F.when(folder == root, ".").when(F.startswith(folder, F.lit(root + "/")), inside).otherwise(F.element_at(F.split(folder, "/"), -1))


def resolution_label(width: Column, height: Column) -> Column:
    return F.concat_ws("x", width.cast("string"), height.cast("string"))


def has_size(readable: Column, width: Column, height: Column) -> Column:
    return F.coalesce(readable & (width > 0) & (height > 0), F.lit(False))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width == height, "square").when(width > height, "landscape").otherwise("portrait")


def pixels(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height.cast("bigint")


def has_exif(exif: Column) -> Column:
    """Whether any of the five values is there."""
    names = ("make", "model", "focal_length_mm", "gps_latitude", "gps_longitude")
    found = exif[names[0]].isNotNull()
    for n in names[1:]:
        found = found | exif[n].isNotNull()
    return F.coalesce(found, F.lit(False))


def rational(numerator: Column, denominator: Column) -> Column:
    """A rational as double; null for denominator 0 or a part that is no number."""
    return F.try_divide(numerator.try_cast("double"), denominator.try_cast("double"))


def dms_to_decimal(parts: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds (array of three doubles) as signed degrees; null unless all three are there. No reference counts as positive."""
    whole = F.when((F.size(parts) == 3) & F.forall(parts, lambda x: x.isNotNull()), F.get(parts, 0) + F.get(parts, 1) / 60 + F.get(parts, 2) / 3600)
    return F.when(ref.isin("S", "W"), -whole).otherwise(whole)


def hash_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def parse_hash(text: Column) -> Column:
    """A written 64-bit hash as bigint, null if it isn't one; case, blanks, a leading 0x and leading zeros make no difference."""
    digits = F.regexp_extract(F.lower(F.translate(text, " \t", "")), "^(?:0x)?0*([0-9a-f]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def average_hash(values: Column) -> Column:
    """64 values as bits, 1 where a value is strictly above the mean; the first is the highest. A uniform tile hashes to 0."""
    mean = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double")) / F.size(values)
    bits = F.transform(values, lambda v: F.when(v.cast("double") > mean, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))


def quality_flags(q: Column, config: AuditConfig = AuditConfig()) -> Column:
    """Names of the thresholds that unrounded metrics break, in fixed order; a value equal to its threshold breaks nothing."""
    exposure = q["exposure_mean"]
    return F.array_compact(F.array(
        F.when(q["blur_score"] < config.blur_threshold, "blurry"),
        F.when(exposure < config.exposure_min, "underexposed").when(exposure > config.exposure_max, "overexposed"),
        F.when(q["clipped_ratio"] > config.clipped_threshold, "clipped_highlights"),
        F.when(q["noise_score"] > config.noise_threshold, "high_noise"),
        F.when(q["sky_reflective_ratio"] > config.sky_threshold, "sky_or_reflective_dominance"),
    ))
