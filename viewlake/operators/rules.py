"""Findings of an audit from one row of statistics per collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlake.config import CLEANUP_IMAGES, FOCAL_RATIO, FOLDERS, SCENE_IMAGES, AuditConfig
from viewlake.operators import stats

# fixed values: codes and severities that readers of reports look for
#: (code, severity) in the order in which findings are listed.
FINDINGS = [
    ("too_few_images", "error"), ("low_image_count", "warning"), ("unreadable_images", "error"), ("mixed_orientations", "warning"),
    ("resolution_variance", "warning"), ("missing_exif", "warning"), ("duplicate_images", "warning"), ("multiple_parent_groups", "warning"),
    ("mixed_focal_lengths", "warning"), ("flagged_image_quality", "warning"),
]
#: Advice per finding, in the order of advice (scene advice comes last, the focal one before the folder one).
ADVICE = [
    ("too_few_images", "Take or add more views of the scene."), ("low_image_count", "More overlapping views would help."),
    ("unreadable_images", "Export unreadable files again or take them out."), ("mixed_orientations", "Hold the camera the same way throughout."),
    ("resolution_variance", "Bring all images to one resolution."), ("missing_exif", "Use the original files with their metadata."),
    ("duplicate_images", "Thin out frames that show the same."), ("mixed_focal_lengths", "Check that the set shows one scene with one lens setting."),
    ("multiple_parent_groups", "Separate scenes that do not belong together."), ("flagged_image_quality", "Look through the flagged images."),
    ("many_flagged", "Consider removing flagged images before training."),
]


def collection_facts(records: DataFrame, group: str, order: str, clusters: DataFrame | None, config: AuditConfig = AuditConfig()) -> DataFrame:
    """One row per collection with what the findings need.

    records: the columns of image records, ``order`` being their place. ``clusters``:
    (group, cluster, members) or None where duplicates aren't looked for.
    """
    w, h, readable = F.col("width"), F.col("height"), F.coalesce("readable", F.lit(False))
    sized = F.coalesce(readable & (w > 0) & (h > 0), F.lit(False))
    q = F.col("quality_metrics")
    counted = records.groupBy(group).agg(
        F.count(F.lit(1)).alias("images"), F.count_if(readable).alias("n_readable"), F.count_if(~readable).alias("n_unreadable"),
        F.count_if(sized & (w > h)).alias("landscape"), F.count_if(sized & (w < h)).alias("portrait"),
        F.count_if(q.isNotNull()).alias("analysed"), F.count_if(F.size(q["flags"]) > 0).alias("flagged"),
    )
    facts = counted.join(stats.resolution_variation(records, group).select(group, "pixel_count_variation"), group, "left")
    facts = facts.join(stats.exif_counts(records, group).select(group, "with_exif"), group, "left")
    per_folder = stats.folders(records, group).groupBy(group).agg(F.count(F.lit(1)).alias("n_folders"))
    facts = facts.join(per_folder, group, "left").join(stats.focal_ratio(records, group).select(group, F.col("ratio").alias("focal_ratio")), group, "left")
    if clusters is None:
        facts = facts.withColumn("n_clusters", F.lit(0).cast("bigint")).withColumn("n_duplicates", F.lit(0).cast("bigint"))
    else:
        per = clusters.groupBy(group).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum(F.col("members") - 1).alias("n_duplicates"))
        facts = facts.join(per, group, "left")
    return facts.fillna(0, ["pixel_count_variation", "with_exif", "n_folders", "n_clusters", "n_duplicates"])


def findings(facts: DataFrame, group: str, config: AuditConfig = AuditConfig(), *, sparse_model: bool = False, quality: bool = True) -> DataFrame:
    """(group, ord, severity, code, message): all conditions of a collection in one pass over its row."""
    n, scene = F.col("images"), F.col("n_readable") >= SCENE_IMAGES
    text = lambda c: F.col(c).cast("string")
    tests = {
        "too_few_images": (n < config.min_image_count, F.concat(text("images"), F.lit(f" images; at least {config.min_image_count} are needed"))),
        "low_image_count": ((n >= config.min_image_count) & (n < config.warn_image_count), F.concat(text("images"), F.lit(f" images; {config.warn_image_count} are advised"))),
        "unreadable_images": (F.col("n_unreadable") > 0, F.concat(text("n_unreadable"), F.lit(" files could not be read"))),
        "mixed_orientations": ((F.col("portrait") > 0) & (F.col("landscape") > 0), F.lit("portrait and landscape images are mixed")),
        "resolution_variance": (F.col("pixel_count_variation") > config.resolution_variation, F.lit("resolutions differ widely")),
        "missing_exif": (F.lit(not sparse_model) & (F.col("with_exif") == 0), F.lit("no image carries metadata")),
        "duplicate_images": (F.lit(not sparse_model) & (F.col("n_clusters") > 0), F.concat(text("n_clusters"), F.lit(" groups of duplicates"))),
        "multiple_parent_groups": (scene & (F.coalesce("n_folders", F.lit(0)) >= FOLDERS), F.concat(text("n_folders"), F.lit(" folders with several images"))),
        "mixed_focal_lengths": (scene & (F.col("focal_ratio") >= FOCAL_RATIO), F.lit("focal lengths differ by a factor of two or more")),
        "flagged_image_quality": (F.lit(quality) & (F.col("flagged") > 0), F.concat(text("flagged"), F.lit(" images are flagged"))),
    }
    rows = F.array_compact(F.array(*(
        F.when(F.coalesce(tests[code][0], F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), tests[code][1].alias("message")))
        for i, (code, severity) in enumerate(FINDINGS)
    )))
    return facts.select(group, F.explode(rows).alias("f")).select(group, "f.*")


def advice(found: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    """(group, ord, recommendation) in the order of advice, each once."""
    spark = found.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(ADVICE)], "ord int, code string, recommendation string"))
    codes = found.select(group, "code")
    many = facts.join(found.where(F.col("code") == "flagged_image_quality").select(group), group, "left_semi").where(F.col("flagged") >= CLEANUP_IMAGES)
    codes = codes.unionByName(many.select(group, F.lit("many_flagged").alias("code")))
    return codes.join(table, "code").groupBy(group, "recommendation").agg(F.min("ord").alias("ord"))


def severities(found: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    """(group, errors, warnings, infos, has_errors) for every collection, zeros included."""
    t = found.groupBy(group).agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")))
    out = facts.select(group).join(t, group, "left").fillna(0, ["errors", "warnings", "infos"])
    return out.withColumn("has_errors", F.col("errors") > 0)
