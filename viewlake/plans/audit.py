"""An audit of one input from path to report."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlake.config import AuditConfig
from viewlake.functions.columns import parse_hash
from viewlake.operators import duplicates
from viewlake.plans.report import cluster_rows, lists, reports
from viewlake.session import Scratch
from viewlake.sources.detect import load
from viewlake.sources.images import with_quality


@dataclass
class Audit:
    """report: the document without its long lists. records: with quality. tables: the long lists, as for ``plans.report.document``."""

    report: dict
    records: DataFrame
    tables: dict[str, DataFrame]

    def __iter__(self):
        return iter((self.report, self.records))


def audit_records(records: DataFrame, config: AuditConfig, *, mode: str = "image_folder", sparse_model: bool = False, generated_at: str | None = None, name: str = "input") -> Audit:
    """The audit of one collection."""
    scratch = Scratch(records.sparkSession)
    rated = with_quality(records, config) if config.quality else records.withColumn("quality_metrics", F.lit(None).cast(records.schema["quality_metrics"].dataType))
    rated = scratch.write(rated.withColumn("collection", F.lit(name)), "records")
    members = clusters = None
    if not sparse_model:
        rows = rated.where(F.col("readable") & F.coalesce("source_exists", F.lit(False))).select("collection", "ord", parse_hash(F.col("perceptual_hash")).alias("h"))
        members = scratch.write(duplicates.duplicate_members(rows, "collection", "ord", config.duplicate_distance), "members")
        clusters = scratch.write(cluster_rows(members, "collection", "ord", config.duplicate_distance), "clusters")
    out = reports(rated, "collection", members, config, sparse_model=sparse_model, quality=config.quality, mode=mode, generated_at=generated_at)
    skipped = scratch.write(skipped_images(records, config).where(F.lit(not sparse_model)), "skipped")
    tables = lists(rated.drop("collection"), members, clusters, skipped.orderBy("ord").select("path", "reason"))
    return Audit(json.loads(out.first()["report"]), rated, tables)


def skipped_images(records: DataFrame, config: AuditConfig = AuditConfig(quality=True)) -> DataFrame:
    """(ord, path, reason) of all images without measured pixels, once per path and reason."""
    readable = F.coalesce("readable", F.lit(False))
    rows = records.where(F.col("perceptual_hash").isNull()).select("ord", "path", F.when(readable, "pixels were not decoded").otherwise("unreadable").alias("reason"))
    return rows.groupBy("path", "reason").agg(F.min("ord").alias("ord"))


def audit(spark: SparkSession, path: str, config: AuditConfig = AuditConfig(), mode: str | None = None, generated_at: str | None = None, extractor=None) -> Audit:
    """The audit of a path. Skipped images are counted per reason in the report and listed, all of them, in the table ``skipped_checks``."""
    loaded = load(spark, path, mode, config, **({"extractor": extractor} if extractor else {}))
    done = audit_records(loaded.records, config, mode=loaded.mode, sparse_model=loaded.sparse_model, generated_at=generated_at, name=path)
    report, validation, counts = done.report, {}, {}
    if loaded.sparse_model:
        skipped = ["metadata was not checked: a sparse model has none", "duplicates were not looked for: a sparse model has no files"]
        if config.quality:
            skipped.append("quality was not measured: a sparse model has no files")
        validation["skipped_checks"] = skipped
    else:
        rows = done.tables["skipped_checks"].groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason").collect()
        counts = {r["reason"]: r["n"] for r in rows}
        skipped = [f"{n} images: {reason}" for reason, n in counts.items()]
    summary = {
        "input_path": path, "resolved_path": str(Path(path).resolve()), "input_mode": loaded.mode, "forced_mode": mode, "recursive": config.recursive,
        "image_count": report["image_count"], "extracted_frame_count": loaded.metadata.get("extracted_frame_count"),
    }
    validation |= {"duplicate_image_count": report["duplicates"]["n_duplicates"], "unreadable_image_count": report["record_stats"]["n_unreadable"]}
    done.report = {"input_summary": summary} | report | {"validation_stats": validation, "metadata": loaded.metadata | {"quality_enabled": config.quality}, "skipped_checks": skipped, "skipped_counts": counts}
    return done
