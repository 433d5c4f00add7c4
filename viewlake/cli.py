"""Command line: ``python -m viewlake.cli analyze PATH``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from viewlake.config import AuditConfig
from viewlake.plans.audit import audit
from viewlake.plans.report import document, text_report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="viewlake")
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze", help="audit an image folder, a video or a sparse model")
    a.add_argument("path")
    a.add_argument("--mode")
    for flag in ("recursive", "strict", "quality", "flagged-only", "json", "debug"):
        a.add_argument(f"--{flag}", action="store_true")
    a.add_argument("--output", type=Path)
    a.add_argument("--fps", type=float, default=AuditConfig.fps)
    for name in ("blur_threshold", "exposure_min", "exposure_max", "clipped_threshold", "noise_threshold", "sky_threshold"):
        a.add_argument("--" + name.replace("_", "-"), type=float, default=getattr(AuditConfig, name))
    commands.add_parser("optimize", help="not available").add_argument("path", nargs="?")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0; 2 for a usage error, or with --strict for a report with errors."""
    args = parser().parse_args(argv)
    if args.command == "optimize":
        print("optimize is not available", file=sys.stderr)
        return 2
    config = AuditConfig(
        recursive=args.recursive, fps=args.fps, strict=args.strict, quality=args.quality, blur_threshold=args.blur_threshold, exposure_min=args.exposure_min,
        exposure_max=args.exposure_max, clipped_threshold=args.clipped_threshold, noise_threshold=args.noise_threshold, sky_threshold=args.sky_threshold,
    )
    spark = spark or SparkSession.builder.appName("viewlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        done = audit(spark, args.path, config, args.mode, datetime.now(timezone.utc).isoformat(timespec="seconds"))
    except ValueError as e:
        if args.debug:
            raise
        print(f"viewlake: {e}", file=sys.stderr)
        return 2
    if args.json and args.output:
        with args.output.open("w", encoding="utf-8") as f:
            f.writelines(document(done.report, done.tables))
    if args.json and not args.output:
        for piece in document(done.report, done.tables):
            print(piece, end="")
    else:
        rows = done.records.where(F.size("quality_metrics.flags") > 0).orderBy("ord").select("path", F.col("quality_metrics.flags").alias("flags"))
        flagged = (r.asDict() for r in rows.toLocalIterator())
        for line in text_report(done.report, flagged, quality=args.quality, flagged_only=args.flagged_only):
            print(line)
    return 2 if args.strict and done.report["has_errors"] else 0


if __name__ == "__main__":
    sys.exit(main())
