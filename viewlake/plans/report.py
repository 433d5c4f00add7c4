"""The nested report of a collection, as JSON or text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlake.config import AuditConfig
from viewlake.functions.columns import has_exif
from viewlake.operators import duplicates, rules, stats
from viewlake.session import Scratch

#: Places of ratios and distances in a report.
PLACES = 4


def cluster_rows(members: DataFrame, group: str, order: str, distance: int) -> DataFrame:
    """(group, cluster, representative, members, average_distance, exact) of a written table of members."""
    roots = duplicates.representatives(members, group, order, distance).withColumnRenamed(group, "_g").withColumnRenamed("cluster", "_c")
    rows = duplicates.cluster_stats(members, group)
    rows = rows.join(roots, (F.col(group) == F.col("_g")) & (F.col("cluster") == F.col("_c"))).drop("_g", "_c")
    return rows.withColumn("average_distance", F.round("average_distance", PLACES)).select(group, "cluster", "representative", "members", "average_distance", "exact")


def reports(records: DataFrame, group: str, members: DataFrame | None, config: AuditConfig = AuditConfig(), *, order: str = "ord", sparse_model: bool = False, quality: bool = True, mode: str = "image_folder", generated_at: str | None = None) -> DataFrame:
    """(group, report): one JSON document per collection.

    The document holds statistics, findings, advice and clusters, the largest first and then by representative; nulls are kept. Lists
    in it are short by nature (resolutions, findings) or one entry per cluster; the
    records themselves, and lists of them, stay in tables (``document`` streams these into the JSON of one input). ``generated_at`` is a literal, so that a report can be made again.
    """
    scratch = Scratch(records.sparkSession)
    clusters = None
    if members is not None:
        members = scratch.write(members, "members")
        clusters = scratch.write(cluster_rows(members, group, order, config.duplicate_distance), "clusters")
    facts = scratch.write(rules.collection_facts(records, group, order, clusters, config), "facts")
    found = rules.findings(facts, group, config, sparse_model=sparse_model, quality=quality)
    listed = lambda df, *cols: df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("x"))
    parts = {
        "issues": listed(found, "ord", "severity", "code", "message"),
        "recommendations": listed(rules.advice(found, facts, group), "ord", "recommendation"),
        "resolutions": listed(stats.unique_resolutions(records, group), "resolution", "images"),
        "orientations": listed(stats.orientations(records, group, order), "first_seen", "orientation", "images"),
    }
    if clusters is not None:
        parts["duplicate_clusters"] = listed(clusters.withColumn("rank", -F.col("members")), "rank", "representative", "cluster", "members", "average_distance", "exact")
    out = facts.withColumnRenamed("images", "image_count").withColumn("focal_ratio", F.round("focal_ratio", PLACES))
    for name, part in parts.items():
        out = out.join(part.withColumnRenamed("x", name), group, "left")
    counted = stats.exif_counts(records, group).select(F.col(group).alias("_e"), "with_focal", "with_position")
    out = out.join(counted, out[group] == counted["_e"], "left").fillna(0, ["with_focal", "with_position"])
    severity = rules.severities(found, facts, group).withColumnRenamed(group, "_g")
    out = out.join(severity, out[group] == severity["_g"]).drop("_g")
    whole = F.struct(
        F.lit(mode).alias("mode"), F.lit(generated_at).cast("string").alias("generated_at"), F.col(group).alias("collection"), "image_count", "has_errors",
        F.struct("errors", "warnings", "infos").alias("issue_counts"), F.struct("resolutions", "orientations", "pixel_count_variation").alias("resolution_stats"),
        F.struct(F.col("with_exif").alias("images_with_exif"), F.col("with_focal").alias("images_with_focal_length"), F.col("with_position").alias("images_with_gps"), (F.col("n_readable") - F.col("with_exif")).alias("images_without")).alias("exif_stats"),
        F.struct("n_readable", "n_unreadable", "with_exif", "focal_ratio", "n_folders").alias("record_stats"),
        F.struct("n_clusters", "n_duplicates", *(["duplicate_clusters"] if clusters is not None else [])).alias("duplicates"),
        F.struct("analysed", "flagged").alias("quality"), "issues", "recommendations",
    )
    return out.select(group, F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))


def lists(records: DataFrame, members: DataFrame | None, clusters: DataFrame | None, skipped: DataFrame) -> dict[str, DataFrame]:
    """The long lists of the report of one input, as tables in order: records, paths without EXIF, unreadable paths, cluster members, skipped images."""
    readable = F.coalesce("readable", F.lit(False))
    out = {
        "image_records": records.orderBy("ord"), "images_without_exif": records.where(readable & ~has_exif(F.col("exif"))).orderBy("ord").select("path"),
        "unreadable_images": records.where(~readable).orderBy("ord").select("path"), "skipped_checks": skipped,
    }
    if members is not None:
        path = records.select("ord", "path")
        root = clusters.join(path.select(F.col("ord").alias("representative"), F.col("path").alias("root")), "representative")
        rows = members.select("ord", "cluster").join(path, "ord").join(root.select("cluster", "root", "members", "average_distance", "exact"), "cluster")
        out["duplicate_clusters"] = rows.select("cluster", "root", "members", "average_distance", "exact", "path").orderBy(F.desc("members"), "root", "cluster", "path")
    return out


def document(report: dict, tables: dict[str, DataFrame]) -> Iterator[str]:
    """The JSON text of a report with its lists, piece by piece: rows are streamed, never held together."""
    rows = lambda name: (r.asDict(recursive=True) for r in tables[name].toLocalIterator())

    def clusters() -> Iterator[dict]:
        if "duplicate_clusters" in tables:
            for _, own in groupby(rows("duplicate_clusters"), key=lambda r: r["cluster"]):
                first = next(own)
                yield {"representative": first["root"], "members": [first["path"], *(r["path"] for r in own)], "average_distance": first["average_distance"], "exact": first["exact"]}

    def listed(items: Iterator, depth: int) -> Iterator[str]:
        pad, some = "  " * depth, False
        yield "["
        for x in items:
            yield ("," if some else "") + f"\n{pad}" + json.dumps(x)
            some = True
        yield f"\n{pad[2:]}]" if some else "]"

    paths = lambda name: (r["path"] for r in rows(name))
    long = {
        "exif_stats": {"images_without_exif": lambda: paths("images_without_exif")},
        "validation_stats": {"unreadable_images": lambda: paths("unreadable_images"), "duplicate_clusters": clusters, "skipped_checks": lambda: (f"{r['path']}: {r['reason']}" for r in rows("skipped_checks"))},
    }
    yield "{"
    for name, value in report.items():
        if name in long:
            yield f"\n  {json.dumps(name)}: {{"
            for key, x in value.items():
                if key not in long[name]:
                    yield f"\n    {json.dumps(key)}: {json.dumps(x)},"
            fixed = value.get("skipped_checks") if name == "validation_stats" else None
            for i, (key, items) in enumerate(long[name].items()):
                yield ("," if i else "") + f"\n    {json.dumps(key)}: "
                yield from listed(iter(fixed) if key == "skipped_checks" and fixed is not None else items(), 3)
            yield "\n  },"
        else:
            yield f"\n  {json.dumps(name)}: " + json.dumps(value, indent=2).replace("\n", "\n  ") + ","
    yield '\n  "image_records": '
    yield from listed(rows("image_records"), 2)
    yield "\n}\n"


def text_report(report: dict, flagged: Iterator[dict] | None = None, *, quality: bool = False, flagged_only: bool = False) -> Iterator[str]:
    """The lines of a report for a terminal: findings, validation with skipped checks, quality if it was asked for, advice."""
    counts, resolution, exif = report["issue_counts"], report["resolution_stats"], report["exif_stats"]
    yield "Audit with quality" if quality else "Audit"
    yield f"Input: {report['collection']}"
    yield f"Mode: {report['mode']}"
    yield f"Images: {report['image_count']}"
    yield f"Issues: {counts['errors']} errors, {counts['warnings']} warnings, {counts['infos']} notes"
    if report["issues"]:
        yield from ("", "Issues", *(f"- [{i['severity']}] {i['code']}: {i['message']}" for i in report["issues"]))
    yield from ("", "Validation")
    yield "- Resolutions: " + (", ".join(f"{r['resolution']} ({r['images']})" for r in resolution["resolutions"] or []) or "none")
    yield "- Orientations: " + (", ".join(f"{o['orientation']}={o['images']}" for o in sorted(resolution["orientations"] or [], key=lambda o: o["orientation"])) or "none")
    yield f"- With EXIF: {exif['images_with_exif']}/{report['image_count']}"
    yield f"- Duplicate groups: {report['duplicates']['n_clusters']}"
    yield from (f"- Skipped: {x}" for x in report.get("skipped_checks", []))
    if quality:
        yield from ("", "Quality", f"- Analysed images: {report['quality']['analysed']}", f"- Flagged images: {report['quality']['flagged']}")
        if flagged_only:
            yield "- Only flagged images are listed"
        some = False
        for f in flagged or ():
            some = True
            yield f"- {f['path']}: {', '.join(f['flags'])}"
        if flagged_only and not some:
            yield "- No image is flagged"
    if report["recommendations"]:
        yield from ("", "Recommendations", *(f"- {r['recommendation']}" for r in report["recommendations"]))


def pretty(report: str) -> str:
    return json.dumps(json.loads(report), indent=2)
