"""Queries of the audit operators over image records, sparse models and tiles, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlake.functions import kernels
from viewlake.functions.columns import (
    average_hash, dms_to_decimal, hash_hex, is_supported_image, parse_hash, path_order, quality_flags, rational, suffix,
)
from viewlake.operators import duplicates, rules, stats
from viewlake.session import Scratch, table

#: Distance in bits for the tiles, whose hashes are far apart; images use the default of 6.
TILE_BITS, IMAGE_BITS = 20, 6
FRAME_SECONDS = 60.0


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "image_records").withColumnRenamed("record_id", "ord")


# -- paths, sizes, metadata


def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per suffix and whether it is a supported image."""
    p = F.col("path")
    return _records(spark, sf_dir).groupBy(suffix(p).alias("suffix"), is_supported_image(p).alias("supported")).agg(F.count(F.lit(1)).alias("files"))


def path_component_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each path of a dataset when sorted component by component."""
    paths = _records(spark, sf_dir).select("dataset_id", "path").distinct()
    return stats.component_order(paths, "dataset_id", "path", path_order(F.col("path"))).select("dataset_id", "path", "place")


def unreadable_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unreadable(_records(spark, sf_dir)).select("dataset_id", "path", "ord")


def unique_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unique_resolutions(_records(spark, sf_dir), "dataset_id")


def orientation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.orientations(_records(spark, sf_dir), "dataset_id", "ord")


def resolution_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.resolution_variation(_records(spark, sf_dir), "dataset_id")


def exif_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.exif_counts(_records(spark, sf_dir), "dataset_id")


def gps_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitudes cut into degrees, minutes and hundredths of seconds as rationals, and put together again."""
    lat = F.col("exif.gps_latitude")
    rows = _records(spark, sf_dir).where(lat.isNotNull() & ~F.isnan(lat)).select("ord", lat.alias("lat"))
    units = F.floor(F.abs("lat") * 360000).cast("bigint")
    rows = rows.select("ord", (F.col("lat") < 0).alias("south"), units.alias("u"))
    parts = F.array(rational(F.expr("u div 360000"), F.lit(1)), rational(F.expr("(u div 6000) % 60"), F.lit(1)), rational(F.col("u") % 6000, F.lit(100)))
    return rows.select("ord", dms_to_decimal(parts, F.when(F.col("south"), "S").otherwise("N")).alias("decimal_degrees"))


def parent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.folders(_records(spark, sf_dir), "dataset_id")


def focal_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.focal_ratio(_records(spark, sf_dir), "dataset_id")


# -- sparse models


def _last_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.last_rows(table(spark, sf_dir, "colmap_cameras"), ["model_id", "camera_id"], F.col("added_at"), ["width", "height"])


def camera_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last_cameras(spark, sf_dir)


def camera_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered images with the size of their camera, 0 by 0 where it is missing."""
    images = table(spark, sf_dir, "colmap_images").select("model_id", "image_id", "camera_id", "name", "registered_at").distinct()
    return stats.with_cameras(images, _last_cameras(spark, sf_dir), ["model_id", "camera_id"]).select("model_id", "image_id", "camera_id", "name", "width", "height")


def image_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second of the lines that are neither empty nor begin with #: the headers of a list with two lines per entry."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.btrim(x, F.lit(" \t\r")) != "") & ~F.startswith(x, F.lit("#")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("pos", "line"))
    return rows.where(F.col("pos") % 2 == 0).select("doc_id", (F.col("pos") / 2).cast("bigint").alias("entry"), F.md5("line").alias("line_md5"))


def required_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a dataset has files of all required formats, and which are missing: the containment test of model detection."""
    needed = F.array(F.lit("BMP"), F.lit("JPEG"), F.lit("TIFF"))
    have = _records(spark, sf_dir).groupBy("dataset_id").agg(F.collect_set("format").alias("have"))
    missing = F.array_sort(F.array_except(needed, "have"))
    return have.select("dataset_id", (F.size(missing) == 0).alias("complete"), F.array_join(missing, ",").alias("missing"))


# -- duplicates


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return e.select(F.lit("tiles").alias("collection"), F.col("vec_id").alias("ord"), average_hash(F.col("embedding")).alias("h"))


def average_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select(F.col("ord").alias("vec_id"), hash_hex(F.col("h")).alias("hash"))


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hashes of tiles at most 20 bits apart."""
    t = _tiles(spark, sf_dir).select("collection", "h").distinct()
    pairs = duplicates.hamming_join(Scratch(spark), t, ["collection"], TILE_BITS)
    a, b = hash_hex(F.col("h_a")), hash_hex(F.col("h_b"))
    return pairs.select(F.least(a, b).alias("hash_a"), F.greatest(a, b).alias("hash_b"), F.col("bits").cast("bigint").alias("bits"))


def _image_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).where(F.col("readable") & F.coalesce("source_exists", F.lit(False)))
    rows = records.select("dataset_id", "ord", parse_hash(F.col("perceptual_hash")).alias("h"))
    return duplicates.duplicate_members(rows, "dataset_id", "ord", IMAGE_BITS)


def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a dataset that have a duplicate in it, with their cluster."""
    return _image_members(spark, sf_dir).select("dataset_id", F.col("ord").alias("record_id"), "cluster")


def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, average distance over all pairs and exactness of each cluster."""
    return duplicates.cluster_stats(Scratch(spark).write(_image_members(spark, sf_dir), "members"), "dataset_id")


def cluster_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root of each cluster under order-dependent merging."""
    return duplicates.representatives(_image_members(spark, sf_dir), "dataset_id", "ord", IMAGE_BITS)


def tile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = duplicates.duplicate_members(_tiles(spark, sf_dir), "collection", "ord", TILE_BITS)
    return m.select(F.col("ord").alias("vec_id"), "cluster")


# -- image measures


def _tile_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the 8x8 tiles: embeddings with varied gain and offset, cut to bytes, shifted for the other channels."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("vec_id") % n).cast("int"))
    gain, off = pick([0.02, 1.0, 3.0, 6.0], 4), pick([0.1, 0.3, 0.5, 0.7, 0.9], 5)
    level = lambda v: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v.cast("double") * gain + off) * 255.0))).cast("int")
    tiles = e.select("vec_id", F.transform("embedding", level).alias("px"))
    names = ["blur_score", "exposure_mean", "exposure_std", "clipped_ratio", "noise_score", "sky_reflective_ratio"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            px = batch.column(1).flatten().to_numpy().reshape(-1, 64).astype(np.uint8)
            bgr = np.stack([px, np.roll(px, -21, axis=1), np.roll(px, -42, axis=1)], axis=-1).reshape(-1, 8, 8, 3)
            m = kernels.measures(bgr)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[n].astype(np.float64)) for n in names)], names=["vec_id", *names])

    return tiles.mapInArrow(run, "vec_id bigint, " + ", ".join(f"{n} double" for n in names))


def tile_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tile_measures(spark, sf_dir).select("vec_id", "blur_score")


def tile_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tile_measures(spark, sf_dir).select("vec_id", "exposure_mean", F.round("exposure_std", 9).alias("exposure_std"))


def tile_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tile_measures(spark, sf_dir).select("vec_id", "clipped_ratio")


def tile_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tile_measures(spark, sf_dir).select("vec_id", F.round("noise_score", 9).alias("noise_score"))


def tile_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tile_measures(spark, sf_dir).select("vec_id", "sky_reflective_ratio")


def tile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that each tile breaks, and its measures rounded for a report (after flagging)."""
    m = _tile_measures(spark, sf_dir)
    q = F.struct("blur_score", "exposure_mean", "clipped_ratio", "noise_score", "sky_reflective_ratio")
    flags = m.select("vec_id", "blur_score", quality_flags(q).alias("flags"))
    return flags.where(F.size("flags") > 0).select("vec_id", F.array_join("flags", ",").alias("flags"), F.round("blur_score", 4).alias("blur_score"))


def flagged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image records whose stored metrics break a threshold, flagged anew."""
    rows = _records(spark, sf_dir).where(F.col("quality_metrics").isNotNull()).select("ord", quality_flags(F.col("quality_metrics")).alias("flags"))
    return rows.where(F.size("flags") > 0).select(F.col("ord").alias("record_id"), F.array_join("flags", ",").alias("flags"))


def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and minute: frame-rate reduction of timestamped rows."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return stats.first_per_bucket(rows, "user_id", "ts", FRAME_SECONDS, "event_id").select("user_id", "event_id")


# -- findings


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    scratch = Scratch(spark)
    members = _image_members(spark, sf_dir)
    clusters = members.groupBy("dataset_id", "cluster").agg(F.count(F.lit(1)).alias("members"))
    return scratch.write(rules.collection_facts(records, "dataset_id", "ord", clusters), "facts")


def collection_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select(
        "dataset_id", "images", "n_readable", "n_unreadable", "landscape", "portrait", "pixel_count_variation", "with_exif", "n_folders", "n_clusters", "n_duplicates", "analysed", "flagged"
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(_facts(spark, sf_dir), "dataset_id").select("dataset_id", "ord", "severity", "code")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    return rules.advice(rules.findings(facts, "dataset_id"), facts, "dataset_id")


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    return rules.severities(rules.findings(facts, "dataset_id"), facts, "dataset_id")


def notes_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note of a dataset once, where it first appears."""
    rows = _records(spark, sf_dir).select("dataset_id", "ord", F.explode("notes").alias("note"))
    return stats.keep_first(rows, "dataset_id", "note", "ord")


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON report per dataset."""
    from viewlake.plans.report import reports

    return reports(_records(spark, sf_dir), "dataset_id", _image_members(spark, sf_dir))


def queries() -> dict:
    found = (
        supported_files, path_component_order, unreadable_images, unique_resolutions, orientation_histogram, resolution_variation, exif_counts, gps_decimal,
        parent_groups, focal_ratio, camera_last_wins, camera_left_join, image_line_pairs, required_formats, average_hashes, hamming_pairs, duplicate_members,
        cluster_stats, cluster_representatives, tile_clusters, tile_blur, tile_exposure, tile_clipped, tile_noise, tile_sky, tile_flags, flagged_records,
        frame_sampling, collection_facts, findings, recommendations, severity_counts, notes_first_seen, report_json,
    )
    return {f.__name__: f for f in found}


_SIZED = "readable AND width > 0 AND height > 0"
_HAS_EXIF = "exif.make IS NOT NULL OR exif.model IS NOT NULL OR exif.focal_length_mm IS NOT NULL OR exif.gps_latitude IS NOT NULL OR exif.gps_longitude IS NOT NULL"
_VARIATION = f"""SELECT dataset_id, count(*) AS images, round(coalesce(sqrt(greatest(count(*)::DOUBLE * sum(p::HUGEINT * p)::DOUBLE - sum(p)::DOUBLE * sum(p)::DOUBLE, 0.0)) / nullif(sum(p)::DOUBLE, 0), 0.0), 4) AS pixel_count_variation
  FROM (SELECT dataset_id, width::BIGINT * height AS p FROM image_records WHERE {_SIZED}) GROUP BY dataset_id"""
_FLAGS = """concat_ws(',', CASE WHEN blur_score < 80.0 THEN 'blurry' END,
  CASE WHEN exposure_mean < 0.2 THEN 'underexposed' WHEN exposure_mean > 0.8 THEN 'overexposed' END,
  CASE WHEN clipped_ratio > 0.03 THEN 'clipped_highlights' END, CASE WHEN noise_score > 0.12 THEN 'high_noise' END,
  CASE WHEN sky_reflective_ratio > 0.35 THEN 'sky_or_reflective_dominance' END)"""
_CAMERAS = """cam AS (SELECT model_id, camera_id, m.width AS width, m.height AS height FROM (SELECT model_id, camera_id,
  max(struct_pack(added_at := added_at, width := width, height := height)) AS m FROM colmap_cameras GROUP BY model_id, camera_id))"""
_TILE_HASH = """cells AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE len(embedding) = 64),
means AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 AS m FROM embeddings WHERE len(embedding) = 64),
hashes AS (SELECT vec_id, sum(CASE WHEN v > m THEN 1::HUGEINT << (63 - p)::HUGEINT ELSE 0::HUGEINT END)::UBIGINT AS h FROM cells JOIN means USING (vec_id) GROUP BY vec_id)"""
_IMAGE_HASH = """hashed AS (SELECT dataset_id, record_id, ('0x' || x)::UBIGINT AS h FROM (
    SELECT dataset_id, record_id, regexp_replace(regexp_replace(lower(replace(replace(perceptual_hash, ' ', ''), chr(9), '')), '^0x', ''), '^0+(.)', '\\1') AS x
    FROM image_records WHERE readable AND source_exists)
  WHERE regexp_matches(x, '^[0-9a-f]{1,16}$') AND dataset_id IS NOT NULL)"""


def _components(vertices: str) -> str:
    """CTEs from ``vertices`` (grp, id, h): linked classes, reachability and members."""
    return f""", classes AS (SELECT grp, h, min(id) AS id, count(*) AS n FROM {vertices} GROUP BY grp, h),
linked AS (SELECT a.id AS x, b.id AS y, bit_count(xor(a.h, b.h)) AS bits FROM classes a JOIN classes b ON a.grp = b.grp AND a.id <> b.id AND bit_count(xor(a.h, b.h)) <= BITS),
reach AS (SELECT id AS x, id AS y FROM classes UNION SELECT r.x, l.y FROM reach r JOIN linked l ON l.x = r.y),
label AS (SELECT x AS id, min(y) AS cluster FROM reach GROUP BY x),
placed AS (SELECT v.grp, v.id, v.h, l.cluster, count(*) OVER (PARTITION BY v.grp, l.cluster) AS members FROM {vertices} v JOIN classes c ON c.grp = v.grp AND c.h = v.h JOIN label l ON l.id = c.id),
member AS (SELECT * FROM placed WHERE members > 1)"""


_IMAGE_CLUSTERS = "WITH RECURSIVE " + _IMAGE_HASH + ", vertices AS (SELECT dataset_id AS grp, record_id AS id, h FROM hashed)" + _components("vertices").replace("BITS", "6")
_TILE_CLUSTERS = "WITH RECURSIVE " + _TILE_HASH + ", vertices AS (SELECT 'tiles' AS grp, vec_id AS id, h FROM hashes)" + _components("vertices").replace("BITS", "20")

# one list per cluster, in order of idents: step i puts the trees of all later members near i under i's root
_ROOTS = """, lists AS (SELECT grp, cluster, list(id ORDER BY id) AS ids, list(h ORDER BY id) AS hs FROM member GROUP BY grp, cluster),
merging AS (SELECT grp, cluster, ids, hs, ids AS roots, 1::BIGINT AS i FROM lists
  UNION ALL SELECT grp, cluster, ids, hs,
    CASE WHEN len(near) = 0 THEN roots ELSE list_transform(roots, lambda r: CASE WHEN list_contains(near, r) THEN roots[i] ELSE r END) END, i + 1 FROM (
    SELECT *, list_transform(list_filter(range(i + 1, len(ids) + 1), lambda j: bit_count(xor(hs[j], hs[i])) <= 6), lambda j: roots[j]) AS near FROM merging WHERE i < len(ids))),
root AS (SELECT grp AS dataset_id, cluster, roots[1] AS representative FROM merging WHERE i = len(ids))"""
_PAIRS = "SELECT a.grp AS dataset_id, a.cluster, max(a.members) AS members, sum(bit_count(xor(a.h, b.h)))::DOUBLE / count(*) AS average_distance, sum(bit_count(xor(a.h, b.h))) = 0 AS exact FROM member a JOIN member b ON a.grp = b.grp AND a.cluster = b.cluster AND a.id < b.id GROUP BY a.grp, a.cluster"

_PIXELS = """WITH cells AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE len(embedding) = 64),
level AS (SELECT vec_id, p, floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, (v * ([0.02, 1.0, 3.0, 6.0]::DOUBLE[])[vec_id % 4 + 1] + ([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[])[vec_id % 5 + 1]) * 255.0::DOUBLE)))::BIGINT AS t FROM cells),
px AS (SELECT a.vec_id, a.p // 8 AS y, a.p % 8 AS x, a.t AS b, g.t AS g, r.t AS r FROM level a
  JOIN level g ON g.vec_id = a.vec_id AND g.p = (a.p + 21) % 64 JOIN level r ON r.vec_id = a.vec_id AND r.p = (a.p + 42) % 64),
gr AS (SELECT vec_id, y, x, b, g, r, (3735 * b + 19235 * g + 9798 * r + 16384) >> 15 AS k FROM px)"""
_BLUR = """, lap AS (SELECT vec_id, coalesce(lag(k) OVER h, lead(k) OVER h) + coalesce(lead(k) OVER h, lag(k) OVER h) + coalesce(lag(k) OVER v, lead(k) OVER v) + coalesce(lead(k) OVER v, lag(k) OVER v) - 4 * k AS e
  FROM gr WINDOW h AS (PARTITION BY vec_id, y ORDER BY x), v AS (PARTITION BY vec_id, x ORDER BY y)),
blur AS (SELECT vec_id, (64 * sum(e * e) - sum(e) * sum(e))::DOUBLE / 4096 AS blur_score FROM lap GROUP BY vec_id)"""
_EXPOSURE = """, expo AS (SELECT vec_id, sum(k)::DOUBLE / (255.0::DOUBLE * 64) AS exposure_mean, sqrt((64 * sum(k * k) - sum(k) * sum(k))::DOUBLE) / (255.0::DOUBLE * 64) AS exposure_std FROM gr GROUP BY vec_id)"""
_CLIPPED = """, clip AS (SELECT vec_id, sum(CASE WHEN greatest(b, g, r) >= 250 THEN 1 ELSE 0 END)::DOUBLE / 64 AS clipped_ratio FROM px GROUP BY vec_id)"""
_TAPS = "6 * {c} + 4 * (coalesce(lag({c}) OVER w, lead({c}) OVER w) + coalesce(lead({c}) OVER w, lag({c}) OVER w)) + coalesce(lag({c}, 2) OVER w, CASE WHEN {i} = 0 THEN lead({c}, 2) OVER w ELSE {c} END) + coalesce(lead({c}, 2) OVER w, CASE WHEN {i} = 7 THEN lag({c}, 2) OVER w ELSE {c} END)"
_NOISE = (
    ", g1 AS (SELECT vec_id, y, x, k, " + _TAPS.format(c="k", i="x") + " AS s FROM gr WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)),"
    " g2 AS (SELECT vec_id, k, " + _TAPS.format(c="s", i="y") + " AS s FROM g1 WINDOW w AS (PARTITION BY vec_id, x ORDER BY y)),"
    " noise AS (SELECT vec_id, sum(abs(256 * k - s))::DOUBLE / (256.0::DOUBLE * 255.0 * 64) AS noise_score FROM g2 GROUP BY vec_id)"
)


def _pass(source: str, target: str, fn: str) -> str:
    """Minimum or maximum over 3x3, first along rows, then along columns."""
    near = "ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
    return (
        f", {target}_h AS (SELECT vec_id, y, x, {fn}(m) OVER (PARTITION BY vec_id, y ORDER BY x {near}) AS m FROM {source}),"
        f" {target} AS (SELECT vec_id, y, x, {fn}(m) OVER (PARTITION BY vec_id, x ORDER BY y {near}) AS m FROM {target}_h)"
    )


_SKY = (
    """, hv AS (SELECT vec_id, y, x, b, g, r, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM px),
hs AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE (d * round_even(255 * 4096.0::DOUBLE / v, 0)::BIGINT + 2048) >> 12 END AS s,
  CASE WHEN d = 0 THEN 0 ELSE floor(((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END) * round_even(30 * 4096.0::DOUBLE / d, 0)::BIGINT + 2048) / 4096.0::DOUBLE)::BIGINT END AS h0 FROM hv),
mask AS (SELECT vec_id, y, x, CASE WHEN (s <= 70 AND v >= 170) OR (h BETWEEN 85 AND 130 AND s BETWEEN 10 AND 160 AND v >= 120) THEN 1 ELSE 0 END AS m
  FROM (SELECT *, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h FROM hs))"""
    + _pass("mask", "m1", "min") + _pass("m1", "m2", "max") + _pass("m2", "m3", "max") + _pass("m3", "m4", "min")
    + ", sky AS (SELECT vec_id, sum(m)::DOUBLE / 64 AS sky_reflective_ratio FROM m4 GROUP BY vec_id)"
)

_FACTS = f"""{_IMAGE_CLUSTERS},
cl AS (SELECT grp AS dataset_id, count(DISTINCT cluster) AS n_clusters, count(*) - count(DISTINCT cluster) AS n_duplicates FROM member GROUP BY grp),
base AS (SELECT dataset_id, count(*) AS images, count(*) FILTER (WHERE readable) AS n_readable, count(*) FILTER (WHERE NOT coalesce(readable, false)) AS n_unreadable,
    count(*) FILTER (WHERE {_SIZED} AND width > height) AS landscape, count(*) FILTER (WHERE {_SIZED} AND width < height) AS portrait,
    count(quality_metrics) AS analysed, count(*) FILTER (WHERE len(quality_metrics.flags) > 0) AS flagged,
    count(*) FILTER (WHERE readable AND ({_HAS_EXIF})) AS with_exif,
    max(exif.focal_length_mm) FILTER (WHERE readable AND NOT isnan(exif.focal_length_mm)) / nullif(greatest(min(exif.focal_length_mm) FILTER (WHERE readable AND NOT isnan(exif.focal_length_mm)), 0), 0) AS focal_ratio
  FROM image_records GROUP BY dataset_id),
fo AS (SELECT dataset_id, count(*) AS n_folders FROM (SELECT dataset_id, parent_relative FROM image_records WHERE readable AND parent_relative <> '' GROUP BY ALL HAVING count(*) >= 3) GROUP BY dataset_id),
va AS ({_VARIATION}),
facts AS (SELECT base.*, coalesce(n_folders, 0) AS n_folders, coalesce(pixel_count_variation, 0.0) AS pixel_count_variation, coalesce(n_clusters, 0) AS n_clusters, coalesce(n_duplicates, 0) AS n_duplicates
  FROM base LEFT JOIN fo USING (dataset_id) LEFT JOIN (SELECT dataset_id, pixel_count_variation FROM va) USING (dataset_id) LEFT JOIN cl USING (dataset_id))"""
_FOUND = f"""{_FACTS},
found AS (
  SELECT dataset_id, 0 AS ord, 'error' AS severity, 'too_few_images' AS code FROM facts WHERE images < 10
  UNION ALL SELECT dataset_id, 1, 'warning', 'low_image_count' FROM facts WHERE images >= 10 AND images < 30
  UNION ALL SELECT dataset_id, 2, 'error', 'unreadable_images' FROM facts WHERE n_unreadable > 0
  UNION ALL SELECT dataset_id, 3, 'warning', 'mixed_orientations' FROM facts WHERE portrait > 0 AND landscape > 0
  UNION ALL SELECT dataset_id, 4, 'warning', 'resolution_variance' FROM facts WHERE pixel_count_variation > 0.25
  UNION ALL SELECT dataset_id, 5, 'warning', 'missing_exif' FROM facts WHERE with_exif = 0
  UNION ALL SELECT dataset_id, 6, 'warning', 'duplicate_images' FROM facts WHERE n_clusters > 0
  UNION ALL SELECT dataset_id, 7, 'warning', 'multiple_parent_groups' FROM facts WHERE n_readable >= 10 AND n_folders >= 3
  UNION ALL SELECT dataset_id, 8, 'warning', 'mixed_focal_lengths' FROM facts WHERE n_readable >= 10 AND focal_ratio >= 2.0
  UNION ALL SELECT dataset_id, 9, 'warning', 'flagged_image_quality' FROM facts WHERE flagged > 0)"""
_ADVICE = ", ".join(f"({i}, '{code}', '{text}')" for i, (code, text) in enumerate(rules.ADVICE))


def _listed(table: str, order: str, fields: str) -> str:
    """A CTE of one list of structs per dataset, in order."""
    return f"(SELECT dataset_id, list(struct_pack({fields}) ORDER BY {order}) AS x FROM {table} GROUP BY dataset_id)"


_MESSAGES = """CASE code WHEN 'too_few_images' THEN images || ' images; at least 10 are needed' WHEN 'low_image_count' THEN images || ' images; 30 are advised'
    WHEN 'unreadable_images' THEN n_unreadable || ' files could not be read' WHEN 'mixed_orientations' THEN 'portrait and landscape images are mixed' WHEN 'resolution_variance' THEN 'resolutions differ widely'
    WHEN 'missing_exif' THEN 'no image carries metadata' WHEN 'duplicate_images' THEN n_clusters || ' groups of duplicates' WHEN 'multiple_parent_groups' THEN n_folders || ' folders with several images'
    WHEN 'mixed_focal_lengths' THEN 'focal lengths differ by a factor of two or more' ELSE flagged || ' images are flagged' END"""
_REPORT = f"""{_FOUND}{_ROOTS},
issue AS (SELECT found.dataset_id, ord::INT AS ord, severity, code, {_MESSAGES} AS message FROM found JOIN facts USING (dataset_id)),
told AS (SELECT dataset_id, code FROM found UNION ALL SELECT dataset_id, 'many_flagged' FROM facts WHERE flagged >= 3),
advice AS (SELECT dataset_id, recommendation, min(ord)::INT AS ord FROM told JOIN (VALUES {_ADVICE}) a(ord, code, recommendation) USING (code) GROUP BY dataset_id, recommendation),
res AS (SELECT dataset_id, width || 'x' || height AS resolution, count(*) AS images FROM image_records WHERE {_SIZED} GROUP BY ALL),
ori AS (SELECT dataset_id, min(record_id) AS first_seen, CASE WHEN width = height THEN 'square' WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation, count(*) AS images FROM image_records WHERE {_SIZED} GROUP BY ALL),
clu AS (SELECT p.dataset_id, -members AS rank, representative, cluster, members, round(average_distance, 4) AS average_distance, exact FROM ({_PAIRS}) p JOIN root USING (dataset_id, cluster)),
exi AS (SELECT dataset_id, count(exif.focal_length_mm) AS with_focal, count(*) FILTER (WHERE exif.gps_latitude IS NOT NULL AND exif.gps_longitude IS NOT NULL) AS with_position FROM image_records WHERE readable GROUP BY dataset_id),
sev AS (SELECT dataset_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos FROM found GROUP BY dataset_id)
SELECT f.dataset_id, to_json(struct_pack(mode := 'image_folder', generated_at := NULL::VARCHAR, collection := f.dataset_id, image_count := images, has_errors := coalesce(errors, 0) > 0,
  issue_counts := struct_pack(errors := coalesce(errors, 0), warnings := coalesce(warnings, 0), infos := coalesce(infos, 0)),
  resolution_stats := struct_pack(resolutions := r.x, orientations := o.x, pixel_count_variation := pixel_count_variation),
  exif_stats := struct_pack(images_with_exif := with_exif, images_with_focal_length := coalesce(with_focal, 0), images_with_gps := coalesce(with_position, 0), images_without := n_readable - with_exif),
  record_stats := struct_pack(n_readable := n_readable, n_unreadable := n_unreadable, with_exif := with_exif, focal_ratio := round(focal_ratio, 4), n_folders := n_folders),
  duplicates := struct_pack(n_clusters := n_clusters, n_duplicates := n_duplicates, duplicate_clusters := c.x), quality := struct_pack(analysed := analysed, flagged := flagged),
  issues := i.x, recommendations := a.x))::VARCHAR AS report
FROM facts f LEFT JOIN sev USING (dataset_id) LEFT JOIN exi USING (dataset_id) LEFT JOIN {_listed("res", "resolution", "resolution := resolution, images := images")} r USING (dataset_id)
  LEFT JOIN {_listed("ori", "first_seen", "first_seen := first_seen, orientation := orientation, images := images")} o USING (dataset_id)
  LEFT JOIN {_listed("clu", "rank, representative", "rank := rank, representative := representative, cluster := cluster, members := members, average_distance := average_distance, exact := exact")} c USING (dataset_id)
  LEFT JOIN {_listed("issue", "ord", "ord := ord, severity := severity, code := code, message := message")} i USING (dataset_id)
  LEFT JOIN {_listed("advice", "ord", "ord := ord, recommendation := recommendation")} a USING (dataset_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "supported_files": """SELECT s AS suffix, s IN ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp', '.ppm') AS supported, count(*) AS files
FROM (SELECT lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]+)$', 1)) AS s FROM image_records) GROUP BY ALL""",
        "path_component_order": "SELECT dataset_id, path, row_number() OVER (PARTITION BY dataset_id ORDER BY string_split(path, '/'), path) AS place FROM (SELECT DISTINCT dataset_id, path FROM image_records)",
        "unreadable_images": "SELECT dataset_id, path, record_id AS ord FROM image_records WHERE NOT coalesce(readable, false)",
        "unique_resolutions": f"SELECT dataset_id, width || 'x' || height AS resolution, count(*) AS images FROM image_records WHERE {_SIZED} GROUP BY ALL",
        "orientation_histogram": f"""SELECT dataset_id, CASE WHEN width = height THEN 'square' WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orientation,
  count(*) AS images, min(record_id) AS first_seen FROM image_records WHERE {_SIZED} GROUP BY ALL""",
        "resolution_variation": _VARIATION,
        "exif_counts": f"""SELECT dataset_id, count(*) AS readable, count(*) FILTER (WHERE {_HAS_EXIF}) AS with_exif, count(exif.focal_length_mm) AS with_focal,
  count(*) FILTER (WHERE exif.gps_latitude IS NOT NULL AND exif.gps_longitude IS NOT NULL) AS with_position FROM image_records WHERE readable GROUP BY dataset_id""",
        "gps_decimal": """SELECT ord, CASE WHEN south THEN -d ELSE d END AS decimal_degrees FROM (SELECT ord, south,
  (u // 360000)::DOUBLE + ((u // 6000) % 60)::DOUBLE / 60 + ((u % 6000)::DOUBLE / 100) / 3600 AS d
  FROM (SELECT record_id AS ord, exif.gps_latitude < 0 AS south, floor(abs(exif.gps_latitude) * 360000)::BIGINT AS u FROM image_records WHERE exif.gps_latitude IS NOT NULL AND NOT isnan(exif.gps_latitude)))""",
        "parent_groups": "SELECT dataset_id, parent_relative, count(*) AS images FROM image_records WHERE readable AND parent_relative <> '' GROUP BY ALL HAVING count(*) >= 3",
        "focal_ratio": """SELECT dataset_id, shortest, longest, CASE WHEN shortest > 0 THEN longest / shortest END AS ratio FROM (
  SELECT dataset_id, min(exif.focal_length_mm) AS shortest, max(exif.focal_length_mm) AS longest FROM image_records WHERE readable AND exif.focal_length_mm IS NOT NULL AND NOT isnan(exif.focal_length_mm) GROUP BY dataset_id)""",
        "camera_last_wins": f"WITH {_CAMERAS} SELECT model_id, camera_id, width, height FROM cam",
        "camera_left_join": f"""WITH {_CAMERAS} SELECT i.model_id, i.image_id, i.camera_id, i.name, coalesce(c.width, 0) AS width, coalesce(c.height, 0) AS height
FROM (SELECT DISTINCT model_id, image_id, camera_id, name, registered_at FROM colmap_images) i LEFT JOIN cam c ON c.model_id = i.model_id AND c.camera_id = i.camera_id""",
        "image_line_pairs": """SELECT doc_id, (k - 1) // 2 AS entry, md5(line) AS line_md5 FROM (
  SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '' AND NOT starts_with(x, '#')) AS ls FROM documents))
WHERE k % 2 = 1""",
        "required_formats": """SELECT dataset_id, len(missing) = 0 AS complete, array_to_string(missing, ',') AS missing FROM (
  SELECT dataset_id, list_filter(['BMP', 'JPEG', 'TIFF'], lambda x: NOT coalesce(list_contains(have, x), false)) AS missing FROM (SELECT dataset_id, list(DISTINCT format) AS have FROM image_records GROUP BY dataset_id))""",
        "average_hashes": f"WITH {_TILE_HASH} SELECT vec_id, lower(lpad(hex(h), 16, '0')) AS hash FROM hashes",
        "hamming_pairs": f"""WITH {_TILE_HASH}, d AS (SELECT DISTINCT h FROM hashes)
SELECT lower(lpad(hex(a.h), 16, '0')) AS hash_a, lower(lpad(hex(b.h), 16, '0')) AS hash_b, bit_count(xor(a.h, b.h))::BIGINT AS bits FROM d a JOIN d b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 20""",
        "duplicate_members": _IMAGE_CLUSTERS + " SELECT grp AS dataset_id, id AS record_id, cluster FROM member",
        "cluster_stats": _IMAGE_CLUSTERS + " " + _PAIRS,
        "cluster_representatives": _IMAGE_CLUSTERS + _ROOTS + " SELECT dataset_id, cluster, representative FROM root",
        "report_json": _REPORT,
        "tile_clusters": _TILE_CLUSTERS + " SELECT id AS vec_id, cluster FROM member",
        "tile_blur": _PIXELS + _BLUR + " SELECT * FROM blur",
        "tile_exposure": _PIXELS + _EXPOSURE + " SELECT vec_id, exposure_mean, round(exposure_std, 9) AS exposure_std FROM expo",
        "tile_clipped": _PIXELS + _CLIPPED + " SELECT * FROM clip",
        "tile_noise": _PIXELS + _NOISE + " SELECT vec_id, round(noise_score, 9) AS noise_score FROM noise",
        "tile_sky": _PIXELS + _SKY + " SELECT * FROM sky",
        "tile_flags": _PIXELS + _BLUR + _EXPOSURE + _CLIPPED + _NOISE + _SKY + f""" SELECT * FROM (SELECT vec_id, {_FLAGS} AS flags, round(blur_score, 4) AS blur_score
  FROM blur JOIN expo USING (vec_id) JOIN clip USING (vec_id) JOIN noise USING (vec_id) JOIN sky USING (vec_id)) WHERE flags <> ''""",
        "flagged_records": f"SELECT record_id, flags FROM (SELECT record_id, {_FLAGS} AS flags FROM (SELECT record_id, unnest(quality_metrics) FROM image_records WHERE quality_metrics IS NOT NULL)) WHERE flags <> ''",
        "frame_sampling": """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 60000000) ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL) WHERE k = 1""",
        "collection_facts": _FACTS + " SELECT dataset_id, images, n_readable, n_unreadable, landscape, portrait, pixel_count_variation, with_exif, n_folders, n_clusters, n_duplicates, analysed, flagged FROM facts",
        "findings": _FOUND + " SELECT dataset_id, ord::INT AS ord, severity, code FROM found",
        "recommendations": _FOUND + f""", told AS (SELECT dataset_id, code FROM found UNION ALL SELECT dataset_id, 'many_flagged' FROM facts WHERE flagged >= 3)
SELECT dataset_id, recommendation, min(ord)::INT AS ord FROM told JOIN (VALUES {_ADVICE}) a(ord, code, recommendation) USING (code) GROUP BY dataset_id, recommendation""",
        "severity_counts": _FOUND + """ SELECT f.dataset_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos,
  count(*) FILTER (WHERE severity = 'error') > 0 AS has_errors FROM facts f LEFT JOIN found USING (dataset_id) GROUP BY f.dataset_id""",
        "notes_first_seen": "SELECT dataset_id, note, min(record_id) AS ord FROM (SELECT dataset_id, record_id, unnest(notes) AS note FROM image_records) GROUP BY dataset_id, note",
    }
