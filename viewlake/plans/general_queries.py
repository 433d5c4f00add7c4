"""Queries of the general data problems: p2 (near points) and p6 (orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlake.operators.references import find_orphans, plain_name
from viewlake.operators.spatial import footprints, near_pairs, points_in_regions, positions, ring_edges
from viewlake.session import table

NEAR_RADIUS_M = 25.0


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "image_records")
    return positions(records, "record_id", F.col("exif.gps_latitude"), F.col("exif.gps_longitude"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records taken at most 25 m apart."""
    pairs = near_pairs(_positions(spark, sf_dir), NEAR_RADIUS_M)
    return pairs.select(F.col("id_a").alias("record_a"), F.col("id_b").alias("record_b"))


def p2_neighbour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record with a valid position: how many other records are within 25 m (0 included)."""
    points = _positions(spark, sf_dir)
    pairs = near_pairs(points, NEAR_RADIUS_M)
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("point_id"))
    counts = ends.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))
    out = points.join(counts, "point_id", "left")
    return out.select(F.col("point_id").alias("record_id"), F.coalesce("n", F.lit(0)).alias("neighbours"))


def p2_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per dataset with trusted positions (trust_rank 1): the valid positions inside the octagonal hull of these, its own and others'."""
    records = table(spark, sf_dir, "image_records")
    points = _positions(spark, sf_dir)
    # records far off the rest of their set would stretch its hull: the hull is that of the trusted scans
    trusted = records.where(F.col("trust_rank") == 1)
    owners = records.groupBy(F.col("record_id").alias("point_id")).agg(F.min("dataset_id").alias("dataset_id"))
    hull_points = positions(trusted, "record_id", F.col("exif.gps_latitude"), F.col("exif.gps_longitude")).join(owners, "point_id")
    edges = ring_edges(footprints(hull_points, "dataset_id"))
    # hulls of sets with stray positions span degrees: coarser strips keep the binned edges few
    inside = points_in_regions(points, edges, strip_deg=0.25, points_per_salt=20_000)
    out = inside.join(owners, "point_id")
    own = F.col("dataset_id") == F.col("region_id")
    return out.groupBy(F.col("region_id").alias("dataset_id")).agg(
        F.count(F.when(own, 1)).alias("own_records"), F.count(F.when(~F.coalesce(own, F.lit(False)), 1)).alias("other_records")
    )


def _camera_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "colmap_images")
    cameras = table(spark, sf_dir, "colmap_cameras")
    return find_orphans(
        images, cameras, ["model_id", "camera_id"], ref_time="registered_at", valid_from="added_at", valid_to="deleted_at",
        id_cols=["model_id", "image_id"],
    ).withColumn("ref_kind", F.lit("camera"))


def _name_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "colmap_images")
    plain = plain_name(F.col("name"))
    return images.select("model_id", "image_id", "dataset_id", "registered_at", F.when(plain != "", plain).alias("plain"))


def _name_orphans(spark: SparkSession, sf_dir: str, semantics: str = "simple") -> DataFrame:
    records = table(spark, sf_dir, "image_records")
    prefix = F.concat(F.lit("/captures/"), F.col("dataset_id"), F.lit("/"))
    inner = F.when(F.startswith("path", prefix), F.expr("substr(path, length(dataset_id) + 12)"))
    partners = records.select(
        "dataset_id", plain_name(inner).alias("plain"),
        F.when(F.coalesce("source_exists", F.lit(True)), F.col("scanned_at")).alias("seen_at"),
        F.lit(None).cast("timestamp").alias("gone_at"),
    )
    return find_orphans(
        _name_refs(spark, sf_dir), partners, ["dataset_id", "plain"], ref_time="registered_at", valid_from="seen_at", valid_to="gone_at",
        id_cols=["model_id", "image_id"], semantics=semantics,
    ).withColumn("ref_kind", F.lit("name"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _camera_orphans(spark, sf_dir).unionByName(_name_orphans(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of registered images that had no partner at the time of registration."""
    return _orphans(spark, sf_dir).select("ref_kind", "reason", "model_id", "image_id")


def p6_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per referenced table, reason and month of registration."""
    table_name = F.when(F.col("ref_kind") == "camera", "colmap_cameras").otherwise("image_records")
    month = F.date_format("registered_at", "yyyy-MM")
    return _orphans(spark, sf_dir).groupBy(table_name.alias("table_name"), "reason", month.alias("month")).agg(F.count(F.lit(1)).alias("orphans"))


def p6_partial_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by dataset and name where a blank name or a null dataset leaves the other column to match some image: orphans at the time of registration."""
    return _name_orphans(spark, sf_dir, "partial").select("reason", "model_id", "image_id").distinct()


def p6_full_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a key must be given as a whole or not at all."""
    return _name_orphans(spark, sf_dir, "full").select("reason", "model_id", "image_id").distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_neighbour_counts, p2_footprints, p6_found, p6_orphans_by_month, p6_partial_names, p6_full_names)}


_VALID = """valid AS (SELECT DISTINCT record_id, exif.gps_latitude AS lat, exif.gps_longitude AS lon FROM image_records
  WHERE exif.gps_latitude BETWEEN -90 AND 90 AND exif.gps_longitude BETWEEN -180 AND 180
    AND NOT isnan(exif.gps_latitude) AND NOT isnan(exif.gps_longitude)
    AND NOT (exif.gps_latitude = 0 AND exif.gps_longitude = 0))"""

# An oracle by bands of latitude and a plain distance test; it shares no step with the crossing-parity plan.
_NEAR = f"""WITH {_VALID},
banded AS (SELECT *, CAST(floor(lat * 4000) AS BIGINT) AS band FROM valid),
pairs AS (
  SELECT a.record_id AS record_a, b.record_id AS record_b FROM banded a
  JOIN (SELECT *, unnest([band - 1, band, band + 1]) AS near_band FROM banded) b
    ON a.band = b.near_band AND a.record_id < b.record_id
  WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 25)"""

_ORPHANS = r"""WITH img AS (SELECT DISTINCT model_id, dataset_id, image_id, camera_id, name, registered_at FROM colmap_images),
cam AS (
  SELECT 'camera' AS ref_kind, i.model_id, i.image_id, i.registered_at,
    count(c.camera_id) AS partners,
    bool_or(c.added_at <= i.registered_at AND (c.deleted_at IS NULL OR c.deleted_at > i.registered_at)) AS present,
    bool_or(c.added_at > i.registered_at) AS later
  FROM img i LEFT JOIN colmap_cameras c ON c.model_id = i.model_id AND c.camera_id = i.camera_id
  WHERE i.camera_id IS NOT NULL GROUP BY ALL),
named AS (SELECT *, lower(replace(trim(name, E' \t'), '\', '/')) AS raw FROM img WHERE trim(name, E' \t') <> ''),
refs AS (SELECT *, CASE WHEN starts_with(raw, './') THEN substr(raw, 3) ELSE raw END AS plain FROM named),
recs AS (SELECT dataset_id, scanned_at, coalesce(source_exists, true) AS there,
    lower(replace(trim(substr(path, length(dataset_id) + 12), E' \t'), '\', '/')) AS plain FROM image_records),
nam AS (
  SELECT 'name' AS ref_kind, i.model_id, i.image_id, i.registered_at,
    count(r.plain) AS partners,
    bool_or(r.there AND r.scanned_at <= i.registered_at) AS present,
    bool_or(r.there AND r.scanned_at > i.registered_at) AS later
  FROM refs i LEFT JOIN recs r ON r.dataset_id = i.dataset_id AND r.plain = i.plain
  GROUP BY ALL),
orphans AS (
  SELECT ref_kind, CASE WHEN partners = 0 THEN 'missing' WHEN later THEN 'late' ELSE 'deleted' END AS reason, model_id, image_id, registered_at
  FROM (SELECT * FROM cam UNION ALL SELECT * FROM nam) WHERE NOT coalesce(present, false))"""


_MASKED = r"""WITH img AS (SELECT DISTINCT model_id, image_id, dataset_id, name, registered_at FROM colmap_images),
raw AS (SELECT *, nullif(lower(replace(trim(name, E' \t'), '\', '/')), '') AS r FROM img),
refs AS (SELECT model_id, image_id, dataset_id, registered_at, CASE WHEN starts_with(r, './') THEN nullif(substr(r, 3), '') ELSE r END AS plain FROM raw),
recs AS (SELECT dataset_id, scanned_at, coalesce(source_exists, true) AS there, lower(replace(trim(substr(path, length(dataset_id) + 12), E' \t'), '\', '/')) AS plain FROM image_records),
both_cols AS (SELECT dataset_id, plain, min(scanned_at) FILTER (WHERE there) AS f, max(scanned_at) FILTER (WHERE there) AS l FROM recs WHERE dataset_id IS NOT NULL AND plain IS NOT NULL GROUP BY ALL),
sets AS (SELECT dataset_id, min(scanned_at) FILTER (WHERE there) AS f, max(scanned_at) FILTER (WHERE there) AS l FROM recs WHERE dataset_id IS NOT NULL GROUP BY ALL),
names AS (SELECT plain, min(scanned_at) FILTER (WHERE there) AS f, max(scanned_at) FILTER (WHERE there) AS l FROM recs WHERE plain IS NOT NULL GROUP BY ALL),
seen AS (
  SELECT 'whole' AS mask, x.*, p.f, p.l, p.plain IS NOT NULL AS known FROM refs x LEFT JOIN both_cols p ON p.dataset_id = x.dataset_id AND p.plain = x.plain WHERE x.dataset_id IS NOT NULL AND x.plain IS NOT NULL
  UNION ALL SELECT 'part', x.*, p.f, p.l, p.dataset_id IS NOT NULL FROM refs x LEFT JOIN sets p ON p.dataset_id = x.dataset_id WHERE x.dataset_id IS NOT NULL AND x.plain IS NULL
  UNION ALL SELECT 'part', x.*, p.f, p.l, p.plain IS NOT NULL FROM refs x LEFT JOIN names p ON p.plain = x.plain WHERE x.dataset_id IS NULL AND x.plain IS NOT NULL),
told AS (SELECT *, CASE WHEN NOT known THEN 'missing' WHEN l > registered_at THEN 'late' ELSE 'deleted' END AS reason, coalesce(f <= registered_at, false) AS present FROM seen)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _NEAR + " SELECT record_a, record_b FROM pairs",
        "p2_neighbour_counts": _NEAR + """,
ends AS (SELECT record_a AS record_id FROM pairs UNION ALL SELECT record_b FROM pairs)
SELECT v.record_id, count(e.record_id) AS neighbours FROM valid v LEFT JOIN ends e ON e.record_id = v.record_id GROUP BY v.record_id""",
        "p2_footprints": f"""WITH {_VALID},
owned AS (SELECT v.*, r.dataset_id, r.trust_rank FROM valid v JOIN (SELECT DISTINCT record_id, dataset_id, trust_rank FROM image_records) r USING (record_id)),
hull AS (SELECT dataset_id, min(lon) - 1e-7 AS w, max(lon) + 1e-7 AS e, min(lat) - 1e-7 AS s, max(lat) + 1e-7 AS n,
    min(lon + lat) - 1e-7 AS sw, max(lon + lat) + 1e-7 AS ne, min(lon - lat) - 1e-7 AS nw, max(lon - lat) + 1e-7 AS se
  FROM owned WHERE trust_rank = 1 GROUP BY dataset_id)
SELECT h.dataset_id, count(*) FILTER (WHERE o.dataset_id = h.dataset_id) AS own_records,
  count(*) FILTER (WHERE o.dataset_id IS DISTINCT FROM h.dataset_id) AS other_records
FROM hull h JOIN owned o ON o.lon BETWEEN h.w AND h.e AND o.lat BETWEEN h.s AND h.n
  AND o.lon + o.lat BETWEEN h.sw AND h.ne AND o.lon - o.lat BETWEEN h.nw AND h.se
GROUP BY h.dataset_id""",
        "p6_found": _ORPHANS + " SELECT DISTINCT ref_kind, reason, model_id, image_id FROM orphans",
        "p6_partial_names": _MASKED + " SELECT DISTINCT reason, model_id, image_id FROM told WHERE NOT present",
        "p6_full_names": _MASKED + " SELECT DISTINCT CASE WHEN mask = 'part' THEN 'partial_null' ELSE reason END AS reason, model_id, image_id FROM told WHERE mask = 'part' OR NOT present",
        "p6_orphans_by_month": _ORPHANS + """
SELECT CASE WHEN ref_kind = 'camera' THEN 'colmap_cameras' ELSE 'image_records' END AS table_name, reason,
  strftime(registered_at, '%Y-%m') AS month, count(*) AS orphans FROM orphans GROUP BY ALL""",
    }
