"""Points in regions and points near points, by crossing parity.

A region is a set of edges. Edges are binned into latitude strips (and, inside a
strip, into cells of longitude so that a strip around the globe is not one
bucket). Points join the edges of their own cell; a ray from the point to the
east crosses an edge or not; the crossings are grouped by point and region, and
an odd number means inside. The grouping keys contain the join keys, so the
grouping needs no second exchange.

Boundaries: an edge counts for latitudes from its lower end (included) to its
upper end (excluded), so a ray through a vertex is counted once, and horizontal
edges are never crossed. A point exactly on an edge is recognised on its own and
is inside or outside as the caller declares.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlake.operators.skew import Salter
from viewlake.session import Scratch

EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180


def valid_position(lat: Column, lon: Column) -> Column:
    """Both coordinates there, no NaN, in range, and not the placeholder (0, 0)."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    ok = ok & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(ok & ~((lat == 0.0) & (lon == 0.0)), F.lit(False))


def great_circle_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half_lat = F.radians(lat_b - lat_a) / 2
    half_lon = F.radians(lon_b - lon_a) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def _strip(lat: Column, strip_deg: float) -> Column:
    return F.floor((lat + 90.0) / F.lit(strip_deg)).cast("int")


def _cell_width(strip: Column, strip_deg: float) -> Column:
    """Degrees of longitude of a cell, about as wide as its strip is high; a function of the strip alone."""
    middle = F.radians((strip + F.lit(0.5)) * F.lit(strip_deg) - F.lit(90.0))
    return F.lit(strip_deg) / F.greatest(F.cos(middle), F.lit(1e-3))


def _cell(lon: Column, strip: Column, strip_deg: float) -> Column:
    return F.floor((lon + 180.0) / _cell_width(strip, strip_deg)).cast("int")


def bin_edges(edges: DataFrame, strip_deg: float) -> DataFrame:
    """Rows of (strip, cell) per edge.

    ``edges`` has x1, y1, x2, y2 (degrees) and x_min, the westernmost longitude of
    the region. A point can only cross the edge going east if it lies between
    x_min and the edge's eastern end, so no other cell gets the edge.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    out = edges.withColumn("strip", F.explode(F.sequence(_strip(low, strip_deg), _strip(high, strip_deg))))
    first = _cell(F.greatest(F.col("x_min"), F.lit(-180.0)), F.col("strip"), strip_deg)
    last = _cell(F.least(F.greatest("x1", "x2"), F.lit(180.0)), F.col("strip"), strip_deg)
    cells = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return out.withColumn("cell", F.explode(cells))


def points_in_regions(
    points: DataFrame,
    edges: DataFrame,
    *,
    strip_deg: float,
    boundary: str = "inside",
    pair_filter: Column | None = None,
    carry: tuple[str, ...] = (),
    points_per_salt: int = 4000,
    rays: bool = True,
) -> DataFrame:
    """(point_id, region_id, *carry) for each point inside a region.

    points: point_id (unique), lat, lon and further columns. edges: region_id, x1,
    y1, x2, y2, x_min and further columns. ``carry`` names numeric columns of either side
    to keep; ``pair_filter`` is a condition on columns of both sides, applied in the
    join. Cells with more than ``points_per_salt`` points are split over tasks.
    Null coordinates join nothing; no regions or no points give no rows.
    """
    scratch = Scratch(points.sparkSession)
    pts = points.withColumn("strip", _strip(F.col("lat"), strip_deg))
    pts = pts.withColumn("cell", _cell(F.col("lon"), F.col("strip"), strip_deg))
    binned = bin_edges(edges, strip_deg)
    salter = Salter(scratch, pts, ["strip", "cell"], points_per_salt, "cells")
    pts, binned = salter.big(pts, ["point_id"]), salter.other(binned)

    lat, lon = F.col("lat"), F.col("lon")
    spans = (F.least("y1", "y2") <= lat) & (lat < F.greatest("y1", "y2"))
    at = F.col("x1") + F.coalesce(F.try_divide((lat - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1")), F.lit(0.0))
    level = (F.col("y1") == F.col("y2")) & (lat == F.col("y1")) & lon.between(F.least("x1", "x2"), F.greatest("x1", "x2"))
    vertex = ((lat == F.col("y1")) & (lon == F.col("x1"))) | ((lat == F.col("y2")) & (lon == F.col("x2")))
    crosses, touches = spans & (lon < at), (spans & (lon == at)) | level | vertex
    met = crosses | touches
    if pair_filter is not None:
        met = met & pair_filter
    rows = pts.join(binned, salter.join_keys).where(met)
    grouped = rows.groupBy(*salter.join_keys, "point_id", "region_id").agg(
        F.sum(F.when(crosses, 1).otherwise(0)).alias("_crossings"),
        F.max(F.when(touches, 1).otherwise(0)).alias("_on"),
        *(F.max(c).alias(c) for c in carry),
    )
    odd = (F.col("_crossings") % 2) == 1
    inside = ((F.col("_on") == 1) | odd) if boundary == "inside" else ((F.col("_on") == 0) & odd)
    return grouped.where(inside).select("point_id", "region_id", *carry)


def ring_edges(regions: DataFrame) -> DataFrame:
    """Edges of closed rings: region_id, ring array<struct<lon, lat>> (at least three vertices; others give no edges).

    Longitudes may run beyond +-180; the edges are repeated shifted by 360 degrees
    where the region crosses the date line.
    """
    ring = F.col("ring")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(ring)),
        lambda i: F.struct(
            F.element_at(ring, i)["lon"].alias("x1"), F.element_at(ring, i)["lat"].alias("y1"),
            F.element_at(ring, i % F.size(ring) + 1)["lon"].alias("x2"), F.element_at(ring, i % F.size(ring) + 1)["lat"].alias("y2"),
        ),
    )
    lons = F.transform(ring, lambda p: p["lon"])
    rows = regions.where(F.size(ring) >= 3).select("region_id", F.array_min(lons).alias("x_min"), F.array_max(lons).alias("x_max"), F.explode(steps).alias("e"))
    return _wrapped(rows.select("region_id", "x_min", "x_max", "e.*"))


def _wrapped(edges: DataFrame) -> DataFrame:
    shifts = F.array_compact(F.array(F.lit(0.0), F.when(F.col("x_min") < -180, F.lit(360.0)), F.when(F.col("x_max") > 180, F.lit(-360.0))))
    out = edges.withColumn("_shift", F.explode(shifts))
    for c in ("x1", "x2", "x_min", "x_max"):
        out = out.withColumn(c, F.col(c) + F.col("_shift"))
    return out.drop("_shift")


def cap_edges(points: DataFrame, radius_m: float) -> DataFrame:
    """Edges of a box around the cap of ``radius_m`` about each point: its two meridian sides.

    The horizontal sides are never crossed by an eastward ray and are left out. The
    box is a hair larger than the cap, so nothing within the radius is on its
    boundary. A cap that holds a pole gets the whole circle of longitude.
    """
    angle = radius_m / EARTH_RADIUS_M
    pad = 1e-9
    d_lat = math.degrees(angle) * (1 + pad) + pad
    ratio = F.lit(math.sin(angle)) / F.cos(F.radians("lat"))
    polar = (F.abs("lat") + d_lat >= 90.0) | (ratio >= 1.0)
    d_lon = F.degrees(F.asin(ratio)) * (1 + pad) + pad
    west = F.when(polar, F.lit(-180.0 - pad)).otherwise(F.col("lon") - d_lon)
    east = F.when(polar, F.lit(180.0 + pad)).otherwise(F.col("lon") + d_lon)
    south, north = F.greatest(F.col("lat") - d_lat, F.lit(-90.0 - pad)), F.least(F.col("lat") + d_lat, F.lit(90.0 + pad))
    boxes = points.select(F.col("point_id").alias("region_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), west.alias("x_min"), east.alias("x_max"), south.alias("y1"), north.alias("y2"), polar.alias("_polar"))
    shifts = F.array_compact(F.array(F.lit(0.0), F.when(~F.col("_polar") & (F.col("x_min") < -180), F.lit(360.0)), F.when(~F.col("_polar") & (F.col("x_max") > 180), F.lit(-360.0))))
    boxes = boxes.withColumn("_shift", F.explode(shifts))
    boxes = boxes.withColumn("x_min", F.col("x_min") + F.col("_shift")).withColumn("x_max", F.col("x_max") + F.col("_shift"))
    sides = boxes.withColumn("x1", F.explode(F.array("x_min", "x_max")))
    return sides.select("region_id", "r_lat", "r_lon", "x_min", "x1", "y1", F.col("x1").alias("x2"), "y2")


def positions(records: DataFrame, id_col: str, lat: Column, lon: Column) -> DataFrame:
    """(point_id, lat, lon) of the valid positions. Repeated rows count once; an id with several positions keeps the smallest."""
    rows = records.select(F.col(id_col).alias("point_id"), lat.alias("lat"), lon.alias("lon"))
    rows = rows.where(F.col("point_id").isNotNull() & valid_position(F.col("lat"), F.col("lon")))
    return rows.groupBy("point_id").agg(F.min(F.struct("lat", "lon")).alias("p")).select("point_id", "p.lat", "p.lon")


def near_pairs(points: DataFrame, radius_m: float, *, strip_factor: float = 2.0) -> DataFrame:
    """(id_a, id_b, distance_m) with id_a < id_b for points at most ``radius_m`` apart.

    Each point's cap is a region; the points inside its box are found by crossing
    parity and then checked exactly along the great circle. Points at the same
    place are pairs at distance 0.
    """
    strip_deg = strip_factor * 2 * math.degrees(radius_m / EARTH_RADIUS_M)
    found = points_in_regions(
        points, cap_edges(points, radius_m), strip_deg=strip_deg,
        pair_filter=F.col("region_id") < F.col("point_id"), carry=("lat", "lon", "r_lat", "r_lon"),
    )
    distance = great_circle_m(F.col("r_lat"), F.col("r_lon"), F.col("lat"), F.col("lon"))
    return found.select(F.col("region_id").alias("id_a"), F.col("point_id").alias("id_b"), distance.alias("distance_m")).where(F.col("distance_m") <= radius_m)


#: Hulls are drawn this many degrees (about a centimetre) outside their outermost points.
HULL_PAD_DEG = 1e-7


def footprints(points: DataFrame, group_col: str) -> DataFrame:
    """Octagonal hull of each group's points, as (region_id, ring). Groups whose points span the date line get a wide hull."""
    pad = F.lit(HULL_PAD_DEG)
    lat, lon = F.col("lat"), F.col("lon")
    h = points.where(F.col(group_col).isNotNull()).groupBy(F.col(group_col).alias("region_id")).agg(
        (F.min(lon) - pad).alias("w"), (F.max(lon) + pad).alias("e"), (F.min(lat) - pad).alias("s"), (F.max(lat) + pad).alias("n"),
        (F.min(lon + lat) - pad).alias("sw"), (F.max(lon + lat) + pad).alias("ne"), (F.min(lon - lat) - pad).alias("nw"), (F.max(lon - lat) + pad).alias("se"),
    )
    c = F.col
    corners = [
        (c("w"), c("sw") - c("w")), (c("sw") - c("s"), c("s")), (c("se") + c("s"), c("s")), (c("e"), c("e") - c("se")),
        (c("e"), c("ne") - c("e")), (c("ne") - c("n"), c("n")), (c("nw") + c("n"), c("n")), (c("w"), c("w") - c("nw")),
    ]
    return h.select("region_id", F.array(*(F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners)).alias("ring"))
