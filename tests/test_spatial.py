import math
import random

import pytest
from pyspark.sql import functions as F

from viewlake.operators.spatial import EARTH_RADIUS_M, footprints, near_pairs, points_in_regions, positions, ring_edges


def distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, x)))


def brute(points, radius):
    return {(i, j) for i, p in points for j, q in points if i < j and distance(p, q) <= radius}


def frame(spark, points):
    return spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in points], "point_id bigint, lat double, lon double")


@pytest.mark.parametrize("centre", [(48.0, 11.0), (0.0005, 0.0005), (-34.06, 179.9999), (51.0, -180.0), (89.9999, 20.0), (-89.9995, 0.0)])
def test_near_pairs_equal_brute_force(spark, centre):
    rng = random.Random(7)
    points = []
    for i in range(120):
        lat = max(-90.0, min(90.0, centre[0] + rng.uniform(-0.0006, 0.0006)))
        lon = centre[1] + rng.uniform(-0.0008, 0.0008) / max(0.01, math.cos(math.radians(lat)))
        lon = (lon + 180) % 360 - 180
        points.append((i, (lat, lon)))
    points += [(200, points[0][1]), (201, points[0][1])]  # ties: the same place
    got = {(r["id_a"], r["id_b"]) for r in near_pairs(frame(spark, points), 25.0).collect()}
    assert got == brute(points, 25.0)
    assert got


def test_hot_cell_is_split_and_whole(spark):
    rng = random.Random(3)
    points = [(i, (10 + rng.uniform(0, 0.0004), 10 + rng.uniform(0, 0.0004))) for i in range(300)]
    from viewlake.operators.spatial import cap_edges

    df = frame(spark, points)
    found = points_in_regions(df, cap_edges(df, 25.0), strip_deg=0.001, points_per_salt=20, carry=("lat", "lon", "r_lat", "r_lon"))
    pairs = {(r["point_id"], r["region_id"]) for r in found.collect() if distance((r["lat"], r["lon"]), (r["r_lat"], r["r_lon"])) <= 25}
    assert pairs == {(j, i) for i, p in points for j, q in points if distance(p, q) <= 25.0}


def test_positions_drop_invalid_and_repeated_rows(spark):
    nan = float("nan")
    rows = [(1, 1.0, 2.0), (1, 1.0, 2.0), (2, None, 2.0), (3, nan, 1.0), (4, 0.0, 0.0), (5, 91.0, 0.0), (6, 0.0, 181.0), (7, 90.0, -180.0), (None, 1.0, 1.0), (8, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "record_id bigint, a double, b double")
    got = {tuple(r) for r in positions(df, "record_id", F.col("a"), F.col("b")).collect()}
    assert got == {(1, 1.0, 2.0), (7, 90.0, -180.0), (8, 0.0, 5.0)}


def test_no_points(spark):
    assert near_pairs(frame(spark, []), 25.0).count() == 0


def inside(point, ring):
    y, x = point
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 <= y < y2 or y2 <= y < y1) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def regions(spark, rings):
    return spark.createDataFrame([(k, [{"lon": float(x), "lat": float(y)} for x, y in r]) for k, r in rings.items()], "region_id string, ring array<struct<lon: double, lat: double>>")


def test_regions_with_holes_of_shape_and_boundaries(spark):
    rings = {"star": [(0, 0), (4, 1), (8, 0), (5, 4), (8, 8), (4, 6), (0, 8), (2, 4)], "box": [(1, 1), (3, 1), (3, 3), (1, 3)], "line": [(0, 0), (1, 1)]}
    rng = random.Random(5)
    points = [(i, (rng.uniform(-1, 9), rng.uniform(-1, 9))) for i in range(400)]
    got = {tuple(r) for r in points_in_regions(frame(spark, points), ring_edges(regions(spark, rings)), strip_deg=0.7).collect()}
    assert got == {(i, k) for i, p in points for k in ("star", "box") if inside(p, rings[k])}
    edge = [(1, (1.0, 2.0)), (2, (3.0, 3.0)), (3, (2.0, 1.0)), (4, (2.0, 3.0)), (5, (2.0, 2.0)), (6, (3.0, 2.0))]
    box = ring_edges(regions(spark, {"box": rings["box"]}))
    assert {r["point_id"] for r in points_in_regions(frame(spark, edge), box, strip_deg=0.5).collect()} == {1, 2, 3, 4, 5, 6}
    assert {r["point_id"] for r in points_in_regions(frame(spark, edge), box, strip_deg=0.5, boundary="outside").collect()} == {5}


def test_region_across_the_date_line(spark):
    box = ring_edges(regions(spark, {"d": [(179, -1), (181, -1), (181, 1), (179, 1)]}))
    points = frame(spark, [(1, (0, 179.5)), (2, (0, -179.5)), (3, (0, 178.5)), (4, (0, -178.5)), (5, (0, 180.0)), (6, (0, -180.0))])
    assert {r["point_id"] for r in points_in_regions(points, box, strip_deg=0.5).collect()} == {1, 2, 5, 6}


def test_footprint_holds_its_own_points(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.uniform(40, 41), rng.uniform(7, 9), "a" if i % 2 else "b") for i in range(60)] + [(99, 45.0, 3.0, "one")], "point_id bigint, lat double, lon double, g string")
    got = points_in_regions(df, ring_edges(footprints(df, "g")), strip_deg=0.1).join(df, "point_id").where(F.col("g") == F.col("region_id")).count()
    assert got == 61
