import random

import pytest
from pyspark.sql import functions as F

from viewlake.functions import columns as C
from viewlake.operators import stats


def one(spark, value, column):
    row = spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(("path", "suffix"), [("a/b.JPG", ".jpg"), ("a/.jpg", ""), ("a/x", ""), ("a.b/c", ""), ("a/b.tar.PNG", ".png"), ("_a.png", ".png"), (".b.png", ".png")])
def test_suffix(spark, path, suffix):
    assert one(spark, path, C.suffix) == suffix


def test_component_order(spark):
    paths = ["/a/b.c/x.png", "/a/b/x.png", "/a/b", "/a/b/x.png/y"]
    df = spark.createDataFrame([("g", p) for p in paths], "g string, path string")
    got = stats.component_order(df, "g", "path", C.path_order(F.col("path"))).orderBy("place")
    assert [r["path"] for r in got.collect()] == ["/a/b", "/a/b/x.png", "/a/b/x.png/y", "/a/b.c/x.png"]


def test_component_order_over_several_parts(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice(["a", "b", None]), "/".join(rng.choice(["x", "x.y", "x-1", "é", ""]) for _ in range(rng.randint(1, 5)))) for _ in range(400)}, key=str)
    df = spark.createDataFrame(rows, "g string, path string").repartition(7)
    got = {(r["g"], r["path"]): r["place"] for r in stats.component_order(df, "g", "path", C.path_order(F.col("path"))).collect()}
    want = {}
    for g in ("a", "b", None):
        for i, p in enumerate(sorted((p for k, p in rows if k == g), key=lambda p: [x.encode() for x in p.split("/")]), 1):
            want[g, p] = i
    assert got == want


def test_parent_key(spark):
    got = {p: one(spark, p, lambda c: C.parent_key(c, "/data/set")) for p in ("/data/set/x.png", "/data/set/a/b/x.png", "/data/setx/y.png", "/other/z/x.png")}
    assert got == {"/data/set/x.png": ".", "/data/set/a/b/x.png": "a/b", "/data/setx/y.png": "setx", "/other/z/x.png": "z"}


@pytest.mark.parametrize(("text", "value"), [(" 0X00ff ", 255), ("ffffffffffffffff", -1), ("0", 0), ("0x0", 0), ("", None), ("xyz", None), ("1" + "0" * 16, None), ("000" + "8" * 16, -0x7777777777777778), (None, None)])
def test_parse_hash(spark, text, value):
    assert one(spark, text, C.parse_hash) == value


def test_rationals_and_positions(spark):
    df = spark.createDataFrame([("1", "4"), ("1", "0"), ("x", "2")], "a string, b string")
    assert [r[0] for r in df.select(C.rational(F.col("a"), F.col("b"))).collect()] == [0.25, None, None]
    rows = [([10.0, 30.0, 36.0], "S"), ([10.0, 30.0, 36.0], None), ([10.0, None, 1.0], "N"), ([1.0, 2.0], "N")]
    df = spark.createDataFrame(rows, "p array<double>, r string")
    assert [r[0] for r in df.select(C.dms_to_decimal(F.col("p"), F.col("r"))).collect()] == [-10.51, 10.51, None, None]


def test_threshold_equality_flags_nothing(spark):
    schema = "q struct<blur_score: double, exposure_mean: double, clipped_ratio: double, noise_score: double, sky_reflective_ratio: double>"
    rows = [((80.0, 0.2, 0.03, 0.12, 0.35),), ((79.9, 0.81, 0.04, 0.13, 0.36),), ((100.0, 0.19, None, None, None),)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(C.quality_flags(F.col("q"))).collect()]
    assert got == [[], ["blurry", "overexposed", "clipped_highlights", "high_noise", "sky_or_reflective_dominance"], ["underexposed"]]


def test_average_hash_and_hex(spark):
    tile = [float(x % 2) for x in range(64)]
    df = spark.createDataFrame([(tile,), ([1.0] * 64,)], "v array<double>")
    assert [r[0] for r in df.select(C.hash_hex(C.average_hash(F.col("v")))).collect()] == ["5555555555555555", "0" * 16]


def test_frame_rate(spark):
    rows = [(1, 0.1, 1), (1, 0.6, 2), (1, 0.4, 3), (1, 1.2, 4), (2, 0.2, 5), (2, None, 6)]
    df = spark.createDataFrame(rows, "k int, s double, e int").withColumn("t", F.col("s").cast("timestamp"))
    got = stats.first_per_bucket(df.select("k", "t", "e"), "k", "t", 0.5, "e")
    assert sorted(r["e"] for r in got.collect()) == [1, 2, 4, 5]
