import datetime as dt
import random

from pyspark.sql import functions as F

from viewlake.llm.survivors import learn_precedence, survivors, topological_levels
from viewlake.session import Scratch

T = lambda d: dt.datetime(2025, 1, d, tzinfo=dt.timezone.utc)
SCHEMA = "path string, record_id bigint, scanned_at timestamp, trust_rank int, score double, make string, focal double, level string"


def run(spark, groups, rows, salt=200_000):
    g = spark.createDataFrame(groups, "grp bigint, path string, keep string")
    df = spark.createDataFrame(rows, SCHEMA)
    out = survivors(g.select("grp", "path"), df, best=F.col("score"), fields={"camera": F.col("make").isNotNull(), "focal": F.coalesce(F.col("focal") > 0, F.lit(False))}, attributes=["make"], rows_per_salt=salt)
    return {(r["grp"], r["field_name"]): r["record_id"] for r in out.collect()}


def brute(groups, rows):
    out = {}
    low = dt.datetime(1, 1, 1, tzinfo=dt.timezone.utc)
    for g in {g for g, _, _ in groups}:
        own = {r for r in rows if (g, r[0]) in {(a, b) for a, b, _ in groups}}
        if not own:
            continue
        full = lambda r: (r[5] is not None) + ((r[6] or 0) > 0)
        out[g, "keep"] = max(own, key=lambda r: (r[4] is not None, r[4] or 0, full(r), r[2] or low, -r[1]))[1]
        for name, has in (("camera", lambda r: r[5] is not None), ("focal", lambda r: (r[6] or 0) > 0)):
            ok = [r for r in own if has(r)]
            if ok:
                out[g, name] = max(ok, key=lambda r: (r[3] is not None, -(r[3] or 0), r[2] or low, -r[1]))[1]
    return out


def test_dated_records_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"p{rng.randint(0, 25)}", i, T(rng.randint(1, 5)), rng.choice([1, 2, None]), rng.choice([None, 1.0, 2.0]), rng.choice([None, "A"]), rng.choice([None, 0.0, 4.5]), "x") for i in range(120)]
    groups = [(rng.randint(1, 8), f"p{rng.randint(0, 30)}", "x") for _ in range(40)] + [(99, "gone", "x"), (1, None, "x")]
    want = brute(groups, rows)
    assert run(spark, groups + groups[:9], rows + rows[:9]) == want
    assert run(spark, groups, rows, salt=1) == want


def test_missing_times_are_reasoned_from_values(spark):
    # elsewhere v1 was followed by v2 twice, and by v3 through v2
    past = [("a", 1, T(1), 1, None, "v1", None, ""), ("a", 2, T(2), 1, None, "v2", None, ""), ("b", 3, T(1), 1, None, "v1", None, ""), ("b", 4, T(3), 1, None, "v2", None, ""),
            ("c", 5, T(1), 1, None, "v2", None, ""), ("c", 6, T(2), 1, None, "v3", None, ""), ("d", 7, T(1), 1, None, "v2", None, ""), ("d", 8, T(2), 1, None, "v1", None, "")]
    mine = [("m", 10, T(5), 1, None, "v2", None, ""), ("m", 11, None, 1, None, "v3", None, ""), ("m", 12, None, 1, None, "v1", None, ""), ("m", 13, T(4), 1, None, "v1", None, "")]
    df = spark.createDataFrame(past, SCHEMA)
    learned = {(r["earlier"], r["later"]): r["seen"] for r in learn_precedence(df, "path", "scanned_at", ["make"]).collect()}
    assert learned == {("v1", "v2"): 2, ("v2", "v3"): 1}  # the reverse was seen once
    levels = topological_levels(Scratch(spark), learn_precedence(df, "path", "scanned_at", ["make"]))
    assert {r["value"]: r["level"] for r in levels.collect()} == {"v2": 1, "v3": 2}
    # 11 has v3, which comes after the v2 of record 10: its successor
    assert run(spark, [(1, "m", "")], past + mine)[1, "camera"] == 11
    older = [r if r[1] != 10 else ("m", 10, T(3), 1, None, "v2", None, "") for r in mine]
    # now v2 is followed by v1 as often as it follows it, which says nothing; the latest dated one is 13 (v1), 12 has the same value, 11 only comes after record 10
    assert run(spark, [(1, "m", "")], past + older)[1, "camera"] == 13
    # among undated ones that nothing dates, the topologically later value wins
    undated = [("m", 20, None, 1, None, "v2", None, ""), ("m", 21, None, 1, None, "v3", None, ""), ("m", 22, None, 1, None, "v9", None, "")]
    assert run(spark, [(1, "m", "")], past + undated)[1, "camera"] == 21


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, "p", "")], []) == {}


def test_an_undated_record_outranks_the_dated_one_before_it(spark):
    # v1 < v2 < v3 by neighbours only; w1 < w2 < w3 < w1 is a cycle
    past = []
    for i, (a, b) in enumerate([("v1", "v2"), ("v2", "v3"), ("w1", "w2"), ("w2", "w3"), ("w3", "w1")]):
        past += [(f"q{i}", 100 + 2 * i, T(1), 1, None, a, None, ""), (f"q{i}", 101 + 2 * i, T(2), 1, None, b, None, "")]

    def camera(*mine):
        g = spark.createDataFrame([(1, "m")], "grp bigint, path string")
        df = spark.createDataFrame(past + [("m", i, t, 1, None, v, None, "") for i, t, v in mine], SCHEMA)
        out = survivors(g, df, best=F.col("score"), fields={"camera": F.col("make").isNotNull()}, attributes=["make"])
        return {r["field_name"]: r["record_id"] for r in out.collect()}["camera"]

    assert camera((10, T(5), "v1"), (11, None, "v3")) == 11  # through v2, which the group lacks
    assert camera((10, T(5), "v1"), (11, None, "v2"), (12, None, "v3")) == 12
    assert camera((10, T(5), "v3"), (11, None, "v1")) == 10
    assert camera((10, T(5), "v1"), (9, None, "v1")) == 10  # the same value: behind
    assert camera((10, T(5), "v1"), (13, T(5), "v3"), (11, None, "v2")) == 10  # one of that time follows
    assert camera((10, T(5), "w1"), (11, None, "w2")) == 10  # a cycle says nothing
