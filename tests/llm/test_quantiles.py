import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viewlake.llm import quantiles as Q
from viewlake.llm.cutoffs import exact_cutoffs, keep_above


def estimate(vals, wts, x):
    return wts[vals <= x].sum()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-50, 50).map(lambda v: round(v, 1)), min_size=1, max_size=900), st.integers(2, 16), st.integers(1, 5))
def test_rank_error_stays_within_its_bound(values, k, parts):
    """However a column is cut into partitions and however their sketches are merged."""
    values = np.array(values)
    sketches = [Q.compress(p, np.ones(len(p), np.int64), k, 0, 0) for p in np.array_split(values, parts) if len(p)]
    while len(sketches) > 1:
        a, b = sketches.pop(), sketches.pop()
        sketches.insert(0, Q.compress(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), k, a[2] + b[2], a[3] + b[3]))
    vals, wts, plus, minus = sketches[0]
    assert wts.sum() == len(values)
    for x in np.unique(values):
        assert -minus <= estimate(vals, wts, x) - (values <= x).sum() <= plus
    for w in np.unique(wts):
        assert (wts == w).sum() < 2 * k


def test_error_is_small():
    values = np.random.default_rng(1).lognormal(size=400_000)
    vals, wts, plus, minus = Q.compress(values, np.ones(len(values), np.int64), 1024, 0, 0)
    assert max(plus, minus) / len(values) < 0.002 and len(vals) < 12_000


def test_buffer_size_keeps_the_error():
    assert Q.buffer_size(0.01) == 1024 and Q.buffer_size(0.5, 100) == 16
    values = np.random.default_rng(2).normal(size=100_000)
    k = Q.buffer_size(0.002, len(values))
    parts = [Q.compress(p, np.ones(len(p), np.int64), k, 0, 0) for p in np.array_split(values, 7)]
    vals, wts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    *_, plus, minus = Q.compress(vals, wts, k, sum(p[2] for p in parts), sum(p[3] for p in parts))
    assert max(plus, minus) <= 0.002 * len(values)


@pytest.mark.parametrize("part_values", [40, 10_000])
def test_hot_keys_are_merged_in_parts(spark, part_values):
    """A key that holds most values, among keys of a few, gives the same counts and true bounds however it is merged."""
    rng = np.random.default_rng(6)
    rows = [("hot" if i % 10 else f"k{i % 70}", None, float(v), "x", 1) for i, v in enumerate(rng.normal(size=3000))]
    df = table(spark, rows).repartition(9)
    got = {r["folder"]: r for r in Q.percentiles(Q.merge(Q.sketch(df, ["folder"], "v", 16), ["folder"], 16, part_values=part_values), ["folder"], [500]).collect()}
    for f, r in got.items():
        own = np.array([v for g, _, v, _, _ in rows if g == f])
        assert r["n"] == len(own)
        assert abs((own <= r["p500"]).sum() - math.ceil(len(own) / 2)) <= r["rank_error"] * len(own) + 1e-9
    assert len(got) == 8 and 0 < got["hot"]["rank_error"] < 0.25


def table(spark, rows):
    return spark.createDataFrame(rows, "folder string, day date, v double, n string, vals int")


@pytest.mark.parametrize("limit", [Q.FLUSH, 100])
def test_percentiles_per_day_merge_into_longer_periods(spark, limit):
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", dt.date(2025, 1, 1 + i % 4), float(np.round(rng.exponential(), 2)), "x", 1) for i in range(6000)]
    rows += [("c", dt.date(2025, 1, 1), v, "x", 1) for v in (float("nan"), float("inf"), None)] + [(None, None, 7.0, "x", 1), ("tie", dt.date(2025, 1, 1), 2.0, "x", 1)] * 3
    df = table(spark, rows).repartition(5)
    keys = ["folder", "day"]
    days = Q.merge(Q.sketch(df, keys, "v", 32, limit), keys, 32, limit=limit)
    whole = Q.percentiles(Q.merge(days, ["folder"], 32, limit=limit, part_values=150), ["folder"], [0, 100, 500, 990, 1000]).collect()
    assert {r["folder"] for r in whole} == {"a", "b", None, "tie"}  # nothing usable, no row
    for r in whole:
        own = np.sort([v for f, _, v, _, _ in rows if f == r["folder"] and v is not None and math.isfinite(v)])
        assert r["n"] == len(own)
        for q in (0, 100, 500, 990, 1000):
            rank = max(1, math.ceil(q * len(own) / 1000))
            value = r[f"p{q:03d}"]
            low, high = (own < value).sum() + 1, (own <= value).sum()
            slack = r["rank_error"] * r["n"]
            assert low - slack - 1e-9 <= rank <= high + slack + 1e-9
    assert {r["n"] for r in Q.percentiles(days, keys, [500]).where("folder is null").collect()} == {3}


def test_no_rows(spark):
    empty = table(spark, [])
    assert Q.percentiles(Q.merge(Q.sketch(empty, ["folder"], "v"), ["folder"]), ["folder"], [500]).count() == 0


@pytest.mark.parametrize("k, bracket, few", [(4, 3, True), (16, 3, False), (1024, 2_000_000, True)])
def test_cutoffs_equal_brute_force(spark, monkeypatch, k, bracket, few):
    if not few:
        monkeypatch.setattr("viewlake.operators.skew.BROADCAST_ROWS", 0)
        monkeypatch.setattr("viewlake.operators.skew.attach.__defaults__", (100,))
    rng = np.random.default_rng(k)
    rows = [("hot", i, float(np.round(rng.normal(50, 9), 1)), "x") for i in range(900)] + [("ties", 1000 + i, 5.0, "x") for i in range(50)]
    rows += [("few", 2000 + i, float(i), "x") for i in range(3)] + [("none", 3000, 1.0, "x"), ("over", 3001, 1.0, "x")]
    df = spark.createDataFrame(rows, "folder string, record_id bigint, score double, cutoff string").repartition(4)
    targets = [("hot", 333), ("hot", None), ("few", 999), ("none", 0), ("over", 1001), ("absent", 10), (None, 5)]
    t = spark.createDataFrame(targets, "folder string, keep_permille int")
    got = exact_cutoffs(df, t, "folder", "score", default_permille=500, k=k, bracket_rows=bracket)
    want = {}
    for g, permille in (("hot", 333), ("ties", 500), ("few", 999), ("none", 0), ("over", 1001)):
        own = [s for f, _, s, _ in rows if f == g]
        ok = [s for s in own if 1000 * sum(x >= s for x in own) >= permille * len(own)]
        want[g] = (len(own), permille, max(ok) if ok else None, sum(x >= max(ok) for x in own) if ok else 0)
    assert {r["folder"]: (r["n"], r["keep_permille"], r["cutoff"], r["kept"]) for r in got.collect()} == want
    kept = keep_above(df.drop("cutoff"), got, "folder", "score").groupBy("folder").agg(F.count("*").alias("n")).collect()
    assert {r["folder"]: r["n"] for r in kept} == {g: w[3] for g, w in want.items() if w[3]}


def test_cutoffs_of_no_scores(spark):
    df = spark.createDataFrame([], "folder string, record_id bigint, score double")
    t = spark.createDataFrame([], "folder string, keep_permille int")
    assert exact_cutoffs(df, t, "folder", "score", default_permille=500).count() == 0
