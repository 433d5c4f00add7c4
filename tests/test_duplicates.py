import random

import numpy as np
import pytest

from viewlake.operators.components import spread_minima
from viewlake.operators.duplicates import bands_to_agree, cluster_stats, duplicate_members, hamming_join, representatives
from viewlake.session import Scratch


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[rb] = ra
    return find


def hashes(seed, n):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(8)] + [0, (1 << 64) - 1]
    out = []
    for i in range(n):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randint(0, 63)
        out.append((rng.choice("ab"), i, h))
    return out


def test_more_bands_for_larger_groups():
    assert [bands_to_agree(6, n) for n in (10, 200_000, 10_000_000)] == [1, 2, 3]
    assert bands_to_agree(20, 10_000_000) == 1 and bands_to_agree(0, 0) == 1


@pytest.mark.parametrize("distance, salt, agreeing", [(0, 20_000, None), (3, 5, 2), (3, 20_000, 3), (6, 20_000, None), (6, 5, 2), (6, 20_000, 3), (20, 20_000, None), (20, 5, 1)])
def test_pairs_equal_brute_force(spark, distance, salt, agreeing):
    rows = sorted({(g, h) for g, _, h in hashes(distance, 120)})
    df = spark.createDataFrame([(g, signed(h)) for g, h in rows] + [("a", None)], "g string, h bigint")
    got = sorted((r["g"], r["h_a"], r["h_b"], r["bits"]) for r in hamming_join(Scratch(spark), df, ["g"], distance, salt, agreeing).collect())
    want = sorted((g, signed(a), signed(b), bin(a ^ b).count("1")) for g, a in rows for k, b in rows if g == k and signed(a) < signed(b) and bin(a ^ b).count("1") <= distance)
    assert got == want


def test_clusters_stats_and_representatives(spark):
    rows = hashes(11, 150) + [("a", 900, 5), (None, 901, 5), ("a", 902, None)]
    df = spark.createDataFrame([(g, i, None if h is None else signed(h), "x", 1) for g, i, h in rows], "g string, i bigint, h bigint, cluster string, n int")
    members = duplicate_members(df, "g", "i", 4)
    known = [(g, i, h) for g, i, h in rows if g and h is not None]
    edges = [(i, j) for g, i, h in known for k, j, l in known if g == k and i < j and bin(h ^ l).count("1") <= 4]
    find = union_find([i for _, i, _ in known], edges)
    groups = {}
    for g, i, h in known:
        groups.setdefault(find(i), []).append((i, h))
    groups = {root: m for root, m in groups.items() if len(m) > 1}
    want = {i: min(x for x, _ in m) for m in groups.values() for i, _ in m}
    assert {r["i"]: r["cluster"] for r in members.collect()} == want
    stats = {r["cluster"]: r for r in cluster_stats(members, "g").collect()}
    for m in groups.values():
        d = [bin(h ^ l).count("1") for i, h in m for j, l in m if i < j]
        s = stats[min(i for i, _ in m)]
        assert s["members"] == len(m) and s["average_distance"] == pytest.approx(np.mean(d)) and s["exact"] == (sum(d) == 0)
    roots = {r["cluster"]: r["representative"] for r in representatives(members, "g", "i", 4).collect()}
    assert roots == {min(i for i, _ in m): root for root, m in groups.items()}


def test_representative_of_a_chain_is_not_the_smallest(spark):
    df = spark.createDataFrame([("a", 0, 0b0000), ("a", 1, 0b1111), ("a", 2, 0b0011)], "g string, i bigint, h bigint")
    members = duplicate_members(df, "g", "i", 2)
    assert [r["cluster"] for r in members.collect()] == [0, 0, 0]
    assert representatives(members, "g", "i", 2).first()["representative"] == 1
    assert cluster_stats(members, "g").first()["exact"] is False


def test_uniform_images_are_exact_duplicates(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 0)], "g string, i bigint, h bigint")
    row = cluster_stats(duplicate_members(df, "g", "i", 6), "g").first()
    assert (row["members"], row["average_distance"], row["exact"]) == (2, 0.0, True)


def test_no_records(spark):
    df = spark.createDataFrame([], "g string, i bigint, h bigint")
    assert duplicate_members(df, "g", "i", 6).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs_and_chains(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(60)] + [(300 - i, 299 - i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["id"]: r["label"] for r in spread_minima(Scratch(spark), spark.createDataFrame(edges + edges[:5], "src bigint, dst bigint")).collect()}
    find = union_find({x for e in edges for x in e}, edges)
    groups = {}
    for x in {x for e in edges for x in e}:
        groups.setdefault(find(x), []).append(x)
    assert got == {x: min(m) for m in groups.values() for x in m}
