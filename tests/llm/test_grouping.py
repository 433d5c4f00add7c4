import random

import pytest

from viewlake.llm.grouping import connected, link_paths
from viewlake.session import Scratch


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("rounds", [1, 3, 12])
def test_components_with_a_hub_and_a_long_chain(spark, rounds):
    rng = random.Random(rounds)
    hub = [(50, 1000 + i) for i in range(120)]
    chain = [(1000 + i, 2000 + i) for i in range(3)] + [(2000 + i, 2001 + i) for i in range(40)]
    small = [(rng.randint(3000, 3100), rng.randint(3000, 3100)) for _ in range(60)] + [(4001, 4000), (7, 7)]
    edges = hub + chain + small
    df = spark.createDataFrame(edges + edges[:20] + [(b, a) for a, b in edges[:20]], "src bigint, dst bigint")
    got, giant = connected(Scratch(spark), df, rounds)
    assert {r["id"]: r["label"] for r in got.collect()} == brute([e for e in edges if e[0] != e[1]])
    assert giant == 50


def test_no_links(spark):
    got, giant = connected(Scratch(spark), spark.createDataFrame([(1, 1)], "src bigint, dst bigint"))
    assert giant is None and got.count() == 0


def link(spark, records, pairs, clusters, **more):
    r = spark.createDataFrame(records, "path string, perceptual_hash string, row string")
    p = spark.createDataFrame(pairs, "left_path string, right_path string, id int")
    c = spark.createDataFrame(clusters, "representative string, members array<string>, a int")
    return {x["path"]: x["group_path"] for x in link_paths(r, p, c, 6, **more).collect()}


RECORDS = [("p1", "0x0F", "r"), ("p1", " f", "r"), ("p2", "1F", "r"), ("p3", "FFFFFFFF", "r"), ("p4", None, "r"), ("p5", "", "r"), ("p6", "zz", "r"), ("p7", "0", "r"), (None, "f", "r"), ("p8", "7", "r"), ("Z", "5", "r")]


@pytest.mark.parametrize("salt", [200_000, 1])
def test_links_through_hashes_and_rows(spark, salt):
    pairs = [("p1", "p2", 1), ("p2", "p1", 1), ("p1", "p1", 1), ("p1", "p3", 1), ("p4", "p1", 1), ("p6", "p7", 1), (None, "p1", 1), ("p1", "gone", 1), ("p2", "p8", 1), ("p8", "Z", 1)]
    clusters = [("p4", ["p5", "p5", None, "gone"], 1), ("p4", ["p5", "p5", None, "gone"], 1), (None, ["p3", "gone"], 1), ("gone", None, 1), (None, None, 1)]
    got = link(spark, RECORDS, pairs, clusters, rows_per_salt=salt)
    # byte order: Z comes before p1; a path that only a missing path connects stays alone
    assert got == {"p1": "Z", "p2": "Z", "p8": "Z", "Z": "Z", "p4": "p4", "p5": "p4"}


def test_a_missing_path_links_nothing(spark):
    got = link(spark, RECORDS, [], [("p1", ["gone"], 1), ("p2", ["gone"], 1), ("p3", ["p7"], 1)])
    assert got == {"p3": "p3", "p7": "p3"}


def test_empty_tables(spark):
    assert link(spark, [], [("p1", "p2", 1)], [("p1", ["p2"], 1)]) == {}
    assert link(spark, RECORDS, [], []) == {}
