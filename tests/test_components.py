import random

import numpy as np
import pytest

from viewlake.operators import components
from viewlake.session import Scratch


def brute(links):
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_local_minima():
    rng = random.Random(1)
    links = [(rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(50)] + [(7, 200), (200, 201), (201, 202)]
    u, v = components.local_minima(np.array([b for _, b in links]), np.array([a for a, _ in links]))
    want = brute(links)
    assert dict(zip(u.tolist(), v.tolist())) == {x: r for x, r in want.items() if x != r}


@pytest.mark.parametrize("few", [True, False])
def test_components_equal_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(components, "ROWS_PER_SALT", 5)
        monkeypatch.setattr(components, "CHUNK", 7)
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(1000, 1080)]
    links = chain + [(5, x) for x in range(2000, 2100)] + [(rng.randint(3000, 3100), rng.randint(3101, 3200)) for _ in range(90)]
    rng.shuffle(links)
    df = spark.createDataFrame(links + links[:9] + [(b, a) for a, b in links[:9]], "src bigint, dst bigint").repartition(6)
    got = {r["id"]: r["label"] for r in components.spread_minima(Scratch(spark), df).collect()}
    assert got == brute(links)


def test_no_links(spark):
    df = spark.createDataFrame([], "src bigint, dst bigint")
    assert components.spread_minima(Scratch(spark), df).count() == 0
