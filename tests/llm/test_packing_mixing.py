import random
from collections import defaultdict

import pytest

from viewlake.llm import tokens
from viewlake.llm.mixing import budgets, mix_sources
from viewlake.llm.packing import Packer, bins, pack


def test_packer_equals_a_search_over_its_open_bins():
    rng = random.Random(1)
    for limit in (1, 3, 50):
        p, open_bins, opened = Packer(100, limit), {}, 0
        for _ in range(600):
            size = rng.choice([1, 5, 37, 50, 63, 99, 100, rng.randint(1, 100)])
            number = p.place(size)
            fitting = [f for f in open_bins.values() if f >= size]
            if fitting:
                assert open_bins[number] == min(fitting)
                open_bins[number] -= size
            else:
                assert number == opened
                if len(open_bins) == limit:
                    fullest = min(open_bins.values())
                    closed = [b for b, f in open_bins.items() if f == fullest and not any(b in x for x in p.by_free.values())]
                    open_bins.pop(closed[0])
                open_bins[number] = 100 - size
                opened += 1
            if open_bins[number] == 0:
                del open_bins[number]
            assert sum(map(len, p.by_free.values())) == len(open_bins) <= limit


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(4)
    items = [(i, rng.choice([0, 1, 7, 90, 333, 256, 257, 5000, rng.randint(1, 300)]), "x") for i in range(800)] + [(1, 1, "x"), (None, 5, "x"), (900, None, "x"), (901, -3, "x")]
    df = spark.createDataFrame(items, "doc_id bigint, n bigint, bin string")
    targets = spark.createDataFrame([("tiny", 256), ("long", 4096), ("bad", 0), ("none", None)], "container string, capacity_tokens int")
    packed = pack(df, targets, "doc_id", "n", items_per_packer=300).cache()
    size = {}
    for i, n, _ in items:
        if i is not None and n and n > 0:
            size[i] = max(n, size.get(i, 0))
    for name, capacity in (("tiny", 256), ("long", 4096)):
        pieces, used = defaultdict(list), defaultdict(int)
        for r in packed.where(f"container = '{name}'").collect():
            pieces[r["item"]].append((r["piece"], r["size"]))
            used[r["packer"], r["bin"]] += r["size"]
        assert {i: sum(s for _, s in p) for i, p in pieces.items()} == size
        for i, p in pieces.items():
            assert [k for k, _ in sorted(p)] == list(range(-(-size[i] // capacity)))
        assert max(used.values()) <= capacity
    t = bins(packed).where("container = 'long'").groupBy().sum("unused", "capacity").first()
    assert t[0] / t[1] < 0.1
    assert pack(df.limit(0), targets, "doc_id", "n").count() == 0


def test_tokens_of_odd_texts(spark):
    texts = [(1, "Hello  world\n", "n"), (2, "", "n"), (3, None, "n"), (4, "日本語 <|endoftext|>", "n"), (5, "a" * 120_000, "n")]
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_token_counts(spark.createDataFrame(texts, "doc_id int, text string, other string"), "text").collect()}
    own = tokens.encoding(tokens.VOCABULARY, tokens.PATTERN)
    assert own.decode(own.encode_ordinary(texts[3][1])) == texts[3][1]
    assert (got[2], got[3]) == (0, 0) and got[1] == len(own.encode_ordinary(texts[0][1])) and got[5] > 1000


def test_vocabulary_is_a_setting(spark, tmp_path):
    import base64

    path = tmp_path / "bytes.tiktoken"
    path.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    df = spark.createDataFrame([(1, "häuser")], "doc_id int, text string")
    spark.conf.set(tokens.SETTING, str(path))
    try:
        assert tokens.with_token_counts(df, "text").first()["n_tokens"] == 7
    finally:
        spark.conf.unset(tokens.SETTING)


def leaf(source, weight, available, repeats=1, domain="d", language="en"):
    return {"source": source, "weight": weight, "available": available, "max_repeats": repeats, "domain": domain, "language": language}


def test_shortages_go_to_siblings_before_ancestors():
    # c, of another domain, keeps its share
    assert budgets([leaf("a", 1, 10), leaf("b", 1, 1000), leaf("c", 2, 1000, domain="e")], 400) == [10.0, 190.0, 200.0]
    assert budgets([leaf("a", 1, 10), leaf("b", 1, 50), leaf("c", 2, 1000, domain="e")], 400) == [10.0, 50.0, 340.0]
    assert budgets([leaf("a", 1, 10, 2), leaf("b", 0, 50)], 400) == [20.0, 0.0]
    # the language comes before the domain
    languages = [leaf("a", 1, 10), leaf("b", 1, 1000), leaf("a", 1, 1000, language="de"), leaf("c", 1, 1000, domain="e")]
    assert budgets(languages, 400) == [10.0, 190.0, 100.0, 100.0]


def test_feasible_total():
    assert budgets([leaf("a", 1, 10, 2), leaf("b", 3, 1000)], "feasible") == [20.0, 60.0]
    # the share of a source that is absent goes to its sibling
    assert budgets([leaf("a", 1, 0), leaf("b", 1, 100), leaf("c", 2, 1000, domain="e")], "feasible") == [0.0, 100.0, 100.0]
    assert budgets([leaf("a", 1, 0)], "feasible") == [0.0]
    assert budgets([leaf("a", 1, 10), leaf("b", 1, 30)], "all") == [10.0, 30.0]


def test_shares_are_met_at_the_feasible_total_and_causes_named(spark):
    rng = random.Random(3)
    items = [(i, rng.choice("aaaaaabbc"), rng.randint(1, 9), rng.choice(["en", "de", None])) for i in range(900)]
    df = spark.createDataFrame(items, "doc_id bigint, source string, n bigint, language string").selectExpr("*", "'k' AS domain")
    t = spark.createDataFrame([("m", "a", 1.0, 2, "k"), ("m", "b", 2.0, 2, "k"), ("m", "c", 1.0, 3, "k"), ("n", "a", 1.0, 1, "k"), ("n", "gone", 1.0, 1, "k"), ("n", "c", 0.0, 1, "k")], "mix string, source string, weight double, max_repeats int, domain string")
    args = dict(ident="doc_id", source="source", size="n", domain="domain", language="language")
    met = {(r["mix"], r["source"]): r for r in mix_sources(df, t, **args)[1].collect()}
    assert all(abs(met["m", s]["deviation"]) < 0.02 and met["m", s]["cause"] in ("met", "whole records") for s in "abc")
    assert (met["n", "gone"]["cause"], met["n", "a"]["cause"], met["n", "c"]["cause"]) == ("absent", "takes what others lack", "no weight")
    full = {(r["mix"], r["source"]): r for r in mix_sources(df, t, total="all", **args)[1].collect()}
    assert full["m", "b"]["cause"] == "repeats exhausted" and full["m", "a"]["cause"] == "takes what others lack"
    assert sum(r["deviation"] for (m, _), r in full.items() if m == "m") == pytest.approx(0)


@pytest.mark.parametrize("many", [True, False])
@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_mixture_meets_its_budgets(spark, monkeypatch, buckets, many):
    if many:  # no table is broadcast, and hot keys are salted
        monkeypatch.setattr("viewlake.operators.skew.BROADCAST_ROWS", 0)
        monkeypatch.setattr("viewlake.operators.skew.attach.__defaults__", (50,))
    rng = random.Random(9)
    items = [(i, rng.choice("aaabbc"), rng.randint(1, 40), "k", "en", "x") for i in range(600)] + [(5, "a", 1, "k", "en", "x"), (700, None, 5, "k", "en", "x"), (701, "a", None, "k", "en", "x"), (702, "unlisted", 9, "k", None, "x")]
    df = spark.createDataFrame(items, "doc_id bigint, source string, n bigint, domain string, language string, mix string")
    targets = [("m", "a", 1.0, 1), ("m", "b", 3.0, 4), ("m", "c", 2.0, 2), ("m", "gone", 1.0, 4), ("m", "a", 0.5, 1), ("n", "a", 1.0, None), ("n", "b", None, 3), ("n", "c", 1.0, 5)]
    t = spark.createDataFrame(targets, "mix string, source string, weight double, max_repeats int")
    args = dict(ident="doc_id", source="source", size="n", domain="domain", language="language", buckets=buckets, total="all")
    drawn, shares = mix_sources(df, t, **args)
    size = {}
    for i, s, n, *_ in items:
        if s and n:
            size[i] = max(n, size.get(i, 0))
    source = {i: max((n, s) for j, s, n, *_ in items if j == i and s and n)[1] for i in size}
    most = {("m", "a"): 1, ("m", "b"): 4, ("m", "c"): 2, ("n", "c"): 5}
    got, rows = defaultdict(int), drawn.collect()
    assert len({(r["mix"], r["doc_id"]) for r in rows}) == len(rows)
    for r in rows:
        assert r["source"] == source[r["doc_id"]] and r["size"] == size[r["doc_id"]]
        assert 1 <= r["repeats"] <= most[r["mix"], r["source"]]
        got[r["mix"], r["source"]] += r["size"] * r["repeats"]
    listed = shares.collect()
    assert len(listed) == 7
    for r in listed:
        assert r["drawn_size"] == got[r["mix"], r["source"]]
        assert abs(r["drawn_size"] - r["budget"]) <= 20.5, r
    assert sum(r["actual_share"] for r in listed if r["mix"] == "m") == pytest.approx(1)
    again = {(r["mix"], r["doc_id"], r["repeats"]) for r in mix_sources(df.repartition(7), t, **args)[0].collect()}
    assert again == {(r["mix"], r["doc_id"], r["repeats"]) for r in rows}


def test_nothing_to_mix(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, n bigint, domain string, language string")
    t = spark.createDataFrame([("m", "a", 1.0, 2)], "mix string, source string, weight double, max_repeats int")
    drawn, shares = mix_sources(df, t, ident="doc_id", source="source", size="n", domain="domain", language="language")
    assert drawn.count() == 0 and [r["budget"] for r in shares.collect()] == [0.0]
