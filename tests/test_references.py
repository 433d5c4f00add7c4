import datetime as dt

import pytest
from pyspark.sql import functions as F

from viewlake.operators.references import find_orphans, plain_name

T = lambda d: dt.datetime(2025, 1, d, tzinfo=dt.timezone.utc)


def run(spark, refs, parts, semantics="simple", rows_per_salt=200_000):
    r = spark.createDataFrame(refs, "id int, a int, b string, t timestamp, extra string")
    p = spark.createDataFrame(parts, "a int, b string, since timestamp, until timestamp, extra string, id int")
    out = find_orphans(r, p, ["a", "b"], ref_time="t", valid_from="since", valid_to="until", id_cols=["id"], semantics=semantics, rows_per_salt=rows_per_salt)
    return sorted((x["id"], x["reason"]) for x in out.collect())


PARTS = [
    (1, "x", T(5), T(10), "e", 0), (1, "x", T(5), T(10), "e", 0), (1, "x", T(20), None, "e", 0), (2, "y", T(1), T(3), "e", 0), (3, "z", None, None, "e", 0),
    (None, "x", T(1), None, "e", 0), (4, None, T(1), None, "e", 0),
]
REFS = [
    (1, 1, "x", T(5), "c"), (2, 1, "x", T(10), "c"), (3, 1, "x", T(4), "c"), (4, 1, "x", T(25), "c"), (5, 2, "y", T(3), "c"), (6, 2, "y", T(2), "c"), (7, 9, "x", T(2), "c"),
    (8, None, "x", T(2), "c"), (9, 4, None, T(2), "c"), (10, None, None, T(2), "c"), (11, 3, "z", T(9), "c"), (12, 1, "x", None, "c"), (7, 9, "x", T(2), "c"),
]
WHOLE = [(2, "late"), (3, "late"), (5, "deleted"), (7, "missing"), (11, "deleted"), (12, "deleted")]


@pytest.mark.parametrize("salt", [200_000, 2])
def test_simple_semantics(spark, salt):
    assert run(spark, REFS, PARTS, rows_per_salt=salt) == WHOLE


def test_full_semantics(spark):
    assert run(spark, REFS, PARTS, "full") == sorted(WHOLE + [(8, "partial_null"), (9, "partial_null")])


def test_partial_semantics_match_on_what_is_there(spark):
    # 8 matches any partner with b = x at that time (the one without a); 9 the partner with a = 4
    assert run(spark, REFS, PARTS, "partial") == WHOLE
    assert run(spark, [(1, None, "q", T(1), "c"), (2, 77, None, T(1), "c")], PARTS, "partial") == [(1, "missing"), (2, "missing")]


def test_empty_tables(spark):
    assert run(spark, [], PARTS) == []
    assert run(spark, REFS[:1], []) == [(1, "missing")]


def test_unknown_semantics(spark):
    with pytest.raises(ValueError):
        run(spark, REFS, PARTS, "some")


def test_plain_name(spark):
    names = [".\\A\\b.JPG ", "a/b.jpg", "./a/b.jpg", "\ta/B.jpg", "././a/b.jpg", None, " "]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(plain_name(F.col("n")).alias("p"))
    assert [r["p"] for r in df.collect()] == ["a/b.jpg"] * 4 + ["./a/b.jpg", None, ""]
