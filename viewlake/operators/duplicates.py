"""Duplicate images within a collection, by the distance of 64-bit hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlake.functions.columns import hamming
from viewlake.operators.components import spread_minima
from viewlake.operators.skew import Salter
from viewlake.session import Scratch

#: Most bands in a key of the join by distance, and most keys of a row.
MOST_AGREEING, MOST_KEYS = 3, 300
#: Cost of shuffling a key, in candidate pairs compared (measured).
KEY_COST = 20


def _bands(n: int) -> list[tuple[int, int]]:
    """(shift, mask) of n disjoint bands of the 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _band(h: Column, shift: int, mask: int) -> Column:
    value = F.shiftrightunsigned(h, shift)
    return value.bitwiseAND(F.lit(mask)) if mask < (1 << 63) else value


def bands_to_agree(distance: int, rows: int, most: int = MOST_AGREEING) -> int:
    """Number r of bands that join keys are made of: of distance + r bands, hashes within the distance agree on r at least.

    More bands in a key mean more keys per row, but far fewer candidates; the choice for the
    largest group of ``rows`` hashes is the one with the least of both together. The result is the same for every r.
    """
    def cost(r: int) -> float:
        keys = math.comb(distance + r, r)
        return keys * rows * (KEY_COST + rows / 2 ** (1 + 64 * r / (distance + r)))

    return min((r for r in range(1, most + 1) if r == 1 or math.comb(distance + r, r) <= MOST_KEYS), key=cost)


def hamming_join(scratch: Scratch, hashes: DataFrame, groups: list[str], distance: int, rows_per_salt: int = 20_000, agreeing: int | None = None) -> DataFrame:
    """(groups, h_a, h_b, bits) of hashes of one group at most ``distance`` (0 to 31) bits apart, h_a < h_b, each pair once.

    hashes: the group columns and h (bigint), each once; copies are collapsed before. An
    equi-join on bands, exact by the pigeonhole principle; a pair that agrees on more
    bands than needed is taken at the first ones only, so no distinct is needed. Hot band values
    are spread over tasks. Null hashes join nothing. ``agreeing``: bands in a key, by default as the largest group asks for.
    """
    hashes = hashes.where(F.col("h").isNotNull())
    if agreeing is None:
        most = hashes.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        agreeing = bands_to_agree(distance, most)
    bands, h = _bands(distance + agreeing), F.col("h")
    keys = []
    for chosen in combinations(range(len(bands)), agreeing):
        value, at = F.lit(0).cast("bigint"), 0
        for i in chosen:
            value = value.bitwiseXOR(F.shiftleft(_band(h, *bands[i]), at))
            at += bands[i][1].bit_length()
        keys.append(F.struct(F.lit(sum(1 << i for i in chosen)).cast("bigint").alias("bands"), F.lit((2 << chosen[-1]) - 1).cast("bigint").alias("upto"), value.alias("value")))
    rows = hashes.select(*groups, "h", F.explode(F.array(*keys)).alias("p")).select(*groups, "h", "p.bands", "p.upto", "p.value")
    join = [*groups, "bands", "value"]
    salter = Salter(scratch, rows, join, rows_per_salt, "bands")
    left = salter.big(rows, ["h"]).withColumnRenamed("h", "h_a")
    right = salter.other(rows.drop("upto").withColumnRenamed("h", "h_b"))
    x = F.col("h_a").bitwiseXOR(F.col("h_b"))
    agree = F.lit(0).cast("bigint")
    for i, band in enumerate(bands):
        agree = agree.bitwiseOR(F.when(_band(x, *band) == 0, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    first = agree.bitwiseAND(F.col("upto")) == F.col("bands")
    met = left.join(right, salter.join_keys).where((F.col("h_a") < F.col("h_b")) & (hamming(F.col("h_a"), F.col("h_b")) <= distance) & first)
    return met.select(*groups, "h_a", "h_b", hamming(F.col("h_a"), F.col("h_b")).alias("bits"))


def duplicate_members(records: DataFrame, group: str, ident: str, distance: int) -> DataFrame:
    """(group, ident, h, cluster): records that have a duplicate, cluster being the smallest ident of theirs.

    records: group, ident (bigint, unique) and h. Records of one hash are one vertex,
    linked to other hashes of the group within the distance; clusters are transitive.
    Null groups, idents or hashes are left out.
    """
    scratch = Scratch(records.sparkSession)
    rows = records.select(F.col(group).alias("g"), F.col(ident).alias("i"), "h").where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("h").isNotNull())
    rows = scratch.write(rows, "rows")
    classes = scratch.write(rows.groupBy("g", "h").agg(F.min("i").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    pairs = hamming_join(scratch, classes.select("g", "h"), ["g"], distance)
    ends = lambda c, to: classes.select("g", F.col("h").alias(c), F.col("id").alias(to))
    links = pairs.join(ends("h_a", "src"), ["g", "h_a"]).join(ends("h_b", "dst"), ["g", "h_b"]).select("src", "dst")
    labels = scratch.write(spread_minima(scratch, links), "labels")
    placed = classes.join(labels, "id", "left").where(F.col("label").isNotNull() | (F.col("n") > 1))
    placed = placed.select("g", "h", F.coalesce("label", "id").alias("cluster"))
    return rows.join(placed, ["g", "h"]).select(F.col("g").alias(group), F.col("i").alias(ident), "h", "cluster")


def cluster_stats(members: DataFrame, group: str) -> DataFrame:
    """(group, cluster, members, average_distance, exact) over all pairs of each cluster.

    Pairs aren't formed: where c of n hashes have a bit set, c * (n - c) pairs differ in it.
    """
    ones = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"c{b}") for b in range(64)]
    t = members.groupBy(group, "cluster").agg(F.count(F.lit(1)).alias("n"), *ones)
    n = F.col("n")
    apart = F.lit(0).cast("bigint")
    for b in range(64):
        apart = apart + F.col(f"c{b}") * (n - F.col(f"c{b}"))
    t = t.select(group, "cluster", n.alias("members"), apart.alias("apart"))
    pairs = F.col("members") * (F.col("members") - 1) / 2
    return t.select(group, "cluster", "members", (F.col("apart") / pairs).alias("average_distance"), (F.col("apart") == 0).alias("exact"))


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Merging links (a < b) in the order of a, trees of b going under the root of a: which links joined two trees, and the root of the last join."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    tree, root = np.arange(len(ids)), np.arange(len(ids))

    def find(x: int) -> int:
        while tree[x] != x:
            tree[x] = tree[tree[x]]
            x = tree[x]
        return x

    joined, last = np.zeros(len(a), bool), 0
    for k in np.argsort(a, kind="stable"):
        x, y = find(at[k]), find(at[len(a) + k])
        if x != y:
            # the larger index hangs under the smaller, whichever of them has the root of the merge
            low, high = min(x, y), max(x, y)
            tree[high], root[low] = low, root[x]
            joined[k], last = True, low
    return joined, int(ids[root[last]])


def representatives(members: DataFrame, group: str, ident: str, distance: int) -> DataFrame:
    """(group, cluster, representative): the root that merging links in the order of idents ends with.

    In order, each record takes the trees of all later records within the distance under
    the root of its own tree. Copies of a hash follow its first record and are left out. Each partition
    first drops links that close a circle of earlier ones, which changes no merge, so that one task per
    cluster gets about as many links as the cluster has different hashes.
    """
    scratch = Scratch(members.sparkSession)
    kind = members.schema[group].dataType.simpleString()
    firsts = scratch.write(members.groupBy(F.col(group).alias("g"), "cluster", "h").agg(F.min(ident).cast("long").alias("i")), "firsts")
    pairs = hamming_join(scratch, firsts.select("g", "cluster", "h"), ["g", "cluster"], distance)
    ends = lambda h, to: firsts.select("g", "cluster", F.col("h").alias(h), F.col("i").alias(to))
    links = pairs.join(ends("h_a", "x"), ["g", "cluster", "h_a"]).join(ends("h_b", "y"), ["g", "cluster", "h_b"])
    links = links.select("g", "cluster", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # idents are unique, so links of different clusters never meet
                yield batch.filter(pa.array(_roots(batch.column(2).to_numpy(), batch.column(3).to_numpy())[0]))

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [key[0]], "cluster": [key[1]], "representative": [_roots(rows["a"].to_numpy(), rows["b"].to_numpy())[1]]})

    slim = links.mapInArrow(forest, f"g {kind}, cluster bigint, a bigint, b bigint")
    found = slim.groupBy("g", "cluster").applyInPandas(fold, f"g {kind}, cluster bigint, representative bigint")
    # a cluster of one hash has no links
    first = firsts.groupBy("g", "cluster").agg(F.min("i").alias("first"))
    out = first.join(found, ["g", "cluster"], "left")
    return out.select(F.col("g").alias(group), "cluster", F.coalesce("representative", "first").alias("representative"))
