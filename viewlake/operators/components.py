"""Connected components by spreading minima.

Each round sends every link's larger end to the smallest parent its smaller end knows, then
joins the parents of a vertex to the smallest of them; the links become stars around the
smallest vertex of each component after a number of rounds that grows with the logarithm
of the longest path. In between, minima are spread inside of each partition, which
needs no shuffle and leaves a vertex one parent per partition at most. Rounds are
written to the shared folder, so none is computed twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlake.operators.skew import BROADCAST_ROWS, Salter
from viewlake.session import Scratch

#: Links that a task spreads minima over at a time.
CHUNK = 1_000_000
#: Links of a parent that one task joins.
ROWS_PER_SALT = 1_000_000


def local_minima(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links as stars: every vertex but the smallest of its component, and that smallest vertex."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(ids))
    return ids[own], ids[label[own]]


def _contracted(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            u, v = local_minima(table["u"].to_numpy(), table["v"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield stars()
                size = 0
        if size:
            yield stars()

    return links.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def spread_minima(scratch: Scratch, links: DataFrame, name: str = "star") -> DataFrame:
    """(id, label) for every vertex of links (src, dst), label being the smallest id of its component.

    Ids are bigint and not null; repeated and reversed links are allowed, self links
    must be left out. No links give no rows.
    """
    mark = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, before = scratch.write_observed(_contracted(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))), f"{name}_0", mark)
    r = 0
    while before["n"]:
        # no table of a round has more rows than it has links
        few = before["n"] <= BROADCAST_ROWS
        parents = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        if few:
            large = edges.join(F.broadcast(parents), "v", "left")
        else:
            salter = Salter(scratch, edges, ["v"], ROWS_PER_SALT, f"{name}_{r}")
            large = salter.big(edges, ["u"]).join(salter.other(parents), salter.join_keys, "left")
        large = large.select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(F.broadcast(low) if few else low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        r += 1
        edges, after = scratch.write_observed(_contracted(small), f"{name}_{r}", mark)
        scratch.drop(f"{name}_{r - 1}")
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots.select("id", F.col("id").alias("label")))
