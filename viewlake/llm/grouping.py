"""One group per set of records linked directly or indirectly.

The giant component is peeled first: a breadth-first search from the vertex with the
most links takes one join of the frontier with the links per round, and what it
reached is anti-joined away. With it go the hubs, so that the small components that
remain are labelled by spreading minima: each round connects every vertex's larger
neighbours, then its smaller ones, to the smallest vertex it knows. If the search
needs more rounds than allowed (a long chain), what was reached so far is contracted
to its smallest vertex and goes through the second phase with the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlake.functions.columns import parse_hash
from viewlake.operators.components import spread_minima
from viewlake.operators.skew import BROADCAST_ROWS, Salter
from viewlake.session import Scratch

SEARCH_ROUNDS = 12


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _both_ways(edges: DataFrame) -> DataFrame:
    e = edges.where(F.col("src") != F.col("dst"))
    return e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def _peel(scratch: Scratch, links: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """Vertices reached from the vertex with the most links, and whether all of its component was reached."""
    hub = links.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("id"))
    spark, rows = links.sparkSession, {"n": F.count(F.lit(1))}
    frontier, told = scratch.write_observed(hub, "reached/round=0", rows)
    seen = lambda: spark.read.schema("id long, round int").parquet(f"{scratch.base}/reached").select("id")
    for r in range(1, rounds + 1):
        if not told["n"]:
            break
        ahead = links.join(_small(frontier.select(F.col("id").alias("src")), told["n"]), "src").select(F.col("dst").alias("id")).distinct()
        frontier, told = scratch.write_observed(ahead.join(seen(), "id", "left_anti"), f"reached/round={r}", rows)
    return seen(), not told["n"]


def connected(scratch: Scratch, edges: DataFrame, search_rounds: int = SEARCH_ROUNDS) -> tuple[DataFrame, int | None]:
    """((id, label) of every vertex with a link to another, label of the peeled component).

    edges: src, dst (bigint, not null), repeated, reversed or self links allowed. The
    label is the smallest id of the component. No links give an empty table and None.
    """
    links = scratch.write(_both_ways(edges), "links")
    reached, whole = _peel(scratch, links, search_rounds)
    root = reached.agg(F.min("id")).first()[0]
    if root is None:
        return links.select(F.col("src").alias("id"), F.col("dst").alias("label")), None
    one_way = links.where(F.col("src") < F.col("dst"))
    if whole:
        rest = one_way.join(reached.select(F.col("id").alias("src")), "src", "left_anti")
    else:
        gone = reached.withColumn("hit", F.lit(True))
        rest = one_way
        for end in ("src", "dst"):
            rest = rest.join(gone.withColumnRenamed("id", end), end, "left")
            rest = rest.withColumn(end, F.when(F.col("hit"), F.lit(root)).otherwise(F.col(end))).drop("hit")
        rest = rest.where(F.col("src") != F.col("dst"))
    labels = scratch.write(spread_minima(scratch, rest), "labels")
    giant = root
    if not whole:
        found = labels.where(F.col("id") == root).first()
        giant = found["label"] if found else root
        labels = labels.join(reached, "id", "left_anti")
    return labels.unionByName(reached.select("id", F.lit(giant).cast("long").alias("label"))), giant


def link_paths(records: DataFrame, pairs: DataFrame, clusters: DataFrame, max_bits: int, rows_per_salt: int = 200_000) -> DataFrame:
    """(path, group_path) of every path of ``records`` that is linked to another one.

    records: path, perceptual_hash; of the hashes of a path the largest counts. pairs:
    left_path, right_path, linked if both have a hash and these differ in at most
    ``max_bits`` bits. clusters: representative, members; all paths that one row names
    are linked (through a vertex for the row, never pair by pair). Null paths, self
    pairs and paths without a record link nothing; repeated rows change nothing.
    """
    scratch = Scratch(records.sparkSession)
    two = F.col("left_path").isNotNull() & F.col("right_path").isNotNull() & (F.col("left_path") != F.col("right_path"))
    p = pairs.where(two).select(F.least("left_path", "right_path").alias("a"), F.greatest("left_path", "right_path").alias("b")).distinct()
    p = scratch.write(p, "pairs")
    named = F.array_compact(F.array_distinct(F.concat(F.array("representative"), F.coalesce("members", F.array().cast("array<string>")))))
    # the row number has its own projection, below the explode, else each exploded row would get another
    told = clusters.select("representative", "members").distinct().withColumn("row", F.monotonically_increasing_id())
    told = told.select("row", F.explode(named).alias("path"))
    told = scratch.write(told, "told")
    mentions = p.select(F.col("a").alias("path")).unionByName(p.select(F.col("b").alias("path"))).unionByName(told.select("path")).distinct()
    mentions, told_of = scratch.write_observed(mentions, "mentions", {"n": F.count(F.lit(1))})
    few = told_of["n"] <= BROADCAST_ROWS
    known = records.where(F.col("path").isNotNull()).select("path", parse_hash(F.col("perceptual_hash")).alias("h"))
    known = known.join(F.broadcast(mentions) if few else mentions, "path", "left_semi").groupBy("path").agg(F.max("h").alias("h"))
    # ids rise with the paths in byte order, so that the smallest id is the smallest path
    nodes = scratch.write(known.orderBy("path").withColumn("id", F.monotonically_increasing_id()), "nodes")

    end = lambda c: nodes.select(F.col("path").alias(c), F.col("id").alias(f"id_{c}"), F.col("h").alias(f"h_{c}")).where(F.col("h").isNotNull())
    close = F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b"))) <= max_bits
    alike = p
    for side, spread in (("a", "b"), ("b", "a")):
        salter = Salter(scratch, alike, [side], rows_per_salt, f"side_{side}")
        alike = salter.big(alike, [spread]).join(salter.other(end(side)), salter.join_keys).drop("_salt")
    alike = alike.where(close).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    # row vertices come after all paths, so that none is ever a smallest
    rows = told.join(nodes, "path").select((F.col("row") + F.lit(1 << 62)).alias("src"), F.col("id").alias("dst"))
    several = rows.groupBy("src").agg(F.min("dst").alias("a"), F.max("dst").alias("b")).where(F.col("a") != F.col("b")).select("src")
    labels, giant = connected(scratch, alike.unionByName(rows.join(several, "src", "left_semi")))
    groups = labels.where(F.col("id") < F.lit(1 << 62)).join(nodes.select("id", "path"), "id")
    first = nodes.select(F.col("id").alias("label"), F.col("path").alias("group_path"))
    if giant is None:
        return groups.join(first, "label").select("path", "group_path")
    # the giant group's name is one value; only the small groups need a join to get theirs
    name = first.where(F.col("label") == F.lit(giant)).first()["group_path"]
    rest = groups.where(F.col("label") != F.lit(giant)).join(first, "label").select("path", "group_path")
    return rest.unionByName(groups.where(F.col("label") == F.lit(giant)).select("path", F.lit(name).alias("group_path")))
