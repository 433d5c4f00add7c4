"""Drawing records from several sources so that each has its share of the total size.

Budgets come from a tree of domain, language and source. A source that writes in several
languages has a leaf in each, and its weight is split over them by size. Weights are
summed up the tree, the total is passed down it, and what a leaf or subtree cannot take (a source
gives at most max_repeats times its size) goes to its siblings first and only then,
through its parent, to the parent's siblings. A leaf's budget is drawn from seeded
epochs: whole epochs first, then the prefix of one more epoch in the order of a seeded
hash. Only the records of the hash bucket in which the budget ends are put in order.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewlake.operators.skew import attach
from viewlake.session import Scratch

#: Leaves (source, domain, language) that the driver may hold, over all mixes; more are an error.
MOST_LEAVES = 100_000
#: Hash buckets per leaf; the bucket in which a budget ends is the only one put in order.
BUCKETS = 4096
#: Relative difference of budgets that counts as none, and of a drawn size from its budget that is told.
SLACK, COARSE = 1e-9, 0.01


@dataclass(eq=False)
class Node:
    weight: float = 0.0
    room: float = 0.0
    children: dict[str, "Node"] = field(default_factory=dict)
    budget: float = 0.0


def share_out(node: Node, budget: float) -> None:
    """Give ``budget`` (at most node.room) to the leaves under ``node``: by weight, what one child can't take to its siblings."""
    node.budget = budget
    free = sorted((c for c in node.children.values() if c.weight > 0 and c.room > 0), key=lambda c: c.room / c.weight)
    left, weight = budget, sum(c.weight for c in free)
    for i, c in enumerate(free):
        # those with the least room for their weight come first; once one isn't filled, none of the rest is
        if left * c.weight < c.room * weight:
            for rest in free[i:]:
                share_out(rest, left * rest.weight / weight)
            return
        share_out(c, c.room)
        left, weight = max(left - c.room, 0.0), weight - c.weight


def _tree(leaves: list[dict], room) -> tuple[Node, list[Node]]:
    root, ends = Node(), []
    for x in leaves:
        path = root
        for name in (None, x["domain"], x["language"], x["source"]):
            path = path if name is None else path.children.setdefault(name, Node())
            path.weight, path.room = path.weight + x["weight"], path.room + (room(x) if x["weight"] > 0 else 0.0)
        ends.append(path)
    return root, ends


def budgets(leaves: list[dict], total: float | str) -> list[float]:
    """Budget of each leaf (domain, language, source, weight, available, max_repeats). total: a size, 'all' or 'feasible'."""
    own_room = lambda x: float(x["available"] * x["max_repeats"])
    if total == "feasible":
        # shares when sources that are there never run out; then the largest total at which none does
        root, ends = _tree(leaves, lambda x: 1.0 if own_room(x) else 0.0)
        share_out(root, min(1.0, root.room))
        wanted = min((own_room(x) / e.budget for x, e in zip(leaves, ends) if e.budget > 0), default=0.0)
    else:
        wanted = float(sum(x["available"] for x in leaves)) if total == "all" else float(total)
    root, ends = _tree(leaves, own_room)
    share_out(root, min(wanted, root.room))
    return [e.budget for e in ends]


def order_key(seed: int, mix: Column, epoch: Column, ident: Column) -> Column:
    """Place of a record in an epoch of a mix: a seeded hash, from 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), mix, epoch, ident), 2)


def _cause(share: float, available: int, budget: float, whole: float) -> str:
    if share <= 0:
        return "no weight"
    if not available:
        return "absent"
    apart = budget - share * whole
    if abs(apart) <= SLACK * max(whole, 1.0):
        return "met"
    return "repeats exhausted" if apart < 0 else "takes what others lack"


def mix_sources(
    items: DataFrame, targets: DataFrame, *, ident: str, source: str, size: str, domain: str, language: str,
    total: float | str = "feasible", seed: int = 1, buckets: int = BUCKETS,
) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares).

    items: one row per record with its size (null or non-positive sizes are never drawn;
    repeated ids count once, with their largest size), source, domain and
    language (null counts as ''). targets: mix, source, weight, max_repeats and perhaps domain (of sources
    without records); null or non-positive weights or repeats get nothing; of repeated
    targets the largest weight counts. total: size of each mix; 'feasible' is the
    largest at which every source that is there keeps its share (that of absent sources
    goes to their siblings), 'all' one time all records of the mix's sources, which small sources can't keep up with.

    drawn: mix, source, id, size, repeats (>= 1). shares: mix, source, weight_share,
    available, budget, drawn_size, records, actual_share, deviation, cause, for every target; cause:
    met, whole records (met but for the size of single records), absent, repeats exhausted, takes what others lack, no weight. A leaf's last record is taken if at least half of it
    fits, so drawn_size is within half a record per language of the budget. No target or no record gives no rows drawn.
    """
    scratch, spark = Scratch(items.sparkSession), items.sparkSession
    place = F.max(F.coalesce(F.col(domain), F.lit(""))) if domain in targets.columns else F.lit("")
    goal = targets.where(F.col("mix").isNotNull() & F.col("source").isNotNull()).groupBy("mix", "source").agg(
        F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"), place.alias("domain")
    )
    goal_rows = goal.limit(MOST_LEAVES + 1).collect()
    if len(goal_rows) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} targets")
    sources = sorted({r["source"] for r in goal_rows})
    names = spark.createDataFrame([(s,) for s in sources], "source string")

    base = items.where(F.col(ident).isNotNull() & (F.col(size) > 0)).select(
        F.col(ident).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"),
        F.coalesce(F.col(domain), F.lit("")).alias("domain"), F.coalesce(F.col(language), F.lit("")).alias("language"),
    )
    base = attach(scratch, base, names, ["source"], len(sources), ["id"])
    one = base.groupBy("id").agg(F.max(F.struct("size", "source", "domain", "language")).alias("r")).select("id", "r.*")
    one = scratch.write(one, "items")

    # sums per leaf come first; they are as few as sources and their languages, however many records there are
    stock = one.groupBy("source", "domain", "language").agg(F.sum("size").alias("size")).limit(MOST_LEAVES + 1).collect()
    if len(stock) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} places of sources")
    places, available = defaultdict(list), defaultdict(int)
    for r in sorted(stock, key=lambda r: (r["source"], r["domain"], r["language"])):
        places[r["source"]].append(r)
        available[r["source"]] += int(r["size"])
    by_mix = defaultdict(list)
    for r in sorted(goal_rows, key=lambda r: (r["mix"], r["source"])):
        by_mix[r["mix"]].append(r)
    plan, told = [], []
    for mix, goals in by_mix.items():
        leaves = []
        for r in goals:
            weight, most = (float(r["weight"]), int(r["max_repeats"])) if r["weight"] > 0 and r["max_repeats"] > 0 else (0.0, 0)
            there = places.get(r["source"])
            own = {"source": r["source"], "max_repeats": most}
            if there:
                leaves += [own | {"domain": p["domain"], "language": p["language"], "available": int(p["size"]), "weight": weight * int(p["size"]) / available[r["source"]]} for p in there]
            else:
                leaves.append(own | {"domain": r["domain"], "language": "", "available": 0, "weight": weight})
        given, shares = budgets(leaves, total), defaultdict(lambda: [0.0, 0.0])
        for x, budget in zip(leaves, given):
            shares[x["source"]][0] += x["weight"]
            shares[x["source"]][1] += budget
            if budget > 0:
                full = min(int(budget // x["available"]), x["max_repeats"])
                plan.append((len(plan), mix, x["source"], x["domain"], x["language"], full, budget - full * x["available"] if full < x["max_repeats"] else 0.0))
        whole, weights = sum(given), sum(w for w, _ in shares.values()) or 1.0
        told += [(mix, s, w / weights, available[s], b, _cause(w / weights, available[s], b, whole)) for s, (w, b) in shares.items()]
    leaf = spark.createDataFrame(plan, "leaf int, mix string, source string, domain string, language string, full int, part double")

    rows = attach(scratch, one, leaf, ["source", "domain", "language"], len(plan), ["id"])
    rows = rows.withColumn("key", order_key(seed, F.col("mix"), F.col("full"), F.col("id")))
    rows = rows.withColumn("bucket", F.floor(F.col("key") / F.lit((1 << 62) / buckets)).cast("int"))
    filled = rows.groupBy("leaf", "part", "bucket").agg(F.sum("size").alias("size"))
    along = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    # a part is less than its leaf holds, so every leaf has a bucket in which it ends; what the buckets before hold goes with it
    reached = filled.withColumn("upto", F.sum("size").over(along)).where(F.col("upto") > F.col("part"))
    ends = reached.groupBy("leaf").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"))).alias("e"))
    ends = scratch.write(ends.select("leaf", F.col("e.bucket").alias("last"), F.col("e.before").alias("before")), "ends")
    rows = attach(scratch, rows, ends, ["leaf"], len(plan), ["id"])
    inside = F.col("bucket") == F.col("last")
    within = Window.partitionBy("leaf", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    ending = rows.where(inside).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    ending = ending.withColumn("more", (F.col("ahead") + F.col("size") / 2 <= F.col("part")).cast("int")).drop("ahead")
    others = rows.where(~inside).withColumn("more", (F.col("bucket") < F.col("last")).cast("int"))
    drawn = ending.unionByName(others).withColumn("repeats", F.col("full") + F.col("more")).where(F.col("repeats") > 0)
    drawn = scratch.write(drawn.select("mix", "source", F.col("id").alias(ident), "size", "repeats"), "drawn")

    got = drawn.groupBy("mix", "source").agg(F.sum(F.col("size") * F.col("repeats")).alias("drawn_size"), F.count(F.lit(1)).alias("records"))
    whole = drawn.groupBy("mix").agg(F.sum(F.col("size") * F.col("repeats")).alias("mix_size"))
    shares = spark.createDataFrame(told, "mix string, source string, weight_share double, available bigint, budget double, cause string")
    shares = shares.join(got, ["mix", "source"], "left").join(whole, "mix", "left")
    actual = F.coalesce("drawn_size", F.lit(0)) / F.coalesce("mix_size", F.lit(1))
    coarse = (F.col("cause") == "met") & (F.abs(F.coalesce("drawn_size", F.lit(0)) - F.col("budget")) > COARSE * F.col("budget"))
    return drawn, shares.select(
        "mix", "source", "weight_share", "available", "budget", F.coalesce("drawn_size", F.lit(0)).alias("drawn_size"), F.coalesce("records", F.lit(0)).alias("records"),
        actual.alias("actual_share"), (actual - F.col("weight_share")).alias("deviation"),
        F.when(coarse, "whole records").otherwise(F.col("cause")).alias("cause"),
    )
