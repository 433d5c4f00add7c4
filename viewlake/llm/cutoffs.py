"""Score cutoffs that keep a target fraction per group: sketch-bracketed exact selection.

A sketch with guaranteed rank bounds brackets the cutoff of each group. Scores above
the bracket and at its two ends are only counted; if that doesn't decide, the cutoff lies
strictly inside, where only a small share of the records is, however many are tied at the ends. These alone are
put in order. If some group has too many even there, a sketch of them is the next bracket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewlake.llm.quantiles import BUFFER, merge, rank_bounds, sketch
from viewlake.operators.skew import attach
from viewlake.session import Scratch

#: Records of one group that one task may put in order.
BRACKET_ROWS = 2_000_000


def exact_cutoffs(scores: DataFrame, targets: DataFrame, group: str, score: str, *, default_permille: int, k: int = BUFFER, bracket_rows: int = BRACKET_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """(group, n, keep_permille, cutoff, kept): the largest score that keeps the target.

    scores: one row per record, score not null and finite. targets: (group,
    keep_permille); of several rows of a group the largest counts, a null counts as none.
    The cutoff is the largest score s with 1000 * count(score >= s) >= keep_permille * n;
    ties at the cutoff are all kept. Above 1000 permille there is none (null, 0 kept).
    """
    scratch = scratch or Scratch(scores.sparkSession)
    # the hash spreads the rows of a hot group; it is computed only where groups are too many to be broadcast
    rows = scores.select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.xxhash64(*scores.columns).alias("h"))
    wanted = targets.where(F.col("keep_permille").isNotNull()).groupBy(F.col(group).alias("g")).agg(F.max("keep_permille").cast("long").alias("permille"))
    infinite = F.lit(float("inf"))
    inside, state, groups, turn, before = rows, None, 0, 0, None
    while True:
        # one sketch of the records inside each bracket; the first brackets are unbounded
        part = merge(sketch(inside.select("g", "s"), ["g"], "s", k), ["g"], k, scratch=scratch)
        if state is None:
            part = part.join(wanted, "g", "left").withColumn("permille", F.coalesce("permille", F.lit(default_permille).cast("long")))
            part = part.withColumns({
                "whole": F.col("n"), "need": F.greatest(F.lit(1).cast("long"), F.expr("(permille * n + 999) div 1000")), "above": F.lit(0).cast("long"), "lo": -infinite, "hi": infinite,
            })
        else:
            part = part.join(state, "g")
        goals = ["g", "whole", "permille", "need", "above"]
        part = scratch.write(part.withColumn("rank", F.col("n") - F.col("need") + F.col("above") + 1), f"sketch_{turn}")
        if not turn:
            settled = part.where("need > n").select(*goals[:3], F.lit(None).cast("double").alias("cutoff"), F.lit(0).cast("long").alias("kept"))
            part = part.where("need <= n")
        bounds = rank_bounds(part, ["g"], "rank").withColumnsRenamed({"lo": "low", "hi": "high"})
        state = scratch.write(part.select(*goals, "lo", "hi").join(bounds, "g"), f"bracket_{turn}")
        groups = state.count()
        within = attach(scratch, rows, state, ["g"], groups, ["h"]).where((F.col("s") > F.col("lo")) & (F.col("s") < F.col("hi")))
        one = lambda c: F.count(F.when(c, 1))
        tally = within.groupBy("g").agg(
            one(F.col("s") > F.col("high")).alias("over"), one(F.col("s") == F.col("high")).alias("top"),
            one((F.col("s") > F.col("low")) & (F.col("s") < F.col("high"))).alias("middle"), one((F.col("s") == F.col("low")) & (F.col("low") < F.col("high"))).alias("bottom"),
        )
        to_top = F.col("above") + F.col("over") + F.col("top")
        to_middle = to_top + F.col("middle")
        tally = scratch.write(state.join(tally, "g").withColumns({"to_top": to_top, "to_middle": to_middle}), f"tally_{turn}")
        ends = tally.where("to_top >= need OR to_middle < need").select(
            *goals[:3], F.when(F.col("to_top") >= F.col("need"), F.col("high")).otherwise(F.col("low")).alias("cutoff"),
            F.when(F.col("to_top") >= F.col("need"), F.col("to_top")).otherwise(F.col("to_middle") + F.col("bottom")).alias("kept"),
        )
        settled = settled.unionByName(ends)
        left = tally.where("to_top < need AND to_middle >= need")
        most = left.agg(F.max("middle")).first()[0] or 0
        state = left.select(*goals[:4], F.col("to_top").alias("above"), F.col("low").alias("lo"), F.col("high").alias("hi"))
        inside = attach(scratch, rows, state, ["g"], groups, ["h"]).where((F.col("s") > F.col("lo")) & (F.col("s") < F.col("hi")))
        if most <= bracket_rows:
            break
        if before is not None and most > before / 2:
            k *= 2  # too coarse a sketch to get on
        turn, before = turn + 1, most
    counted = inside.groupBy("g", "s", "whole", "permille", "need", "above").agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("g").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    reached = counted.withColumn("kept", F.col("above") + F.sum("c").over(down)).where(F.col("kept") >= F.col("need"))
    best = reached.groupBy("g", "whole", "permille").agg(F.max(F.struct("s", "kept")).alias("b"))
    out = settled.unionByName(best.select("g", "whole", "permille", F.col("b.s").alias("cutoff"), F.col("b.kept").alias("kept")))
    return out.select(F.col("g").alias(group), F.col("whole").alias("n"), F.col("permille").cast("int").alias("keep_permille"), "cutoff", "kept")


def keep_above(scores: DataFrame, cutoffs: DataFrame, group: str, score: str) -> DataFrame:
    """Rows of ``scores`` at or above the cutoff of their group."""
    scratch = Scratch(scores.sparkSession)
    cut = scratch.write(cutoffs.select(group, "cutoff").where(F.col("cutoff").isNotNull()), "cutoffs")
    joined = attach(scratch, scores, cut, [group], cut.count(), [c for c in scores.columns if c != group])
    return joined.where(F.col(score) >= F.col("cutoff")).drop("cutoff")
