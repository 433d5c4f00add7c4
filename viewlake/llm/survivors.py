"""The surviving record of each duplicate group, and the source of each field.

Recency is a currency order. Records with a timestamp are ordered by it. For records
without one it is reasoned from values: from all timestamped rows the operator learns
which value of an attribute is followed by which (per entity, in time), keeps the
direction seen more often and closes it transitively; values on a cycle count as the
same. An undated record gets the time of the latest dated record of its group whose value
is the same or comes before its own. It is more current than the dated
ones of that time if a value strictly precedes its own and none follows it; else it is
placed behind them. Among undated records the value with more values before it wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewlake.operators.skew import Salter
from viewlake.session import Scratch

def blank(text: Column) -> Column:
    return text.isNull() | (F.btrim(text, F.lit(" \t")) == "")


def _long(df: DataFrame, keep: list[str], attributes: list[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes))
    rows = df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.attribute", "p.value")
    return rows.where(~blank(F.col("value")))


def learn_precedence(rows: DataFrame, entity: str, timestamp: str, attributes: list[str]) -> DataFrame:
    """(attribute, earlier, later, seen): value transitions, in the direction seen more often.

    Per entity and attribute, each value has a first and a last time; a value whose
    last time is before the first time of the next value is followed by it. Rows are
    reduced to one per entity and value before they are put in order, so an entity with
    very many rows is no large group. Null or blank values and null times teach nothing.
    """
    long = _long(rows.where(F.col(timestamp).isNotNull() & F.col(entity).isNotNull()), [entity, timestamp], attributes)
    spans = long.groupBy(entity, "attribute", "value").agg(F.min(timestamp).alias("first"), F.max(timestamp).alias("last"))
    w = Window.partitionBy(entity, "attribute").orderBy("first", "last", "value")
    steps = spans.withColumn("prev", F.lag(F.struct("value", "last")).over(w)).where(F.col("prev.last") < F.col("first"))
    seen = steps.groupBy("attribute", F.col("prev.value").alias("earlier"), F.col("value").alias("later")).agg(F.count(F.lit(1)).alias("seen"))
    back = seen.select("attribute", F.col("earlier").alias("later"), F.col("later").alias("earlier"), F.col("seen").alias("reverse"))
    both = seen.join(back, ["attribute", "earlier", "later"], "left")
    return both.where(F.col("seen") > F.coalesce("reverse", F.lit(0))).select("attribute", "earlier", "later", "seen")


def value_order(scratch: Scratch, precedence: DataFrame, values: DataFrame) -> DataFrame:
    """(attribute, value, other, side): how all other values stand to the given (attribute, value), by chains of precedence of any length.

    side: ``before`` or ``later``, or ``same`` where chains lead both ways, so that both are on a cycle.
    """
    up = precedence.select("attribute", F.col("earlier").alias("at"), F.col("later").alias("other"), F.lit(True).alias("up"))
    down = precedence.select("attribute", F.col("later").alias("at"), F.col("earlier").alias("other"), F.lit(False).alias("up"))
    edges = scratch.write(up.unionByName(down), "edges")
    newest = values.distinct().select("attribute", "value", F.col("value").alias("at"), F.explode(F.array(F.lit(True), F.lit(False))).alias("up"))
    reached, step = None, 0
    while True:
        found = newest.join(edges, ["attribute", "at", "up"]).select("attribute", "value", "other", "up").where("other <> value").distinct()
        found = found if reached is None else found.join(reached, ["attribute", "value", "other", "up"], "left_anti")
        found = scratch.write(found, f"found_{step}")
        if found.isEmpty():
            break
        reached = found if reached is None else reached.unionByName(found)
        newest = found.withColumnRenamed("other", "at")
        step += 1
        if step % 8 == 0:
            reached = scratch.write(reached.coalesce(max(1, reached.rdd.getNumPartitions() // 8)), f"reached_{step}")
    reached = found if reached is None else reached
    sides = reached.groupBy("attribute", "value", "other").agg(F.min("up").alias("down_too"), F.max("up").alias("up"))
    side = F.when(F.col("up") & ~F.col("down_too"), "same").when(F.col("up"), "later").otherwise("before")
    return scratch.write(sides.select("attribute", "value", "other", side.alias("side")), "value_order")


def _levels(order: DataFrame) -> DataFrame:
    """(attribute, value, level): number of values strictly before; it grows along every chain."""
    return order.where("side = 'before'").groupBy("attribute", "value").agg(F.count(F.lit(1)).cast("int").alias("level"))


def topological_levels(scratch: Scratch, precedence: DataFrame) -> DataFrame:
    """(attribute, value, level) of all values that others precede; on a cycle all have one level."""
    return _levels(value_order(scratch, precedence, precedence.select("attribute", F.col("later").alias("value"))))


def _place_undated(scratch: Scratch, undated: DataFrame, dated: DataFrame, precedence: DataFrame, attributes: list[str]) -> DataFrame:
    """(grp, rid, cur, after, level) of undated candidates; dated: grp, ts and the attributes of the groups in question.

    after: whether a dated record of time cur has a value strictly before, and none of that time one strictly later.
    """
    u = scratch.write(_long(undated, ["grp", "rid"], attributes).distinct(), "undated_values")
    d = scratch.write(_long(dated, ["grp", "ts"], attributes).distinct(), "dated_values")
    order = value_order(scratch, scratch.write(precedence, "precedence"), u.select("attribute", "value"))
    placed = u.join(order, ["attribute", "value"]).select("grp", "rid", "attribute", F.col("other").alias("value"), "side")
    near = u.withColumn("side", F.lit("same")).unionByName(placed.where("side <> 'later'"))
    last = d.groupBy("grp", "attribute", "value").agg(F.max("ts").alias("ts"))
    times = near.join(last, ["grp", "attribute", "value"]).groupBy("grp", "rid").agg(F.max(F.struct("ts", (F.col("side") == "before").alias("after"))).alias("t"))
    times = scratch.write(times.select("grp", "rid", F.col("t.ts").alias("cur"), F.col("t.after").alias("after")), "times")
    follow = placed.where("side = 'later'").join(times.where("after").select("grp", "rid", F.col("cur").alias("ts")), ["grp", "rid"])
    denied = follow.join(d, ["grp", "attribute", "value", "ts"]).select("grp", "rid").distinct().withColumn("denied", F.lit(True))
    times = times.join(denied, ["grp", "rid"], "left").select("grp", "rid", "cur", (F.col("after") & F.col("denied").isNull()).alias("after"))
    levels = u.join(_levels(order), ["attribute", "value"]).groupBy("grp", "rid").agg(F.sum("level").cast("int").alias("level"))
    return times.join(levels, ["grp", "rid"], "full")


def survivors(
    groups: DataFrame,
    records: DataFrame,
    *,
    best: Column,
    fields: dict[str, Column],
    attributes: list[str],
    timestamp: str = "scanned_at",
    trust: str = "trust_rank",
    rows_per_salt: int = 200_000,
) -> DataFrame:
    """(grp, field_name, record_id): the surviving record (``keep``) and the source of each field.

    groups: grp, path (each once). records: path, record_id, ``timestamp``, ``trust`` and
    whatever the expressions need. ``best`` is the score of ``keep`` (null comes last),
    ``fields`` tells per field whether a record has it. keep: best score, then most
    fields, then most current, then smallest record_id. Field: smallest trust (null
    last), then most current, then smallest record_id. Groups without a record give no rows;
    repeated rows change nothing; of equal ids the better row counts.

    Dated records are reduced to the best of each path before they meet the groups, so
    neither a path with many records nor one that many groups name multiplies rows.
    """
    scratch = Scratch(records.sparkSession)
    groups = scratch.write(groups.where(F.col("path").isNotNull()).distinct(), "groups")
    named = groups.select("path").distinct()
    full = sum((f.cast("int") for f in fields.values()), F.lit(0))
    slim = records.where(F.col("path").isNotNull() & F.col("record_id").isNotNull()).select(
        "path", F.col("record_id").alias("rid"), F.col(timestamp).alias("ts"), F.col(trust).alias("trust"), best.cast("double").alias("best"),
        full.alias("complete"), *(f.alias(f"has_{n}") for n, f in fields.items()), *attributes,
    )
    mine = scratch.write(slim.join(named, "path", "left_semi"), "candidates")

    def keys(cur: Column, place: Column, level: Column) -> list[Column]:
        when = [cur.alias("cur"), place.alias("place"), level.alias("level"), F.bitwise_not("rid").alias("back")]
        out = [F.struct("best", "complete", *when).alias("keep")]
        return out + [F.when(F.col(f"has_{n}"), F.struct(F.bitwise_not("trust").alias("trust"), *when)).alias(n) for n in fields]

    names = ["keep", *fields]
    dated = mine.where(F.col("ts").isNotNull())
    per_path = dated.select("path", *keys(F.col("ts"), F.lit(1), F.lit(0))).groupBy("path").agg(*(F.max(n).alias(n) for n in names))
    salter = Salter(scratch, groups, ["path"], rows_per_salt, "paths")
    entries = salter.big(groups, ["grp"]).join(salter.other(per_path), salter.join_keys).select("grp", *names)

    undated = scratch.write(mine.where(F.col("ts").isNull()).join(groups, "path"), "undated")
    if not undated.isEmpty():
        precedence = learn_precedence(records, "path", timestamp, attributes)
        touched = undated.select("grp").distinct()
        around = dated.join(groups.join(touched, "grp", "left_semi"), "path").select("grp", "ts", *attributes)
        placed = _place_undated(scratch, undated, around, precedence, attributes)
        late = undated.join(placed, ["grp", "rid"], "left")
        place = F.when(F.col("after"), 2).otherwise(0)
        entries = entries.unionByName(late.select("grp", *keys(F.col("cur"), place, F.coalesce("level", F.lit(0)))))
    chosen = entries.groupBy("grp").agg(*(F.max(n).alias(n) for n in names))
    rows = F.array(*(F.struct(F.lit(n).alias("field_name"), F.bitwise_not(F.col(f"{n}.back")).alias("record_id")) for n in names))
    return chosen.select("grp", F.explode(rows).alias("r")).select("grp", "r.field_name", "r.record_id").where(F.col("record_id").isNotNull())
