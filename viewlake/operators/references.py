"""References whose partner is missing, gone or not there yet."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewlake.operators.skew import Salter
from viewlake.session import Scratch

SEMANTICS = ("simple", "partial", "full")


def null_mask(keys: list[str]) -> Column:
    """One character per key column: 1 where it has a value."""
    return F.concat(*(F.when(F.col(k).isNull(), "0").otherwise("1") for k in keys))


def find_orphans(
    references: DataFrame,
    partners: DataFrame,
    keys: list[str],
    *,
    ref_time: str,
    valid_from: str,
    valid_to: str,
    id_cols: list[str],
    semantics: str = "simple",
    rows_per_salt: int = 200_000,
) -> DataFrame:
    """Rows of ``references`` without a partner at ``ref_time``, with a ``reason``.

    A partner is there from ``valid_from`` (included) until ``valid_to`` (excluded, null
    = for ever); a partner whose ``valid_from`` is null was known but never there.
    References are grouped by their null mask and each mask is anti-joined on its
    non-null columns. ``semantics`` declares what a partly null key means:

    * simple: any null satisfies the reference;
    * partial: the non-null columns must match some partner, all null satisfies;
    * full: partly null is an orphan (reason ``partial_null``), all null satisfies.

    reason: ``missing`` (no partner row), ``late`` (a partner comes after ref_time), else
    ``deleted``. A null ref_time finds no partner present: missing or deleted.
    Returns id_cols, ref_time and reason; repeated references count once. Empty
    tables on either side are allowed. Extra columns are ignored.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")
    scratch = Scratch(references.sparkSession)
    keep = list(dict.fromkeys([*id_cols, ref_time]))
    wanted = list(dict.fromkeys([*keep, *keys]))
    refs = references.select(*wanted).withColumn("_mask", null_mask(keys))
    parts = partners.select(*keys, F.col(valid_from).alias("_from"), F.col(valid_to).alias("_to"))
    found = None
    for bits in product("01", repeat=len(keys)):
        mask, on = "".join(bits), [k for k, b in zip(keys, bits) if b == "1"]
        whole = len(on) == len(keys)
        if not on or (semantics == "simple" and not whole):
            continue
        mine = refs.where(F.col("_mask") == mask)
        if semantics == "full" and not whole:
            out = mine.select(*keep, F.lit("partial_null").alias("reason"))
        else:
            out = _orphans_of_mask(scratch, mine, parts, on, keep, ref_time, rows_per_salt, mask)
        found = out if found is None else found.unionByName(out)
    if found is None:
        return references.select(*keep, F.lit("missing").alias("reason")).where(F.lit(False))
    return found.distinct()


def _orphans_of_mask(scratch: Scratch, refs: DataFrame, parts: DataFrame, on: list[str], keep: list[str], ref_time: str, rows_per_salt: int, mask: str) -> DataFrame:
    salter = Salter(scratch, refs, on, rows_per_salt, f"refs_{mask}")
    known = parts.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in on)))
    # One row per key and end: of partners ending alike only the earliest start matters.
    spans = known.where(F.col("_from").isNotNull()).groupBy(*on, "_to").agg(F.min("_from").alias("_from"))
    last = known.groupBy(*on).agg(F.max("_from").alias("_last"), F.lit(True).alias("_known"))
    left = salter.big(refs, keep).alias("l")
    right = salter.other(spans).alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in salter.join_keys]
    there = (F.col("r._from") <= F.col(f"l.{ref_time}")) & (F.col("r._to").isNull() | (F.col("r._to") > F.col(f"l.{ref_time}")))
    cond = there
    for s in same:
        cond = cond & s
    orphans = left.join(right, cond, "left_anti")
    told = orphans.join(salter.other(last), salter.join_keys, "left")
    reason = F.when(F.col("_known").isNull(), "missing").when(F.col("_last") > F.col(ref_time), "late").otherwise("deleted")
    return told.select(*keep, reason.alias("reason"))


def plain_name(name: Column) -> Column:
    """A relative file name without differences of case, slashes, one leading ./ and blanks around it."""
    blanks = F.lit(" \t")
    out = F.lower(F.replace(F.btrim(name, blanks), F.lit("\\"), F.lit("/")))
    return F.when(out.startswith("./"), F.substr(out, F.lit(3))).otherwise(out)
