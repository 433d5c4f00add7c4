"""Splitting hot join keys over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlake.session import Scratch

#: A table of hot keys is broadcast only up to this many rows (it is counted).
BROADCAST_ROWS = 50_000


class Salter:
    """Salts an equi-join whose large side may have hot keys.

    Keys with more than ``rows_per_salt`` rows on the large side are found by a
    pre-aggregated count. Their rows are spread over several salts by a hash of
    ``spread_by`` (no random numbers, so a recomputed task gives the same rows),
    and the other side is repeated once per salt for these keys only. Every
    other key keeps salt 0. Null keys never join and keep salt 0.
    """

    def __init__(self, scratch: Scratch, big: DataFrame, keys: list[str], rows_per_salt: int, name: str):
        counted = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_salt)
        hot = counted.select(*keys, F.ceil(F.col("_rows") / F.lit(rows_per_salt)).cast("int").alias("_salts"))
        self.hot, told = scratch.write_observed(hot, f"hot_{name}", {"n": F.count(F.lit(1))})
        self.n_hot = told["n"]
        self.keys = keys
        self.join_keys = [*keys, "_salt"]

    def _with_salts(self, df: DataFrame) -> DataFrame:
        if not self.n_hot:
            return df.withColumn("_salts", F.lit(1))
        hot = F.broadcast(self.hot) if self.n_hot <= BROADCAST_ROWS else self.hot
        return df.join(hot, self.keys, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    def big(self, df: DataFrame, spread_by: list[str]) -> DataFrame:
        out = self._with_salts(df)
        salt = F.pmod(F.xxhash64(*spread_by), F.col("_salts").cast("long")).cast("int")
        return out.withColumn("_salt", salt).drop("_salts")

    def other(self, df: DataFrame) -> DataFrame:
        if not self.n_hot:
            return df.withColumn("_salt", F.lit(0))
        out = self._with_salts(df)
        return out.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")


def attach(scratch: Scratch, rows: DataFrame, small: DataFrame, keys: list[str], count: int, spread_by: list[str], rows_per_salt: int = 1_000_000) -> DataFrame:
    """Inner join with a table of ``count`` rows, one per key: broadcast up to BROADCAST_ROWS, beyond it with the hot keys of ``rows`` salted."""
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys)
    salter = Salter(scratch, rows, keys, rows_per_salt, "_".join(keys))
    return salter.big(rows, spread_by).join(salter.other(small), salter.join_keys).drop("_salt")
