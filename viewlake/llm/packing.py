"""Filling containers of fixed capacity: bounded-space online best-fit.

Items are dealt to packers by a hash of their id. Each packer keeps a fixed number of
open bins in a bitset keyed by free space: bit f is set while some open bin has f
units left, so the best fit for an item of size s is the lowest set bit at or above s,
found without a search. When nothing fits and all bins are open, the fullest (lowest
set bit of all) closes. A packer's memory is the open bins alone, whatever it is fed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlake.operators.skew import BROADCAST_ROWS

OPEN_BINS = 256
#: Items per packer, about: enough that the bins left open at its end are few among all.
ITEMS_PER_PACKER = 25_000


class Packer:
    """Best-fit over at most ``open_bins`` open bins of ``capacity``; bins are numbered in the order they open."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.n_open, self.opened = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, size: int) -> int:
        """Bin of an item of 1 to capacity units."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.opened
            self.opened += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number

    def whole(self) -> int:
        """A bin for one piece that fills it."""
        self.opened += 1
        return self.opened - 1


def pack(items: DataFrame, targets: DataFrame, item: str, size: str, *, open_bins: int = OPEN_BINS, items_per_packer: int = ITEMS_PER_PACKER) -> DataFrame:
    """(container, capacity, packer, bin, item, piece, size): where each item, or piece of an item, goes.

    items: id and size in units; of repeated ids the largest size counts; items of null,
    0 or negative size take no room and are left out. targets: container, capacity_tokens (a small
    table of settings; null or non-positive capacities are left out). An item is
    split only if it alone exceeds the capacity: all its pieces but the last fill a bin
    each, the last is an item like any other. (container, packer, bin) names a bin.
    """
    caps = targets.where(F.col("capacity_tokens") > 0).groupBy("container").agg(F.max("capacity_tokens").alias("capacity"))
    settings = [(r["container"], int(r["capacity"])) for r in caps.orderBy("container").limit(BROADCAST_ROWS + 1).collect()]
    if len(settings) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} containers")
    kind = items.schema[item].dataType.simpleString()
    sized = items.where(F.col(item).isNotNull() & (F.col(size) > 0))
    packers = max(1, -(-sized.count() // items_per_packer))
    # Packer i is partition i, so every task has one.
    dealt = sized.select(F.col(item).alias("item"), F.col(size).cast("long").alias("size"), F.pmod(F.xxhash64(item), F.lit(packers)).cast("int").alias("packer"))
    dealt = dealt.repartitionById(packers, F.col("packer")).groupBy("packer", "item").agg(F.max("size").alias("size")).sortWithinPartitions("packer", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, state = None, {}
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for who, ident, total in zip(*(batch.column(c).to_pylist() for c in ("packer", "item", "size"))):
                if who != packer:
                    packer, state = who, {name: Packer(c, open_bins) for name, c in settings}
                for name, capacity in settings:
                    own, left, piece = state[name], total, 0
                    while left > 0:
                        part = min(left, capacity)
                        number = own.whole() if left > capacity else own.place(part)
                        for column, x in zip(out, (name, capacity, who, number, ident, piece, part)):
                            column.append(x)
                        left, piece = left - part, piece + 1
            fields = (pa.string(), pa.int64(), pa.int32(), pa.int64(), batch.schema.field("item").type, pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, fields)], names=["container", "capacity", "packer", "bin", "item", "piece", "size"])

    return dealt.mapInArrow(run, f"container string, capacity bigint, packer int, bin bigint, item {kind}, piece int, size bigint")


def bins(packed: DataFrame) -> DataFrame:
    """(container, capacity, packer, bin, items, used, unused)."""
    used = packed.groupBy("container", "capacity", "packer", "bin").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("used"))
    return used.withColumn("unused", F.col("capacity") - F.col("used"))
