"""Percentiles of large numeric columns by deterministic buffer collapsing.

A sketch is a set of sorted buffers of ``k`` values, each with a weight that is a
power of two, and fewer than 2k values of weight 1. When 2**j buffers of one
weight w are at hand they are merged and every 2**j-th value of the sorted run is
kept as one buffer of weight w * 2**j. Keeping positions o, o+s, o+2s, ... of a run
changes the estimated number of values at or below any x by -w*o to w*(s-1-o); each
sketch carries the sum of these (``err_minus``, ``err_plus``), so its rank error is
known, not only expected. No random numbers: a recomputed task gives the same
sketch. Sketches of days, partitions or runs are put together with ``merge``.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewlake.operators.skew import BROADCAST_ROWS
from viewlake.session import Scratch

#: Values per buffer; the rank error is about 1/k of the rows per level of merging, at most.
BUFFER = 1024
#: Rows (leaf) or values (merge) a task holds before it works them off; the default of ``limit``.
FLUSH = 1_000_000
#: Values of one key that one task merges.
PART_VALUES = 8_000_000

SKETCH_FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("err_plus", T.LongType()), T.StructField("err_minus", T.LongType()),
    T.StructField("vals", T.ArrayType(T.DoubleType())), T.StructField("wts", T.ArrayType(T.LongType())),
]


def _spread(n: int, m: int) -> np.ndarray:
    """m distinct, evenly spaced positions of n."""
    return (np.arange(m, dtype=np.int64) * n) // max(m, 1)


def compress(vals: np.ndarray, wts: np.ndarray, k: int, plus: int, minus: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Collapse while any weight has two buffers or more; returns values, weights and the error so far."""
    held: dict[int, list[np.ndarray]] = {}
    for w in np.unique(wts):
        held[int(w)] = [vals[wts == w]]
    out_v, out_w = [], []
    while held:
        w = min(held)
        run = np.sort(np.concatenate(held.pop(w)))
        while len(run) >= 2 * k:
            s = 1 << ((len(run) // k).bit_length() - 1)
            taken = np.zeros(len(run), bool)
            taken[_spread(len(run), k * s)] = True
            part, run = run[taken], run[~taken]
            o = (s - 1) // 2 if plus <= minus else s // 2
            plus, minus = plus + w * (s - 1 - o), minus + w * o
            held.setdefault(w * s, []).append(part[o::s])
        out_v.append(run)
        out_w.append(np.full(len(run), w, np.int64))
    return np.concatenate(out_v), np.concatenate(out_w), plus, minus


def _codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """An integer per row, equal for rows of equal keys (null equals null)."""
    code = np.zeros(table.num_rows, np.int64)
    for c in keys:
        column = table[c].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        d = pc.dictionary_encode(column, null_encoding="encode")
        code = code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    return code


def _pack(table: pa.Table, keys: list[str], first: np.ndarray, n: np.ndarray, plus: np.ndarray, minus: np.ndarray, vals: np.ndarray, wts: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    head = table.select(keys).take(pa.array(first))
    at = pa.array(offsets.astype(np.int32))
    arrays = [head[c].combine_chunks() for c in keys]
    arrays = [a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks) for a in arrays]
    arrays += [pa.array(n), pa.array(plus), pa.array(minus), pa.ListArray.from_arrays(at, pa.array(vals)), pa.ListArray.from_arrays(at, pa.array(wts))]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys, *(f.name for f in SKETCH_FIELDS)])


def _group_up(table: pa.Table, keys: list[str], code: np.ndarray, n: np.ndarray, plus: np.ndarray, minus: np.ndarray, vals: np.ndarray, wts: np.ndarray, owner: np.ndarray, k: int) -> pa.RecordBatch:
    """One sketch row per code. n, plus, minus are per table row; owner is the code of each value."""
    groups = int(code.max()) + 1
    first = np.full(groups, -1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    total = lambda x: np.bincount(code, weights=x, minlength=groups).astype(np.int64)  # noqa: E731  exact up to 2**53
    n, plus, minus = total(n), total(plus), total(minus)
    order = np.lexsort((vals, owner))
    vals, wts = vals[order], wts[order]
    sizes = np.bincount(owner, minlength=groups)
    ends = np.cumsum(sizes)
    large = np.flatnonzero(sizes >= 2 * k)
    if len(large):
        parts_v, parts_w, at = [], [], 0
        for g in large:
            a, b = ends[g] - sizes[g], ends[g]
            v, w, plus[g], minus[g] = compress(vals[a:b], wts[a:b], k, int(plus[g]), int(minus[g]))
            parts_v += [vals[at:a], v]
            parts_w += [wts[at:a], w]
            sizes[g], at = len(v), b
        vals, wts = np.concatenate([*parts_v, vals[at:]]), np.concatenate([*parts_w, wts[at:]])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return _pack(table, keys, first, n, plus, minus, vals, wts, offsets)


def _plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with fields named and nullable as in a batch built here, so that both fit into one table."""
    lists = {"vals": pa.list_(pa.float64()), "wts": pa.list_(pa.int64())}
    columns = [batch.column(i).cast(lists[f.name]) if f.name in lists else batch.column(i) for i, f in enumerate(batch.schema)]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _leaf(keys: list[str], value: str, k: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            code = _codes(table, keys)
            vals = table[value].to_numpy()
            one, none = np.ones(len(vals), np.int64), np.zeros(len(vals), np.int64)
            yield _group_up(table, keys, code, one, none, none, vals, one, code, k)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= limit:
                yield from flush()
        if held:
            yield from flush()

    return run


def _merge(keys: list[str], k: int, limit: int):
    """For partitions sorted by key: only the last key of a buffer can go on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            code = _codes(table, keys)
            code = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
            lists = table["vals"].combine_chunks()
            lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
            wlists = table["wts"].combine_chunks()
            wlists = wlists if isinstance(wlists, pa.Array) else pa.concat_arrays(wlists.chunks)
            owner = np.repeat(code, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            col = lambda c: table[c].to_numpy()
            out = _group_up(table, keys, code, col("n"), col("err_plus"), col("err_minus"), lists.flatten().to_numpy(), wlists.flatten().to_numpy(), owner, k)
            if last:
                yield out
            else:
                held.append(_plain(out.slice(out.num_rows - 1)))
                if out.num_rows > 1:
                    yield out.slice(0, out.num_rows - 1)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_plain(batch))
            size += len(batch.column("vals").flatten())
            if size >= limit:
                yield from work(False)
                size = 0
        if held:
            yield from work(True)

    return run


def _schema(df: DataFrame, keys: list[str], more: list[T.StructField]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keys] + more)


def sketch(df: DataFrame, keys: list[str], value: str, k: int = BUFFER, limit: int = FLUSH) -> DataFrame:
    """Partial sketches (several rows per key) of a numeric column; null, NaN and infinite values are left out. A null key is a key."""
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    rows = df.select(*keys, v.alias(value)).where(usable)
    return rows.mapInArrow(_leaf(keys, value, k, limit), _schema(rows, keys, SKETCH_FIELDS))


def buffer_size(error: float, rows: float = 1e9) -> int:
    """Values per buffer with which the rank error of up to ``rows`` values stays below ``error`` * rows.

    A value is collapsed at most log2(rows / k) times, and each time adds 1/(2k) of the rows at most.
    """
    k = 16
    while math.log2(max(rows / k, 2.0)) / (2 * k) > error:
        k *= 2
    return k


def merge(sketches: DataFrame, keys: list[str], k: int = BUFFER, limit: int = FLUSH, part_values: int = PART_VALUES, scratch: Scratch | None = None) -> DataFrame:
    """One sketch per key.

    The values held for each key are counted first. Keys with more than ``part_values``
    are merged in that many parts, again and again until what is left of them fits one task; all
    others take part in the last merge only. A sketch holds fewer than 64 * k values, so each turn at least halves what is held.
    """
    part_values = max(part_values, 128 * k)
    scratch = scratch or Scratch(sketches.sparkSession)
    name, level = uuid.uuid4().hex, 0
    rows = scratch.write(sketches.select(*keys, *(f.name for f in SKETCH_FIELDS)), f"partial_{name}")
    schema = _schema(rows, keys, SKETCH_FIELDS)
    while True:
        held = rows.groupBy(*keys).agg(F.sum(F.size("vals")).alias("_held")).where(F.col("_held") > part_values)
        hot = held.select(*(F.col(c).alias(f"_{c}") for c in keys), F.ceil(F.col("_held") / F.lit(part_values)).cast("int").alias("_parts"))
        hot = scratch.write(hot, f"hot_{name}_{level}")
        n_hot = hot.count()
        if not n_hot:
            return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(keys, k, limit), schema)
        same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys))
        small = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        part = rows.join(small, same).withColumn("_part", F.pmod(F.xxhash64("n", "vals", "wts"), F.col("_parts").cast("long")))
        part = part.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part").select(*rows.columns, "_part")
        done = part.mapInArrow(_merge([*keys, "_part"], k, limit), T.StructType([*schema.fields[: len(keys)], T.StructField("_part", T.LongType()), *SKETCH_FIELDS])).drop("_part")
        level += 1
        rows = scratch.write(rows.join(small, same, "left_anti").unionByName(done), f"partial_{name}_{level}")


def _ordered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values in order within each row, running weights over all rows, and where each row begins (in weight, in position)."""
    lists, wlists = batch.column("vals"), batch.column("wts")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(batch.num_rows), sizes)
    vals, wts = lists.flatten().to_numpy(), wlists.flatten().to_numpy()
    order = np.lexsort((vals, owner))
    running = np.cumsum(wts[order])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    base = np.concatenate([[0], running])[starts]
    return vals[order], running, base, starts


def _at_rank(ordered: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest kept value whose estimated rank reaches ``rank``, per row, and whether there is one."""
    vals, running, base, starts = ordered
    at = np.searchsorted(running, base[:-1] + np.maximum(rank, 1), "left")
    there = at < starts[1:]
    return vals[np.minimum(at, len(vals) - 1)], there


def percentiles(sketches: DataFrame, keys: list[str], permille: list[int]) -> DataFrame:
    """Per sketch: n, rank_error (bound on the rank error as a fraction of n) and a column pNNN per thousandth.

    pNNN is the value of rank ceil(NNN * n / 1000), exact where nothing was collapsed.
    """
    more = [T.StructField("n", T.LongType()), T.StructField("rank_error", T.DoubleType())]
    more += [T.StructField(f"p{q:03d}", T.DoubleType()) for q in permille]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ordered = _ordered(batch)
            n = batch.column("n").to_numpy()
            worst = np.maximum(batch.column("err_plus").to_numpy(), batch.column("err_minus").to_numpy())
            cols = [pa.array(_at_rank(ordered, -(-n * q // 1000))[0]) for q in permille]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(n), pa.array(worst / n), *cols], names=[*keys, *(f.name for f in more)])

    return sketches.mapInArrow(run, _schema(sketches, keys, more))


def rank_bounds(sketches: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Keys with lo and hi: the value of the given rank (1 = smallest) is certainly between them. Infinite where the sketch gives no bound."""
    more = [T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ordered = _ordered(batch)
            r = batch.column(rank).to_numpy()
            low = r - batch.column("err_minus").to_numpy()
            lo, _ = _at_rank(ordered, low)
            hi, there = _at_rank(ordered, r + batch.column("err_plus").to_numpy())
            lo, hi = np.where(low < 1, -np.inf, lo), np.where(there, hi, np.inf)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(lo), pa.array(hi)], names=[*keys, "lo", "hi"])

    return sketches.mapInArrow(run, _schema(sketches, keys, more))
