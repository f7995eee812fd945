"""Sums of products of stored cells over a shared index.

``Out[i.., j..] += X[i.., k..] * Y[j.., k..]`` joins every pair of stored cells with one k.  Dealt by a hash of k, pairs of
one output cell are spread over all tasks, and nearly every pair travels to its sum.

* ``crossed``: the left side is dealt by i and the right one by j, each cell once, in packed runs.  A task reads one part
  of each side (a cross join without a broadcast) and makes all sums of its i and j, so no pair and no sum travels and
  what is shuffled grows with the given cells.  Equal ones need not be added up before.  A task holds about ``HELD`` cells of
  a side and ``MET`` pairs.  Every part is read once for each part of the other side, so this is for at most ``GRID`` parts a side.
* ``multiply``: beyond that, or where stored cells cannot be counted cheaply, both sides are dealt together by ranges of
  k, heavy values in parts (:mod:`tessellum.operators.skew`), and one sorted pass over a range expands pairs as arrays and
  adds them up by output cell before they travel.  Where neighbouring k meet the same i and j, few sums are left of many
  pairs; in the worst case as many travel as with a join.  A task holds ``CELLS`` cells, the left cells of one part of a
  k and ``PAIRS`` pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.operators import skew

#: Cells that are taken together, and pairs that are expanded at once.
CELLS = 1 << 18
PAIRS = 1 << 22
#: Cells of a side that a task of a cross join holds, most parts of a side there, and cells that are packed at once.
HELD = 3 << 20
GRID = 128
PACKED = 1 << 20
#: Pairs that are expanded at once there.
MET = 1 << 20
_RUNS = "part int, size int, k0 long, k binary, at0 long, at binary, x binary"


def _added(at: np.ndarray, x: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by place, of which there are so many."""
    if places <= 4 * len(x):
        made = np.flatnonzero(np.bincount(at, minlength=places))
        return made, np.bincount(at, x, places)[made]
    order = np.argsort(at, kind="stable")
    at = at[order]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[begin], np.add.reduceat(x[order], begin)


def _expanded(left: tuple, right: tuple) -> Iterator[pa.RecordBatch]:
    """Sums (i, j, x) of the pairs of cells (group, at, x) of one group."""
    (groups, i, x), (own, j, y) = left, right
    rows, i = np.unique(i, return_inverse=True)
    columns, j = np.unique(j, return_inverse=True)
    begin = np.searchsorted(groups, own, "left")
    size = np.searchsorted(groups, own, "right") - begin
    ends = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        n = size[first:last]
        place = np.repeat(begin[first:last] - (np.cumsum(n) - n), n)
        place += np.arange(len(place))
        if len(place):
            with np.errstate(all="ignore"):
                value = x[place] * np.repeat(y[first:last], n)
                made, total = _added(i[place] * len(columns) + np.repeat(j[first:last], n), value, len(rows) * len(columns))
            yield pa.record_batch([pa.array(rows[made // len(columns)]), pa.array(columns[made % len(columns)]), pa.array(total)], names=["i", "j", "x"])
        first = last


def _pairs(keys: int):
    """Cells (keys.., side, at, x), sorted, as sums (i, j, x)."""

    def together(held: list[pa.RecordBatch], kept: tuple | None) -> tuple[tuple, tuple, tuple]:
        """Left and right cells by group, and the key and left cells of the last group, which may go on."""
        columns = [np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in range(keys + 3)]
        new = np.zeros(len(columns[0]), bool)
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        group = np.cumsum(new)
        is_left = columns[keys] == 0
        left, right = ((group[side], columns[keys + 1][side], columns[keys + 2][side]) for side in (is_left, ~is_left))
        if kept is not None and kept[0] == tuple(c[0] for c in columns[:keys]):
            left = tuple(np.concatenate([p, q]) for p, q in zip((np.zeros(len(kept[1]), group.dtype), *kept[1:]), left, strict=True))
        goes_on = left[0] == group[-1]
        return left, right, (tuple(c[-1] for c in columns[:keys]), left[1][goes_on], left[2][goes_on])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, kept = [], 0, None
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= CELLS:
                left, right, kept = together(held, kept)
                yield from _expanded(left, right)
                held, count = [], 0
        if held:
            yield from _expanded(*together(held, kept)[:2])

    return run


def multiply(left: DataFrame, right: DataFrame, keys: list[str], values: tuple[str, str]) -> DataFrame:
    """(i, j, x): sums of products of values of ``left`` (keys.., i, value) and ``right`` (keys.., j, value)."""
    a, b = skew.sides(left, right, keys)
    dealt = [*keys, "_l", "_r"]
    both = a.select(*dealt, F.lit(0).alias("side"), F.col("i").alias("at"), F.col(values[0]).alias("x")).unionByName(b.select(*dealt, F.lit(1).alias("side"), F.col("j").alias("at"), F.col(values[1]).alias("x")))
    ranged = both.repartitionByRange(*dealt).sortWithinPartitions(*dealt, "side")
    parts = ranged.select(*dealt, "side", "at", "x").mapInArrow(_pairs(len(dealt)), "i long, j long, x double")
    return parts.groupBy("i", "j").agg(F.sum("x").alias("x"))


def parts(rows: int, cores: int) -> int:
    """How many parts a side of so many cells is dealt into; small ones so that there are two tasks for each core."""
    return max(1, -(-rows // HELD), min(rows, math.ceil(math.sqrt(2 * cores))))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the fewest bytes."""
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if x.max() <= np.iinfo(t).max))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells (part, k, at, x) as runs of one part in the order of k, equal ones added up.

    How many bytes a number takes is told by the size of a run.
    """

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, at, x = (np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in ("part", "k", "at", "x"))
        order = np.argsort(part, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
        rows = []
        for own in np.split(order, begin[1:]):
            ks, places, value = _whole(k[own], at[own], x[own])
            with np.errstate(all="ignore"):
                short = value.astype(np.float32)
            value = short if np.array_equal(short, value) else value
            rows.append((part[own[0]], len(ks), ks[0], _narrow(np.diff(ks, prepend=ks[0])).tobytes(), places.min(), _narrow(places - places.min()).tobytes(), value.tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "size", "k0", "k", "at0", "at", "x"])

    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= PACKED:
            yield from made(held)
            held, count = [], 0
    if held:
        yield from made(held)


def _cells(runs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, at, x) of some runs, in 4 bytes a number where that holds them."""
    k, at, x = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for size, k0, steps, at0, where, value in runs:
        unsigned = [np.frombuffer(raw, f"u{len(raw) // size}") for raw in (steps, where)]
        for out, n in ((k, k0 + np.cumsum(unsigned[0], dtype=np.int64)), (at, at0 + unsigned[1].astype(np.int64))):
            out.append(n.astype(np.int32) if -(1 << 31) <= n.min() and n.max() < 1 << 31 else n)
        x.append(np.frombuffer(value, f"f{len(value) // size}"))
    return np.concatenate(k), np.concatenate(at), np.concatenate(x)


def _found(k: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of ``k`` begin in the sorted ``own``, and how often they are there."""
    low, high = int(own[0]), int(own[-1])
    if high - low > 16 * (len(k) + len(own)):
        begin = np.searchsorted(own, k, "left")
        return begin, np.searchsorted(own, k, "right") - begin
    ends = np.zeros(high - low + 3, np.int64)
    ends[1:-1] = np.cumsum(np.bincount(own - low, minlength=high - low + 1))
    ends[-1] = ends[-2]  # of values that are not there
    at = np.where((k >= low) & (k <= high), k - low, high - low + 1)
    begin = ends[at]
    at += 1
    return begin, ends[at] - begin


def _whole(k: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal cells added up, in the order of k."""
    order = np.lexsort((at, k))
    k, at, x = k[order], at[order], x[order]
    begin = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (at[1:] != at[:-1])]))
    with np.errstate(all="ignore"):
        return k[begin], at[begin], np.add.reduceat(x, begin, dtype=float)


def _numbered(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``at`` in order, and the number of each place's value among them."""
    low = int(at.min())
    wide = int(at.max()) - low + 1
    if wide > 4 * len(at):
        return np.unique(at, return_inverse=True)
    there = np.zeros(wide, bool)
    there[at - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[at - low]


def _products(left: tuple, right: tuple) -> Iterator[pa.RecordBatch]:
    """All sums (i, j, x) of left cells (k, i, x) and right cells (k, j, y), at most ``MET`` pairs or those of one i at once.

    Equal cells are added up first where that costs less than their pairs; the sums are the same.
    """

    def meeting(left: tuple, right: tuple) -> tuple:
        (k, i, x), (own, j, y) = left, right
        order = np.argsort(own, kind="stable")
        own, j, y = own[order], j[order], y[order]
        del order
        begin, n = _found(k, own)
        met = np.flatnonzero(n)
        return i[met], x[met], begin[met], n[met], j, y

    if not len(left[0]) or not len(right[0]):
        return
    i, x, begin, n, j, y = meeting(left, right)
    if n.sum() > 2 * (len(left[0]) + len(right[0])):
        i, x, begin, n, j, y = meeting(_whole(*left), _whole(*right))
    if not len(n):
        return
    (rows, i), (columns, j) = _numbered(i), _numbered(j)
    across, whole = len(columns), n.sum() <= MET
    if not whole:
        order = np.argsort(i, kind="stable")
        i, x, begin, n = i[order], x[order], begin[order], n[order]
    ends = np.cumsum(n)

    def upto(first: int) -> int:
        return max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + MET, "right")))

    def some(first: int, last: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        count = n[first:last]
        place = np.repeat(begin[first:last] - (np.cumsum(count) - count), count)
        place += np.arange(len(place))
        with np.errstate(all="ignore"):
            return _added(np.repeat((i[first:last] - low) * across, count) + j[place], np.repeat(x[first:last].astype(float), count) * y[place], (high - low + 1) * across)

    first = 0
    while first < len(n):
        if whole:
            last, low, high = len(n), 0, len(rows) - 1
        else:
            last = upto(first)
            if last < len(n):  # up to the last i that is done whole, or all of one i
                last = int(np.searchsorted(i, i[last], "left"))
                last = last if last > first else int(np.searchsorted(i, i[first], "right"))
            low, high = int(i[first]), int(i[last - 1])
        made, total = np.zeros(0, np.int64), np.zeros(0)
        while first < last:
            step = last if whole else min(last, upto(first))
            more = some(first, step, low, high)
            made, total = more if not len(made) else _added(*(np.concatenate(c) for c in zip((made, total), more, strict=True)), (high - low + 1) * across)
            first = step
        yield pa.record_batch([pa.array(rows[made // across + low]), pa.array(columns[made % across]), pa.array(total)], names=["i", "j", "x"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of one part of each side as the sums of their pairs."""
    left, right = [], []
    for batch in batches:
        for runs, name in ((left, "left"), (right, "right")):
            column = batch.column(name)
            runs += zip(*(c.to_pylist() for c in column.filter(column.is_valid()).flatten()), strict=True)
    cells = []
    for runs in (left, right):
        cells.append(_cells(runs))
        runs.clear()
    for batch in _products(*cells):
        for first in range(0, batch.num_rows, 1 << 16):
            yield batch.slice(first, 1 << 16)


def crossed(left: DataFrame, right: DataFrame, values: tuple[str, str], counts: tuple[int, int]) -> DataFrame:
    """(i, j, x): sums of products of values of ``left`` (k, i, value) and ``right`` (k, j, value), dealt into so many parts."""

    def dealt(frame: DataFrame, at: str, value: str, count: int, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64(at), F.lit(count)).cast("int").alias("part")
        runs = frame.where(F.col("k").isNotNull()).select(part, "k", F.col(at).alias("at"), F.col(value).alias("x")).mapInArrow(_runs, _RUNS).repartitionById(count, F.col("part"))
        number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the part
        return runs.select(number.alias(f"n_{name}"), F.struct("size", "k0", "k", "at0", "at", "x").alias(name))

    a, b = dealt(left, "i", values[0], counts[0], "left"), dealt(right, "j", values[1], counts[1], "right")
    # Not all pairs of runs, but every run of both parts once.
    both = a.crossJoin(b.hint("shuffle_replicate_nl")).where((F.col("n_left") == 0) | (F.col("n_right") == 0))
    once = both.select(F.when(F.col("n_right") == 0, F.col("left")).alias("left"), F.when(F.col("n_left") == 0, F.col("right")).alias("right"))
    return once.mapInArrow(_meet, "i long, j long, x double")
