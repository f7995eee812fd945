"""Index arithmetic and block arithmetic of one axis, for numbers and for columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of linearisation orders in array libraries.
ORDERS = {"C": "F", "R": "C"}


def order_name(order: str) -> str:
    """The array-library name of column-major (C) and row-major (R) order."""
    if order not in ORDERS:
        raise ValueError(f"order is R or C, not {order!r}")
    return ORDERS[order]


def _axes(dims: Sequence[int], order: Sequence[int] | None) -> list[int]:
    axes = list(range(len(dims))) if order is None else list(order)
    if not axes or len(axes) > len(dims):
        raise ValueError(f"an order of {len(axes)} axes does not fit {len(dims)} dimensions")
    return axes


def to_linear(dims: Sequence[int], index: Sequence[int], order: Sequence[int] | None = None) -> int:
    """The position of an index among all indices; the last axis of ``order`` runs fastest."""
    if len(dims) != len(index):
        raise ValueError(f"{len(index)} indices for {len(dims)} dimensions")
    if any(not 0 <= i < n for i, n in zip(index, dims, strict=True)):
        raise ValueError(f"index {tuple(index)} is out of bounds for {tuple(dims)}")
    at = 0
    for k in _axes(dims, order):
        at = at * dims[k] + index[k]
    return at


def from_linear(position: int, dims: Sequence[int], order: str = "R") -> tuple[int, ...]:
    """The index at a position; order C decodes over the reversed dimensions."""
    order_name(order)
    if not 0 <= position < math.prod(dims):
        raise IndexError(f"{position} is out of range for {tuple(dims)}")
    out, rest = [], position
    for n in reversed(dims if order == "R" else tuple(reversed(dims))):
        rest, i = divmod(rest, n)
        out.append(i)
    return tuple(reversed(out))


def linear_column(dims: Sequence[int], index: Sequence[Column], order: Sequence[int] | None = None) -> Column:
    at = F.lit(0).cast("bigint")
    for k in _axes(dims, order):
        at = at * dims[k] + index[k]
    return at


def index_columns(position: Column, dims: Sequence[int]) -> list[Column]:
    """Row-major indices of a position, as whole-number columns."""
    out, stride = [], math.prod(dims)
    for n in dims:
        stride //= n
        out.append(F.pmod(whole_division(position, stride), F.lit(n)).cast("bigint"))
    return out


def whole_division(a: Column, b: int) -> Column:
    """Exact division of non-negative whole numbers."""
    a = a.cast("bigint")
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("bigint") if b != 1 else a


def max_block_size(size: int, procs: int) -> int:
    """The largest block that leaves no processor without cells."""
    return size if procs == 1 else max(1, (size - 1) // (procs - 1))


def axis_compatible(size: int, block: int, procs: int) -> bool:
    return size >= procs and 0 <= block <= max_block_size(size, procs)


def splits(size: int, block: int, procs: int) -> list[tuple[int, int]]:
    """(length, end) of the blocks of an axis; block 0 deals the axis out evenly, one block a processor."""
    if block < 0:
        raise ValueError("a block size is not negative")
    if block == 0:
        each, more = divmod(size, procs)
        sizes = [each + (p < more) for p in range(procs)]
    else:
        sizes = [min(block, size - at) for at in range(0, size, block)]
    ends, total = [], 0
    for n in sizes:
        total += n
        ends.append(total)
    return list(zip(sizes, ends, strict=True))


def splits_frame(spark: SparkSession, size: int, block: int, procs: int) -> DataFrame:
    """(id, length, ends) of the blocks, without listing them on the driver."""
    if block == 0:
        each, more = divmod(size, procs)
        lengths = spark.range(procs).select("id", (F.lit(each) + (F.col("id") < more).cast("bigint")).alias("length"))
        return lengths.select("id", "length", F.sum("length").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)).alias("ends"))
    blocks = spark.range(-(-size // block))
    return blocks.select("id", F.least(F.lit(block), size - F.col("id") * block).cast("bigint").alias("length"), F.least((F.col("id") + 1) * block, F.lit(size)).cast("bigint").alias("ends"))


def block_owner(x: Column, block: int, procs: int) -> Column:
    """The processor, 0 to procs - 1, of an axis index under block-cyclic dealing."""
    return F.pmod(whole_division(x, block), F.lit(procs))


def even_owner(x: Column, size: int, procs: int) -> Column:
    """The processor of an axis index when the axis is dealt out evenly."""
    each, more = divmod(size, procs)
    if not each:
        return x.cast("bigint")
    return F.when(x < more * (each + 1), whole_division(x, each + 1)).otherwise(more + whole_division(x - more * (each + 1), each))
