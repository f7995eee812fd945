"""Dense tensors as coordinate DataFrames.

A tensor of order r is a frame ``d0 BIGINT, ..., d{r-1} BIGINT, v`` with one row for each cell, and
its shape and type as metadata on the driver.  A sparse one has rows for some cells only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cell types by name, with the width that decides promotions.
TYPES = {"boolean": 0, "tinyint": 1, "smallint": 2, "int": 3, "bigint": 4, "float": 5, "double": 6}


@dataclass(frozen=True)
class Tensor:
    frame: DataFrame
    shape: tuple[int, ...]
    dtype: str = "double"
    #: The same cells as (d0, array of the last axis), where the source has them so.
    arrays: DataFrame | None = None
    #: Whether only some cells have rows; the others are 0.
    sparse: bool = False
    #: The rows that can hold given indices by axis, where the source can leave out files.
    pick: Callable[[dict[int, int]], DataFrame] | None = None
    #: What it is the outer or elementwise product of: (scale, ((axes of a factor, factor), ...)).
    product: tuple[float, tuple[tuple[tuple[int | str, ...], Tensor], ...]] | None = None
    #: Rows of the same columns, of doubles, that stored cells were added up from.
    given: DataFrame | None = None

    @property
    def order(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def packed(self) -> DataFrame:
        """The innermost axis as one array for each row of the others."""
        keys = [f"d{k}" for k in range(self.order - 1)]
        last = F.col(f"d{self.order - 1}")
        return self.frame.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(last.alias("d"), "v"))), lambda c: c["v"]).alias("v"))

    def check(self) -> None:
        """Raise unless every cell is there exactly once and inside the shape."""
        keys = [f"d{k}" for k in range(self.order)]
        inside = [(F.col(k) >= 0) & (F.col(k) < n) for k, n in zip(keys, self.shape, strict=True)]
        bad = self.frame.where(~_all(inside)).limit(1).count() if inside else 0
        cells = self.frame.select(*keys).distinct().count() if keys else self.frame.count()
        if bad or cells != self.size or self.frame.count() != self.size:
            raise ValueError(f"the frame does not hold each cell of shape {self.shape} once")


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def promote(a: str, b: str) -> str:
    return max(a, b, key=TYPES.__getitem__)


def from_columns(frame: DataFrame, indices: Sequence[str | Column], value: str | Column, shape: Sequence[int], dtype: str = "double") -> Tensor:
    """A tensor from index columns and a value column that already hold every cell once."""
    cols = [(F.col(c) if isinstance(c, str) else c).cast("bigint").alias(f"d{k}") for k, c in enumerate(indices)]
    v = F.col(value) if isinstance(value, str) else value
    return Tensor(frame.select(*cols, v.cast(dtype).alias("v")), tuple(map(int, shape)), dtype)


def from_array_column(frame: DataFrame, row: str, values: str, shape: Sequence[int], dtype: str = "double") -> Tensor:
    """A matrix from a row number and an array column."""
    cells = frame.select(F.col(row).cast("bigint").alias("d0"), F.posexplode(values).alias("p", "x"))
    arrays = frame.select(F.col(row).cast("bigint").alias("d0"), F.col(values).alias("x"))
    return Tensor(cells.select("d0", F.col("p").cast("bigint").alias("d1"), F.col("x").cast(dtype).alias("v")), tuple(map(int, shape)), dtype, arrays)


def from_cells(frame: DataFrame, indices: Sequence[str], value: str | Column, shape: Sequence[int], dtype: str = "double") -> Tensor:
    """A sparse tensor: only the given cells are stored, values of equal cells added up; the others are 0."""
    v = F.col(value) if isinstance(value, str) else value
    keys = [f"d{k}" for k in range(len(indices))]
    placed = frame.select(*(F.col(c).cast("bigint").alias(k) for c, k in zip(indices, keys, strict=True)), v.cast("double").alias("x"))
    cells = placed.groupBy(*keys).agg(F.sum("x").alias("x"))
    return Tensor(cells.select(*keys, F.col("x").cast(dtype).alias("v")), tuple(map(int, shape)), dtype, sparse=True, given=placed.select(*keys, F.coalesce("x", F.lit(0.0)).alias("v")) if dtype == "double" else None)


def dense(tensor: Tensor) -> Tensor:
    """The same tensor with a row for each cell."""
    if not tensor.sparse:
        return tensor
    keys = [f"d{k}" for k in range(tensor.order)]
    zero = F.lit(False) if tensor.dtype == "boolean" else F.lit(0).cast(tensor.dtype)
    if not keys:
        return Tensor(tensor.frame.agg(F.coalesce(F.max("v"), zero).alias("v")), (), tensor.dtype)
    grid = coordinates(tensor.frame.sparkSession, tensor.shape)
    return Tensor(grid.join(tensor.frame, keys, "left").select(*keys, F.coalesce("v", zero).alias("v")), tensor.shape, tensor.dtype)


def from_sparse(frame: DataFrame, indices: Sequence[str], value: str | Column, shape: Sequence[int], dtype: str = "double") -> Tensor:
    """A dense tensor from some cells: values of equal cells are added up, cells without a row are 0."""
    return dense(from_cells(frame, indices, value, shape, dtype))


def from_values(spark: SparkSession, values, dtype: str = "double") -> Tensor:
    """A small tensor from nested lists or a numpy array."""
    import numpy as np

    array = np.asarray(values)
    rows = [(*map(int, at), array[at].item()) for at in np.ndindex(array.shape)]
    fields = [*(f"d{k} bigint" for k in range(array.ndim)), f"v {dtype}"]
    cast = {"double": float, "float": float, "boolean": bool}.get(dtype, int)
    return Tensor(spark.createDataFrame([(*r[:-1], cast(r[-1])) for r in rows], ", ".join(fields)), tuple(array.shape), dtype)


def scalar(spark: SparkSession, value: float) -> Tensor:
    """A tensor of order 0."""
    return Tensor(spark.range(1).select(F.lit(float(value)).alias("v")), (), "double")


def coordinates(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """All coordinates of a shape, decoded from one distributed range."""
    total = math.prod(shape)
    cols, stride = [], total
    for k, n in enumerate(shape):
        stride //= max(n, 1)
        cols.append(F.pmod(F.expr(f"id div {max(stride, 1)}"), F.lit(n)).cast("bigint").alias(f"d{k}"))
    return spark.range(total).select(*cols)


def to_numpy(tensor: Tensor):
    """All cells on the driver, for small tensors."""
    import numpy as np

    kind = {"double": float, "float": np.float32, "boolean": bool}.get(tensor.dtype, np.int64)
    out = np.zeros(tensor.shape, kind)
    for r in tensor.frame.collect():
        out[tuple(r[f"d{k}"] for k in range(tensor.order))] = r["v"]
    return out
