"""What all layouts share: a mesh, ranks, and placement of frames."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.layout.axis import from_linear
from tessellum.tensor import Tensor, coordinates


class Layout(ABC):
    """A rule that gives every cell of a tensor to one or more ranks of a mesh."""

    def __init__(self, mesh: int | Sequence[int]):
        self.mesh = (mesh,) if isinstance(mesh, int) else tuple(mesh)
        if not self.mesh or any(n < 1 for n in self.mesh):
            raise ValueError("the processor mesh is empty")

    @property
    def processors(self) -> int:
        return math.prod(self.mesh)

    def mesh_index(self, rank: int) -> tuple[int, ...]:
        """The mesh coordinates of a rank; ranks are row-major."""
        return from_linear(rank, self.mesh)

    @abstractmethod
    def compatible(self, shape: Sequence[int]) -> bool:
        """Whether a tensor of this shape can be laid out."""

    @abstractmethod
    def ranks(self, shape: Sequence[int], index: Sequence[Column]) -> Column:
        """The owners of a cell, as an array column."""

    @abstractmethod
    def location(self, shape: Sequence[int], index: Sequence[int]) -> list[int]:
        """The owners of one cell."""

    @abstractmethod
    def local_shape(self, shape: Sequence[int], rank: int) -> tuple[int, ...]:
        """The shape of what a rank holds."""

    def max_elements(self, shape: Sequence[int]) -> int:
        """The cells of the rank that holds most, which is the first."""
        return math.prod(self.local_shape(shape, 0))

    def require(self, shape: Sequence[int]) -> None:
        if not self.compatible(shape):
            raise ValueError(f"{self} does not fit shape {tuple(shape)}")

    def place(self, tensor: Tensor) -> DataFrame:
        """The tensor's cells with their rank, one row for each owner, each rank in its own partition."""
        self.require(tensor.shape)
        index = [F.col(f"d{k}") for k in range(tensor.order)]
        placed = tensor.frame.select("*", F.explode(self.ranks(tensor.shape, index)).alias("rank"))
        return by_rank(placed, self.processors)

    def processor_view(self, spark: SparkSession, shape: Sequence[int]) -> DataFrame:
        """(d0, ..., rank): all cells and their owners."""
        self.require(shape)
        index = [F.col(f"d{k}") for k in range(len(shape))]
        return coordinates(spark, shape).select("*", F.explode(self.ranks(shape, index)).alias("rank"))

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))

    def __repr__(self) -> str:
        return str(self)


def by_rank(frame: DataFrame, processors: int) -> DataFrame:
    """Rows in as many partitions as processors, each rank's in the partition of its number."""
    return frame.repartitionById(processors, F.col("rank").cast("int"))
