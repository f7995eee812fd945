"""Products of placed matrices: every rank works on its own cells, partial results are summed over the mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.layout.multi_axis import MultiAxisLayout
from tessellum.operators.lowering import BROADCAST_CELLS
from tessellum.tensor import Tensor


def _sent(vector: Tensor, axis: str, value: str) -> DataFrame:
    """A vector for a join on ``axis``; its size, known from its shape, decides whether it is broadcast."""
    frame = vector.frame.select(F.col("d0").alias(axis), F.col("v").alias(value))
    return F.broadcast(frame) if vector.shape[0] <= BROADCAST_CELLS else frame


def mesh_matvec(matrix: Tensor, vector: Tensor, layout: MultiAxisLayout, transposed: bool = False) -> Tensor:
    """The matrix, or its transpose, times a vector: sums by rank first, then over the ranks of a row or column.

    Cells that several ranks hold are used once.
    """
    kept, summed = ("d1", "d0") if transposed else ("d0", "d1")
    placed = layout.place(matrix).where(layout.one_copy(F.col("rank")))
    local = placed.join(_sent(vector, summed, "x"), summed).groupBy("rank", kept).agg(F.sum(F.col("v") * F.col("x")).alias("part"))
    out = local.groupBy(F.col(kept).alias("d0")).agg(F.sum("part").alias("v"))
    return Tensor(out, (matrix.shape[1 if transposed else 0],))


def mesh_rank_one(matrix: Tensor, left: Tensor, right: Tensor, layout: MultiAxisLayout) -> DataFrame:
    """The placed matrix plus the outer product of two vectors, each rank adding its own part in place."""
    placed = layout.place(matrix).join(_sent(left, "d0", "x"), "d0").join(_sent(right, "d1", "y"), "d1")
    return placed.select("d0", "d1", "rank", (F.col("v") + F.col("x") * F.col("y")).alias("v"))
