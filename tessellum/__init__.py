"""Dense tensor analytics on Spark DataFrames.

Index-notation programs over tensors in coordinate form compile to joins, grouped aggregates and
ordered folds; layouts over a processor mesh, the collectives between them and a planner for
sequences of collectives work on the same frames.
"""

from tessellum.program import Program, compile, evaluate  # noqa: A004
from tessellum.tensor import Tensor, dense, from_array_column, from_cells, from_columns, from_sparse, from_values, scalar, to_numpy

__all__ = ["Program", "Tensor", "compile", "dense", "evaluate", "from_array_column", "from_cells", "from_columns", "from_sparse", "from_values", "scalar", "to_numpy"]
