"""Structure of programs, expressions, meshes and tensors as tidy DataFrames, ready for any plotting tool."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.lang.syntax import Call, Index, Infix, Negative, Node, Number, Read, Statement
from tessellum.layout.base import Layout
from tessellum.program import Program
from tessellum.tensor import coordinates

COLOURS = ("type", "loops", "opcount")


def program_edges(spark: SparkSession, program: Program) -> DataFrame:
    """(source, target, variable): which statement or input feeds which statement."""
    latest: dict[str, str] = {}
    rows = []
    for i, s in enumerate(program.statements):
        node = f"{i}:{s.output.name}"
        for name in dict.fromkeys(r.name for r in s.reads):
            rows.append((latest.get(name, name), node, name))
        latest[s.output.name] = node
    return spark.createDataFrame(rows, "source string, target string, variable string")


def program_nodes(spark: SparkSession, program: Program, color_by: str = "loops") -> DataFrame:
    """(node, kind, line, level, loops, ops, color): inputs and statements with their layer.

    The layer is the longest path from the inputs.
    """
    if color_by not in COLOURS:
        raise ValueError(f"color_by is one of {', '.join(COLOURS)}, not {color_by!r}")
    level: dict[str, int] = {}
    latest: dict[str, str] = {}
    rows = []
    for name in program.input_variables:
        level[name], latest[name] = 0, name
        rows.append((name, "input", -1, 0, 0, 0))
    for i, s in enumerate(program.statements):
        node = f"{i}:{s.output.name}"
        level[node] = 1 + max((level[latest[r.name]] for r in s.reads), default=0)
        latest[s.output.name] = node
        rows.append((node, "statement", s.line, level[node], s.loop_count, s.op_count))
    frame = spark.createDataFrame(rows, "node string, kind string, line int, level int, loops int, ops int")
    shade = {"type": F.when(F.col("kind") == "input", 0).otherwise(1), "loops": F.col("loops"), "opcount": F.col("ops")}[color_by]
    return frame.withColumn("color", shade.cast("int"))


def expression_nodes(spark: SparkSession, statement: Statement) -> DataFrame:
    """(id, parent, depth, kind, label) of an expression's tree; the root is the assignment."""
    rows = [(0, None, 0, "assign", f"{statement.output} {statement.kind}")]

    def add(node: Node, parent: int, depth: int) -> None:
        own = len(rows)
        kind, label, inner = {
            Number: lambda: ("number", node.text, []),
            Index: lambda: ("index", node.name, []),
            Read: lambda: ("tensor", str(node), []),
            Negative: lambda: ("neg", "neg", [node.inner]),
            Call: lambda: ("function", node.function, [node.inner]),
            Infix: lambda: ("operator", node.operator, [node.left, node.right]),
        }[type(node)]()
        rows.append((own, parent, depth, kind, label))
        for x in inner:
            add(x, own, depth + 1)

    add(statement.expression, 0, 1)
    return spark.createDataFrame(rows, "id int, parent int, depth int, kind string, label string")


def mesh_nodes(spark: SparkSession, mesh: Sequence[int]) -> DataFrame:
    """(rank, m0, m1, ...) of a mesh, row-major."""
    frame = coordinates(spark, mesh)
    names = [f"m{k}" for k in range(len(mesh))]
    rank = F.lit(0).cast("bigint")
    for k, n in enumerate(mesh):
        rank = rank * n + F.col(f"d{k}")
    return frame.select(rank.alias("rank"), *(F.col(f"d{k}").alias(m) for k, m in enumerate(names)))


def mesh_edges(spark: SparkSession, mesh: Sequence[int]) -> DataFrame:
    """(source, target, dim): ranks one apart in one dimension."""
    nodes = mesh_nodes(spark, mesh)
    parts = [nodes.where(F.col(f"m{k}") + 1 < n).select(F.col("rank").alias("source"), (F.col("rank") + math.prod(mesh[k + 1 :])).alias("target"), F.lit(k).alias("dim")) for k, n in enumerate(mesh)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tensor_cells(spark: SparkSession, shape: Sequence[int], highlight: Sequence[int | None] | None = None, layout: Layout | None = None) -> DataFrame:
    """(d0, ..., highlight[, rank]): cells, those marked that match ``highlight`` (None matches all), and owners."""
    frame = layout.processor_view(spark, shape) if layout else coordinates(spark, shape)
    hit = F.lit(highlight is not None)
    for k, i in enumerate(highlight or ()):
        if i is not None:
            hit = hit & (F.col(f"d{k}") == i)
    return frame.withColumn("highlight", hit)


def operation_cells(spark: SparkSession, statement: Statement, sizes: dict[str, int], output: dict[str, int]) -> DataFrame:
    """(tensor, index, highlight): cells of all operands; marked are those read for one output cell.

    ``output`` fixes the output's index variables; the reduced ones run over their sizes.
    """
    rows = []
    for r in (statement.output, *statement.reads):
        dims = [1 if isinstance(s, int) else math.prod(sizes[c] for c in s) for s in r.subscripts]
        for at in itertools.product(*map(range, dims)):
            hit = True
            for s, i in zip(r.subscripts, at, strict=True):
                for c in reversed(s) if isinstance(s, str) else ():
                    i, own = divmod(i, sizes[c])
                    hit = hit and output.get(c, own) == own
            rows.append((str(r), list(at), hit))
    return spark.createDataFrame(rows, "tensor string, index array<int>, highlight boolean")


def mesh_grid(spark: SparkSession, shape: Sequence[int], cell: float = 1.0, gap: float = 0.1) -> DataFrame:
    """(d0, ..., x0, ...): the corner of each cell when cells of size ``cell`` lie ``gap`` apart."""
    return coordinates(spark, shape).select("*", *((F.col(f"d{k}") * (cell + gap)).alias(f"x{k}") for k in range(len(shape))))


def interleaved(frame: DataFrame, order: int) -> DataFrame:
    """Cells of a tensor moved to even coordinates, which leaves a gap between any two."""
    return frame.select(*((F.col(f"d{k}") * 2).alias(f"d{k}") for k in range(order)), *[c for c in frame.columns if c not in {f"d{k}" for k in range(order)}])
