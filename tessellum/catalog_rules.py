"""Registered queries for structure and rules: programs, layouts, meshes, schedules and pictures over the test tables.

What follows from definitions alone is listed in the SQL; cells, counts and sums come from the tables.
"""

from __future__ import annotations

import itertools
import logging
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tessellum as ts
from tessellum import draw, inspect, logs
from tessellum.catalog import ALPHA, BETA, PROBLEMS, Inputs, _values, _with
from tessellum.functions import scalars
from tessellum.layout import MultiAxisLayout, SlabLayout, TileLayout
from tessellum.layout.axis import axis_compatible
from tessellum.layout.multi_axis import move
from tessellum.layout.simple import to_multi_axis
from tessellum.plans import IdealLowerBounds, NaivePlanner, SearchPlanner, execute_schedule
from tessellum.sources.blocks import read_blocks, write_blocks, write_slice
from tessellum.sources.tables import read_tensor, shared_folder, write_results
from tessellum.tensor import Tensor, coordinates, from_sparse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


M = MultiAxisLayout

#: Layouts of A: for each the rank of a cell in SQL, and what is joined for copies.
_LAYOUTS = [
    (M((2, 2), ((0,), (1,)), (3, 2)), "(d0 // 3) % 2 * 2 + (d1 // 2) % 2", ""),
    (M((2, 3), ((1, 0), ()), 1), "((d0 % 6) % 2) * 3 + (d0 % 6) // 2", ""),
    (M((2, 2), ((0,), ()), 4), "(d0 // 4) % 2 * 2 + c.range", ", range(2) c"),
    (M((3, 1), (None, None), 1), "c.range", ", range(3) c"),
    (SlabLayout(4, 0, 2), "(d0 // 2) % 4", ""),
    (SlabLayout(3, 1, 1).as_multi_axis(2), "d1 % 3", ""),
]
#: Texts as they follow from the definition of a layout's name and formula.
_TEXTS = [
    ("D_[2,2]⊥{0,1}(3,2)", r"$T_{\perp\{ 0,1 \}(3,2)}$", True),
    ("D_[2,3]⊥{(1,0),∅}(1,∅)", r"$T_{\perp\{ (1,0),\emptyset \}(1,\emptyset)}$", True),
    ("D_[2,2]⊥{0,∅}(4,∅)", r"$T_{\perp\{ 0,\emptyset \}(4,\emptyset)}$", True),
    ("D_[3,1]⊥{∅,∅}(∅,∅)", r"$T_{\perp\{ \emptyset,\emptyset \}(\emptyset,\emptyset)}$", False),
    ("D_[4]⊥0(2)", r"T_{\perp\{ 0 \}(2)}", True),
    ("D_[3]⊥{∅,0}(∅,1)", r"$T_{\perp\{ \emptyset,0 \}(\emptyset,1)}$", True),
]


def _layout_sql() -> str:
    """The largest number of cells of a rank, counted, for each layout."""
    parts = []
    for (layout, rank, spare), (text, formula, dealt) in zip(_LAYOUTS, _TEXTS, strict=True):
        counted = f"(SELECT {rank} AS rank, COUNT(*) AS n, SUM(v) AS v FROM A{spare} GROUP BY 1)"
        parts.append(f"SELECT '{text}' AS layout, '{formula}' AS formula, {str(dealt).lower()} AS distributed, {layout.processors} AS processors, MAX(n) AS most, MAX(n) AS promised, SUM(v) AS total FROM {counted}")
    return _with("A", " UNION ALL ".join(parts))


@query("layout_rules", _layout_sql())
def layout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of layouts, the cells of the fullest rank as counted on placed rows and as promised, and all that is held."""
    tensor, out = Inputs(spark, sf_dir).A(), None
    for layout, _, _ in _LAYOUTS:
        held = layout.place(tensor).groupBy("rank").agg(F.count("*").alias("n"), F.sum("v").alias("v")).agg(F.max("n").alias("most"), F.sum("v").alias("total"))
        distributed = layout.distributed if isinstance(layout, M) else True
        row = held.select(F.lit(str(layout)).alias("layout"), F.lit(layout.latex()).alias("formula"), F.lit(distributed).alias("distributed"), F.lit(layout.processors).alias("processors"), "most", F.lit(layout.max_elements(tensor.shape)).cast("bigint").alias("promised"), "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("axis_rules", "SELECT p.range AS procs, b.range AS block, n >= p.range AND b.range <= CASE WHEN p.range = 1 THEN n ELSE GREATEST(1, (n - 1) // (p.range - 1)) END AS fits FROM (SELECT COUNT(*) AS n FROM supplier), range(1, 33) p, range(0, 40) b")
def axis_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which blocks the supplier axis can be dealt in."""
    n = Inputs(spark, sf_dir).size("supplier", "s_suppkey")
    rows = [(p, b, axis_compatible(n, b, p)) for p in range(1, 33) for b in range(40)]
    return spark.createDataFrame(rows, "procs long, block long, fits boolean")


#: A program over the sales of suppliers, with comments and an empty line.
_SALES = """
# quantities by supplier, and what is far above the lines sold
Total[i] += A[i,j]
Lines[i] += N[i,j]   # of any quantity

Mixed[i,j] = (A[i,j] * 2) - N[i,j]
Large[i] += (Mixed[i,j] > 20) * Mixed[i,j]
"""
_SALES_SQL = _with(
    "AN",
    ", X AS (SELECT a.d0, a.d1, a.v * 2 - n.v AS v FROM A a JOIN N n ON a.d0 = n.d0 AND a.d1 = n.d1), "
    "sums AS (SELECT 'A' AS name, (SELECT COUNT(*) FROM A) AS cells, (SELECT SUM(v) FROM A) AS total UNION ALL SELECT 'N', (SELECT COUNT(*) FROM N), (SELECT SUM(v) FROM N) UNION ALL "
    "SELECT 'Total', (SELECT COUNT(DISTINCT d0) FROM A), (SELECT SUM(v) FROM A) UNION ALL SELECT 'Lines', (SELECT COUNT(DISTINCT d0) FROM N), (SELECT SUM(v) FROM N) UNION ALL "
    "SELECT 'Mixed', (SELECT COUNT(*) FROM X), (SELECT SUM(v) FROM X) UNION ALL SELECT 'Large', (SELECT COUNT(DISTINCT d0) FROM X), (SELECT SUM(CASE WHEN v > 20 THEN v ELSE 0 END) FROM X)) ",
).replace(") , X", "), X")


def _sales(spark: SparkSession, sf_dir: str) -> tuple[ts.Program, DataFrame]:
    """The program, and (name, cells, total) of all its tensors."""
    made, program, out = Inputs(spark, sf_dir), ts.compile(_SALES), None
    for name, t in program.execute({"A": made.A(), "N": made.N()}, None, spark).items():
        row = t.frame.agg(F.count("*").alias("cells"), F.sum("v").alias("total")).select(F.lit(name).alias("name"), "cells", "total")
        out = row if out is None else out.unionByName(row)
    return program, out


@query("statement_stats", _SALES_SQL + "SELECT line, raw, loops, ops, cells, total FROM (" + _values("line:INT raw loops:INT ops:INT name", (3, "Total[i] += A[i,j]", 2, 0, "Total"), (4, "Lines[i] += N[i,j]", 2, 0, "Lines"), (6, "Mixed[i,j] = (A[i,j] * 2) - N[i,j]", 2, 2, "Mixed"), (7, "Large[i] += (Mixed[i,j] > 20) * Mixed[i,j]", 2, 2, "Large")) + ") JOIN sums USING (name)")
def statement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with their loops and operations, and what they made of the tables."""
    program, sums = _sales(spark, sf_dir)
    named = program.statement_stats(spark).withColumn("name", F.regexp_extract("raw", r"^\w+", 0))
    return named.join(sums, "name").select("line", "raw", "loops", "ops", "cells", "total")


@query("variable_usage", _SALES_SQL + "SELECT name, \"order\", lines, cells, total FROM (" + _values("name order:INT lines", ("A", 2, "-1,3,6"), ("N", 2, "-1,4,6"), ("Total", 1, "3"), ("Lines", 1, "4"), ("Mixed", 2, "6,7"), ("Large", 1, "7")) + ") JOIN sums USING (name)")
def variable_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors with the lines that use them, their cells and sums."""
    program, sums = _sales(spark, sf_dir)
    used = program.variable_usage(spark).withColumn("lines", F.concat_ws(",", F.transform("lines", lambda x: x.cast("string"))))
    return used.join(sums, "name").select("name", "order", "lines", "cells", "total")


@query("program_facts", _SALES_SQL + "SELECT 'A,N' AS inputs, CAST(2 AS INT) AS loops, CAST(3 AS INT) AS loops_line, CAST(2 AS INT) AS ops, CAST(6 AS INT) AS ops_line, 'i,j' AS letters, SUM(total) AS total FROM sums")
def program_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs, the deepest loop, the most operations and the index variables of the sales program, with the sum of all it made."""
    program, sums = _sales(spark, sf_dir)
    (loops, at), (ops, where) = program.max_loop_depth, program.max_op_count
    facts = {"inputs": ",".join(program.input_variables), "loops": loops, "loops_line": at, "ops": ops, "ops_line": where, "letters": ",".join(program.statements[-1].index_variables)}
    return sums.agg(F.sum("total").alias("total")).select(*(F.lit(v).alias(k) for k, v in facts.items()), "total")


@query("program_nodes", _SALES_SQL + "SELECT node, kind, line, level, loops, ops, color, total FROM (" + _values("node kind line:INT level:INT loops:INT ops:INT color:INT name", ("A", "input", -1, 0, 0, 0, 0, "A"), ("N", "input", -1, 0, 0, 0, 0, "N"), ("0:Total", "statement", 3, 1, 2, 0, 0, "Total"), ("1:Lines", "statement", 4, 1, 2, 0, 0, "Lines"), ("2:Mixed", "statement", 6, 1, 2, 2, 2, "Mixed"), ("3:Large", "statement", 7, 2, 2, 2, 2, "Large")) + ") JOIN sums USING (name)")
def program_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The program's graph: inputs and statements by layer, with what each holds."""
    program, sums = _sales(spark, sf_dir)
    nodes = inspect.program_nodes(spark, program, "opcount").withColumn("name", F.regexp_extract("node", r"\w+$", 0))
    return nodes.join(sums, "name").select("node", "kind", "line", "level", "loops", "ops", "color", "total")


@query("program_edges", _SALES_SQL + "SELECT source, target, name AS variable, total FROM (" + _values("source target name", ("A", "0:Total", "A"), ("N", "1:Lines", "N"), ("A", "2:Mixed", "A"), ("N", "2:Mixed", "N"), ("2:Mixed", "3:Large", "Mixed")) + ") JOIN sums USING (name)")
def program_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which result feeds which statement, with what flows there."""
    program, sums = _sales(spark, sf_dir)
    return inspect.program_edges(spark, program).withColumnRenamed("variable", "name").join(sums, "name").select("source", "target", F.col("name").alias("variable"), "total")


@query("expression_nodes", _SALES_SQL + "SELECT id, parent, depth, kind, label, total FROM (" + _values("id:INT parent:INT depth:INT kind label name", (0, None, 0, "assign", "Large[i] +=", "Large"), (1, 0, 1, "operator", "*", ""), (2, 1, 2, "operator", ">", ""), (3, 2, 3, "tensor", "Mixed[i,j]", "Mixed"), (4, 2, 3, "number", "20", ""), (5, 1, 2, "tensor", "Mixed[i,j]", "Mixed")) + ") LEFT JOIN sums USING (name)")
def expression_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression's tree, with the sums of its tensors."""
    program, sums = _sales(spark, sf_dir)
    nodes = inspect.expression_nodes(spark, program.statements[3]).withColumn("name", F.regexp_extract("label", r"^[A-Z]\w*", 0))
    return nodes.join(sums, "name", "left").select("id", "parent", "depth", "kind", "label", "total")


#: Programs over A and P of n suppliers: right ones with the sum of their result in SQL, wrong ones without.
_ATTEMPTS = [
    ("the last row", "R[j] = A[{last},j]", "(SELECT SUM(v) FROM A WHERE d0 = (SELECT MAX(d0) FROM A))"),
    ("a row beyond the last", "R[j] = A[{n},j]", None),
    ("the last column", "R[i] = A[i,6]", "(SELECT SUM(v) FROM A WHERE d1 = 6)"),
    ("a column beyond the last", "R[i] = A[i,7]", None),
    ("an index along both axes", "R[i] = A[i,i]", None),
    ("an index of two sizes", "R[i,j] = A[i,j] + P[j]", None),
    ("one subscript too few", "R[i] = A[i]", None),
    ("a tensor that nobody gave", "R[i] = P[i] + Q[i]", None),
    ("a name with two orders", "R[i] = P[i]\nR[i,j] = R[i,j] + A[i,j]", None),
    ("an index that nothing sizes", "R[k] = k", None),
    ("a transposed read of the output", "A[i,j] = A[j,i] + P[i]", None),
    ("a loop over what is written", "R[i] = P[i] * 0\nR[i] = R[i] + P[i]", "(SELECT SUM(v) FROM P)"),
    ("no operator", "R[i] = P[i] P[i]", None),
    ("a function that nobody knows", "R[i] = half(P[i])", None),
    ("a comment behind", "R[i] = P[i] # all of it", "(SELECT SUM(v) FROM P)"),
]


@query("program_errors", _with("AP", " UNION ALL ".join(f"SELECT '{name}' AS attempt, '{'accepted' if sql else 'ValueError'}' AS outcome, {sql or 'CAST(NULL AS DOUBLE)'} AS total" for name, _, sql in _ATTEMPTS)))
def program_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right and wrong programs over the tables' own sizes: what is refused, and what right ones sum to."""
    made, out = Inputs(spark, sf_dir), None
    given = {"A": made.A(), "P": made.P()}
    for name, code, _ in _ATTEMPTS:
        try:
            results = ts.compile(code.format(n=given["A"].shape[0], last=given["A"].shape[0] - 1)).execute(given, None, spark)
            row = results["R"].frame.agg(F.sum("v").alias("total")).select(F.lit(name).alias("attempt"), F.lit("accepted").alias("outcome"), "total")
        except ValueError as e:
            row = spark.range(1).select(F.lit(name).alias("attempt"), F.lit(type(e).__name__).alias("outcome"), F.lit(None).cast("double").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query("converted_layout", _with("D", "SELECT d0, d1, CAST(d0 % 5 AS INT) AS rank, v FROM D"))
def converted_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt in tiles, then along one axis by the layout that tiles convert to, which leaves them where they are."""
    tensor = Inputs(spark, sf_dir).D()
    tiles = TileLayout(5, 1)
    return to_multi_axis(tiles, tensor.shape).place(tensor).select("d0", "d1", "rank", "v")


# Meshes with what their ranks hold of A, and pictures of small tensors of the tables.

_ON_MESH = "(SELECT (d0 // 3) % 2 * 2 + (d1 // 2) % 2 AS rank, COUNT(*) AS cells, SUM(v) AS total FROM A GROUP BY 1)"


def _loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = M((2, 2), ((0,), (1,)), (3, 2)).place(Inputs(spark, sf_dir).A())
    return placed.groupBy(F.col("rank").cast("bigint").alias("rank")).agg(F.count("*").alias("cells"), F.sum("v").alias("total"))


@query("mesh_nodes", _with("A", f"SELECT rank, rank // 2 AS m0, rank % 2 AS m1, cells, total FROM {_ON_MESH}"))
def mesh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processors of a mesh with the cells and quantities that they hold."""
    return inspect.mesh_nodes(spark, (2, 2)).join(_loads(spark, sf_dir), "rank")


@query("mesh_edges", _with("A", f"SELECT e.s AS source, e.t AS target, CAST(e.d AS INT) AS dim, a.cells + b.cells AS cells FROM (VALUES (0, 2, 0), (1, 3, 0), (0, 1, 1), (2, 3, 1)) e(s, t, d) JOIN {_ON_MESH} a ON a.rank = e.s JOIN {_ON_MESH} b ON b.rank = e.t").replace("e.s AS source, e.t AS target", "CAST(e.s AS BIGINT) AS source, CAST(e.t AS BIGINT) AS target"))
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a mesh with the cells at both ends."""
    held = _loads(spark, sf_dir)
    ends = [held.select(F.col("rank").alias(n), F.col("cells").alias(c)) for n, c in (("source", "x"), ("target", "y"))]
    return inspect.mesh_edges(spark, (2, 2)).join(ends[0], "source").join(ends[1], "target").select("source", "target", "dim", (F.col("x") + F.col("y")).alias("cells"))


@query("mesh_grid", _with("A", "SELECT d0, d1, d0 * 1.1::DOUBLE AS x0, d1 * 1.1::DOUBLE AS x1, v FROM A"))
def mesh_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of A's cells in a picture, with their values."""
    tensor = Inputs(spark, sf_dir).A()
    return inspect.mesh_grid(spark, tensor.shape).join(tensor.frame, ["d0", "d1"])


def _cube(spark: SparkSession, sf_dir: str) -> Tensor:
    """Lines by line number modulo 3, tens of quantity and parity of the supplier."""
    lines = Inputs(spark, sf_dir).read("lineitem").select((F.col("l_linenumber") % 3).alias("a"), F.expr("cast(l_quantity - 1 as int) div 10").alias("b"), (F.col("l_suppkey") % 2).alias("c"))
    return from_sparse(lines, ["a", "b", "c"], F.lit(1.0), (3, 5, 2))


_CUBE = "(SELECT a.range AS d0, b.range AS d1, c.range AS d2, CAST(COALESCE(n, 0) AS DOUBLE) AS v FROM range(3) a CROSS JOIN range(5) b CROSS JOIN range(2) c LEFT JOIN (SELECT l_linenumber % 3 AS x, (CAST(l_quantity AS INT) - 1) // 10 AS y, l_suppkey % 2 AS z, COUNT(*) AS n FROM lineitem GROUP BY ALL) q ON q.x = a.range AND q.y = b.range AND q.z = c.range)"


@query("tensor_cells_cube", f"SELECT d0, d1, d2, d1 = 1 AS highlight, CAST(d0 % 2 * 2 + d2 % 2 AS INT) AS rank, v FROM {_CUBE}")
def tensor_cells_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a cube with one plane marked, their ranks on a 2 by 2 mesh, and their counts."""
    cube = _cube(spark, sf_dir)
    cells = inspect.tensor_cells(spark, cube.shape, (None, 1, None), M((2, 2), ((0,), None, (1,)), 1))
    return cells.join(cube.frame, ["d0", "d1", "d2"]).select("d0", "d1", "d2", "highlight", F.col("rank").cast("int").alias("rank"), "v")


@query("projected_cells", f"SELECT d0, d1, d2, v, round(d0 * cos(radians(30)) - d1 * sin(radians(30)), 9) AS x, round(d2 * cos(radians(20)) - (d0 * sin(radians(30)) + d1 * cos(radians(30))) * sin(radians(20)), 9) AS y FROM {_CUBE}")
def projected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a cube's cells in a picture, with their counts."""
    return draw.projected(_cube(spark, sf_dir).frame).select("d0", "d1", "d2", "v", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("operation_cells", _with("TH", "SELECT 'B[i,j]' AS tensor, d0 AS i0, d1 AS i1, d0 = 1 AND d1 = 2 AS highlight, (SELECT SUM(x.v * y.v) FROM T x JOIN T y ON x.d1 = y.d0 WHERE x.d0 = T.d0 AND y.d1 = T.d1) AS v FROM T UNION ALL SELECT 'T[i,k]', d0, d1, d0 = 1, v FROM T UNION ALL SELECT 'T[k,j]', d0, d1, d1 = 2, v FROM T"))
def operation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a product's operands, those marked that one output cell is made of, with their values."""
    program = ts.compile("B[i,j] += T[i,k] * T[k,j]")
    made = program.execute({"T": Inputs(spark, sf_dir).T()}, None, spark)
    cells = inspect.operation_cells(spark, program.statements[0], {"i": 5, "j": 5, "k": 5}, {"i": 1, "j": 2})
    placed = cells.select("tensor", F.col("index")[0].cast("bigint").alias("i0"), F.col("index")[1].cast("bigint").alias("i1"), "highlight", F.substring("tensor", 1, 1).alias("name"))
    values = made["B"].frame.withColumn("name", F.lit("B")).unionByName(made["T"].frame.withColumn("name", F.lit("T")))
    return placed.join(values.select("name", F.col("d0").alias("i0"), F.col("d1").alias("i1"), "v"), ["name", "i0", "i1"]).select("tensor", "i0", "i1", "highlight", "v")


@query("log_lines", _with("A", "SELECT CAST(0 AS BIGINT) AS number, 'INFO' AS level, 'A has ' || COUNT(*) || ' cells' AS message FROM A UNION ALL SELECT 1, 'WARNING', COUNT(*) FILTER (v = 0) || ' of them are 0' FROM A"))
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a logger at level INFO writes of A to its file; the file is the driver's own."""
    found = Inputs(spark, sf_dir).A().frame.agg(F.count("*").alias("cells"), F.count_if(F.col("v") == 0).alias("zeros")).first()
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "log"
        before = list(logs.LOGGER.handlers), logs.LOGGER.level, logs.LOGGER.propagate
        logs.LOGGER.handlers = []
        logger = logs.set_logger_config(logging.INFO, str(path), log_to_stdout=False)
        logger.debug("not shown")
        logger.info("A has %d cells", found["cells"])
        logger.warning("%d of them are 0", found["zeros"])
        for handler in logger.handlers:
            handler.close()
        logger.handlers, logger.level, logger.propagate = before
        lines = [line.split(" tessellum: ") for line in path.read_text().splitlines()]
    return spark.createDataFrame([(i, head.split()[-1], message) for i, (head, message) in enumerate(lines)], "number long, level string, message string")


@query("stored_results", _with("A", "SELECT 'B' AS tensor, d0, SUM(v + 1) AS v FROM A GROUP BY 2 UNION ALL SELECT 'Total', CAST(0 AS BIGINT), SUM(v + 1) FROM A"))
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tensors of a program, written to the shared folder and read again; summed over lines."""
    program = ts.compile("B[i,j] = A[i,j] + 1\nTotal += B[i,j]")
    path = shared_folder(spark)
    write_results(program.execute({"A": Inputs(spark, sf_dir).A()}, None, spark), path)
    b, total = (read_tensor(spark, f"{path}/{n}") for n in ("B", "Total"))
    sums = b.frame.groupBy("d0").agg(F.sum("v").alias("v"))
    return sums.select(F.lit("B").alias("tensor"), "d0", "v").unionByName(total.frame.select(F.lit("Total").alias("tensor"), F.lit(0).cast("bigint").alias("d0"), "v"))


@query("stored_slice", _with("D", "SELECT d1 AS d0, v FROM D WHERE d0 = 1234"))
def stored_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of the quantities by order and line, stored in blocks; only files that hold it are read."""
    path = shared_folder(spark)
    write_blocks(Inputs(spark, sf_dir).D(), path, (64, 7), 4096)
    return ts.compile("R[j] = D[1234,j]").execute({"D": read_blocks(spark, path)}, None, spark)["R"].frame


@query("stored_slice_write", _with("DH", "SELECT D.d0, D.d1, CASE WHEN D.d0 = 1234 THEN H.v ELSE D.v END AS v FROM D JOIN H ON H.d0 = D.d1 AND H.d1 = 0"))
def stored_slice_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of a stored tensor replaced; files without it stay as they are."""
    made, path = Inputs(spark, sf_dir), shared_folder(spark)
    write_blocks(made.D(), path, (64, 7), 4096)
    first = ts.compile("R[j] = H[j,0]").execute({"H": made.H()}, None, spark)["R"]
    write_slice(first, path, {0: 1234})
    return read_blocks(spark, path).frame


@query("single_statement", _with("AP", "SELECT p.d0, p.v + SUM(a.v) AS v FROM P p JOIN A a ON a.d0 = p.d0 GROUP BY p.d0, p.v"))
def single_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement that goes on from a supplied output."""
    made = Inputs(spark, sf_dir)
    return ts.evaluate("P[i] += A[i,j]", {"P": made.P(), "A": made.A()}, None, spark).frame


@query("single_statement_product", _with("TP", "SELECT t.d0, t.d1, t.v / 8.0 AS v FROM T t"))
def single_statement_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A division onto a supplied output, by the product over an index that only the divisor has."""
    made = Inputs(spark, sf_dir)
    twos = Tensor(coordinates(spark, (3,)).withColumn("v", F.lit(2.0)), (3,))
    return ts.evaluate("T[i,j] /= Two[k]", {"T": made.T(), "Two": twos}, None, spark).frame


@query("registered_function", _with("T", "SELECT d0, d1, v * v * v + 1 AS v FROM T"))
def registered_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the user's own."""
    scalars.register("cube", lambda x: x * x * x)
    try:
        return ts.compile("R[i,j] = cube(T[i,j]) + 1").execute({"T": Inputs(spark, sf_dir).T()}, None, spark)["R"].frame
    finally:
        del scalars.UNARY["cube"]


_HEADS = """
Wq[h,m,l] = sin((h * 7) + (m * 3) + (l * 5)) / 4
Wk[h,m,l] = sin((h * 5) + (m * 2) + (l * 3)) / 4
Wv[h,m,l] = sin((h * 3) + (m * 5) + (l * 2)) / 4
Wo[l,m] = sin((l * 2) + (m * 7)) / 4
Q[i,h,k,l] += X[i,k,m] * Wq[h,m,l]
K[i,h,k,l] += X[i,k,m] * Wk[h,m,l]
V[i,h,k,l] += X[i,k,m] * Wv[h,m,l]
Scores[i,h,k,m] += (Q[i,h,k,l] * K[i,h,m,l]) / Root
Denom[i,h,k] += exp(Scores[i,h,k,m])
Soft[i,h,k,m] = exp(Scores[i,h,k,m]) / Denom[i,h,k]
Atte[i,k,(hl)] += Soft[i,h,k,m] * V[i,h,m,l]
Z[i,k,l] += Atte[i,k,m] * Wo[l,m]
"""


def _weights(name: str, a: int, b: int, c: int) -> str:
    return f"{name} AS (SELECT h.range AS h, m.range AS m, l.range AS l, sin((h.range * {a}) + (m.range * {b}) + (l.range * {c})) / 4 AS v FROM range(8) h, range(64) m, range(8) l)"


def _projected(name: str, w: str) -> str:
    return f"{name} AS (SELECT x.i, w.h, x.k, w.l, SUM(x.v * w.v) AS v FROM X x JOIN {w} w ON x.m = w.m GROUP BY ALL)"


@query(
    "multi_head_attention",
    "WITH X AS (SELECT vec_id // 5 AS i, vec_id % 5 AS k, p - 1 AS m, round(CAST(x AS DOUBLE) * 1000) / 1000 AS v FROM (SELECT vec_id, unnest(range(1, 65)) AS p, unnest(embedding) AS x FROM embeddings WHERE vec_id < 15)), "
    + ", ".join([_weights("wq", 7, 3, 5), _weights("wk", 5, 2, 3), _weights("wv", 3, 5, 2), _projected("Q", "wq"), _projected("K", "wk"), _projected("V", "wv")])
    + ", E AS (SELECT q.i, q.h, q.k, t.k AS m, exp(SUM(q.v * t.v) / sqrt(8)) AS v FROM Q q JOIN K t ON q.i = t.i AND q.h = t.h AND q.l = t.l GROUP BY ALL)"
    ", Soft AS (SELECT i, h, k, m, v / SUM(v) OVER (PARTITION BY i, h, k) AS v FROM E)"
    ", Atte AS (SELECT s.i, s.k, s.h * 8 + t.l AS m, SUM(s.v * t.v) AS v FROM Soft s JOIN V t ON s.i = t.i AND s.h = t.h AND s.m = t.k GROUP BY ALL)"
    " SELECT a.i AS d0, a.k AS d1, o.range AS d2, round(SUM(a.v * sin((o.range * 2) + (a.m * 7)) / 4), 6) AS v FROM Atte a, range(64) o GROUP BY ALL",
)
def multi_head_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention with 8 heads over 3 batches of 5 vectors of 64."""
    whole = Inputs(spark, sf_dir).read("embeddings").where("vec_id < 15").select((F.col("vec_id") % 5).alias("k"), F.expr("vec_id div 5").alias("i"), F.posexplode(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000) / 1000)).alias("m", "x"))
    x = from_sparse(whole, ["i", "k", "m"], "x", (3, 5, 64))
    hints = {"Wq": (8, 64, 8), "Wk": (8, 64, 8), "Wv": (8, 64, 8), "Wo": (64, 64)}
    z = ts.compile(_HEADS).execute({"X": x, "Root": ts.scalar(spark, 8**0.5)}, hints, spark)["Z"]
    return z.frame.select("d0", "d1", "d2", F.round("v", 6).alias("v"))


_STEP = """
W[i] += M[i,j] * D[j]
Gamma += G[i] * G[i]
Theta += D[i] * W[i]
Alpha = Gamma / Theta
X[i] = X[i] + (Alpha * D[i])
G[i] = G[i] - (Alpha * W[i])
Left += G[i] * G[i]
Beta = Left / Gamma
D[i] = G[i] + (Beta * D[i])
"""


@query("conjugate_gradient", "SELECT range AS d0, CAST(1 + range AS DOUBLE) AS v FROM range(5)")
def conjugate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run on a positive definite 5 by 5 system whose solution is 1, 2, ..., 5."""
    setup = ts.compile("S[i,j] += T[k,i] * T[k,j]\nPeak += S[i,j]\nM[i,j] = (S[i,j] / Peak) + (i == j)\nOne[i] = i + 1\nG[i] += M[i,j] * One[j]\nD[i] = G[i]\nX[i] = 0")
    made = setup.execute({"T": Inputs(spark, sf_dir).T()}, {"One": (5,), "X": (5,)}, spark)
    found = ts.compile(_STEP).iterate({n: made[n] for n in ("M", "G", "D", "X")}, 5, ("X", "G", "D"), spark=spark)["X"]
    return found.frame.select("d0", F.round("v", 6).alias("v"))


@query("drawn_shapes", "SELECT 'matrix' AS picture, (SELECT COUNT(*) FROM (SELECT DISTINCT n_regionkey FROM nation) CROSS JOIN (SELECT DISTINCT n_nationkey % 5 FROM nation)) AS squares, 0::BIGINT AS circles, 0::BIGINT AS lines UNION ALL SELECT 'cube', 30, 0, 0 UNION ALL SELECT 'program', 0, 6, 5 UNION ALL SELECT 'mesh', 0, 4, 4")
def drawn_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shapes pictures of a matrix, a cube, a program and a mesh have."""
    program, sums = _sales(spark, sf_dir)
    shape = Inputs(spark, sf_dir).T().shape
    nodes = inspect.program_nodes(spark, program, "opcount").withColumn("name", F.regexp_extract("node", r"\w+$", 0)).join(sums, "name")
    mesh = inspect.mesh_nodes(spark, (2, 2)).join(_loads(spark, sf_dir), "rank").withColumn("level", F.col("m0").cast("int"))
    drawn = {
        "matrix": draw.cells_svg(inspect.tensor_cells(spark, shape, (1, None), M((2,), ((0,), None), 1))),
        "cube": draw.cells_svg(_cube(spark, sf_dir).frame),
        "program": draw.graph_svg(nodes, inspect.program_edges(spark, program)),
        "mesh": draw.graph_svg(mesh, inspect.mesh_edges(spark, (2, 2)), node="rank"),
    }
    return spark.createDataFrame([(k, *(svg.count(f"<{kind} ") for kind in ("rect", "circle", "line"))) for k, svg in drawn.items()], "picture string, squares long, circles long, lines long")


# Schedules found by planners, run on the rows of A.

_START, _TARGET = M((2, 2), ((0,), (1,)), (3, 2)), M((2, 2), ((1, 0), None), 1)
_AT_TARGET = "SELECT d0, d1, CAST((d0 % 4) % 2 * 2 + (d0 % 4) // 2 AS INT) AS rank, v FROM A"


def _scheduled(spark: SparkSession, sf_dir: str, planner) -> DataFrame:
    tensor = Inputs(spark, sf_dir).A()
    steps = planner.plan(tensor.shape, _START, _TARGET)[0]
    return execute_schedule(_START.place(tensor), tensor.shape, steps).select("d0", "d1", "rank", "v")


@query("naive_schedule", _with("A", _AT_TARGET))
def naive_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A's rows after everything was gathered and dealt anew."""
    return _scheduled(spark, sf_dir, NaivePlanner(IdealLowerBounds(), ALPHA, BETA))


@query("search_schedule", _with("A", _AT_TARGET))
def search_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A's rows after the cheapest schedule that the search finds."""
    return _scheduled(spark, sf_dir, SearchPlanner(IdealLowerBounds(), ALPHA, BETA, path_weight=1.02, max_depth=6, top_k=15))


@query("planner_rules", _with("A", _AT_TARGET))
def planner_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A's rows after a schedule on which no rank ever holds more than twice what the ends need."""
    skip = lambda shape, a, b, x: x.max_elements(shape) > 2 * max(a.max_elements(shape), b.max_elements(shape))
    return _scheduled(spark, sf_dir, SearchPlanner(IdealLowerBounds(), ALPHA, BETA, max_depth=6, top_k=5, skip=skip))


@query("planner_grid", _with("A", f"SELECT CAST(w.w AS DOUBLE) AS path_weight, CAST(k.k AS INT) AS top_k, rank, COUNT(*) AS cells, SUM(v) AS total FROM ({_AT_TARGET}) CROSS JOIN (VALUES (0.5), (2.0)) w(w) CROSS JOIN (VALUES (1), (15)) k(k) GROUP BY ALL"))
def planner_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ranks hold of A after the schedules that other settings of the search find."""
    out = None
    for weight, top in itertools.product((0.5, 2.0), (1, 15)):
        placed = _scheduled(spark, sf_dir, SearchPlanner(IdealLowerBounds(), ALPHA, BETA, path_weight=weight, max_depth=6, top_k=top))
        row = placed.groupBy("rank").agg(F.count("*").alias("cells"), F.sum("v").alias("total")).select(F.lit(weight).alias("path_weight"), F.lit(top).alias("top_k"), "rank", "cells", "total")
        out = row if out is None else out.unionByName(row)
    return out


#: One collective away from a slab of rows in blocks of 2 on a 2 by 2 mesh: the layout, the rank of a cell, its copies.
_AWAY = [
    ("allgather_*", "D_[2,2]⊥{∅,∅}(∅,∅)", 4),
    ("allgather_0", "D_[2,2]⊥{∅,∅}(∅,∅)", 4),
    ("alltoall_0_1_-1", "D_[2,2]⊥{∅,0}(∅,2)", 2),
    ("alltoall_0_1_1", "D_[2,2]⊥{∅,0}(∅,1)", 2),
    ("reblock_0_1", "D_[2,2]⊥{0,∅}(1,∅)", 2),
    ("split_0_1_1", "D_[2,2]⊥{(1,0),∅}(2,∅)", 1),
    ("split_minor_0_1_1", "D_[2,2]⊥{(0,1),∅}(1,∅)", 1),
    ("split_1_1_1", "D_[2,2]⊥{0,1}(2,1)", 1),
    ("split_minor_1_1_1", "D_[2,2]⊥{0,1}(2,1)", 1),
]


@query("neighbours", _with("A", "SELECT op, layout, COUNT(*) * MAX(copies) AS cells, SUM(v) * MAX(copies) AS total FROM A CROSS JOIN (" + _values("op layout copies:BIGINT", *_AWAY) + ") GROUP BY 1, 2").replace("COUNT(*) * MAX(copies) AS cells", "CAST(COUNT(*) * MAX(copies) AS BIGINT) AS cells"))
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All layouts one collective away from a slab of A's rows, with what all ranks hold after the rows have moved."""
    tensor, start, out = Inputs(spark, sf_dir).A(), M((2, 2), ((0,), ()), 2), None
    placed = start.place(tensor)
    for op, layout, _, _ in start.neighbours(tensor.shape):
        held = move(placed, tensor.shape, start, layout).agg(F.count("*").alias("cells"), F.sum("v").alias("total"))
        row = held.select(F.lit(op).alias("op"), F.lit(str(layout)).alias("layout"), "cells", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("naive_plan_cost", "SELECT CAST(problem AS INT) AS problem, round(CAST(ceil(log2(p)) AS DOUBLE) * 1e-6 + (p - 1) * n / p * 3.2e-10, 9) AS cost FROM (SELECT * FROM (VALUES (1, 8.0::DOUBLE, 5.12e9), (2, 32.0::DOUBLE, 1.28e9), (3, 8.0::DOUBLE, 1.0e9)) t(problem, p, n) UNION ALL SELECT 0, 4.0, CAST(most * 4 AS DOUBLE) FROM (" + _with("D", "SELECT MAX(n) AS most FROM (SELECT (d0 // 3) % 2 * 2 + (d1 // 2) % 2 AS r, COUNT(*) AS n FROM D GROUP BY 1)") + "))")
def naive_plan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gather and split, for the three problems, and for the quantities by order and line as placed."""
    planner, tensor = NaivePlanner(IdealLowerBounds(), ALPHA, BETA), Inputs(spark, sf_dir).D()
    most = _START.place(tensor).groupBy("rank").count().agg(F.max("count").alias("most")).first()["most"]
    assert most == _START.max_elements(tensor.shape)
    costs = [(0, planner.plan(tensor.shape, _START, _TARGET)[1]), *((k, planner.plan(*p)[1]) for k, p in PROBLEMS.items())]
    return spark.createDataFrame([(k, round(c, 9)) for k, c in costs], "problem int, cost double")
