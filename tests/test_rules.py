"""Rules of layouts, planners and programs: what each expression gives, as text."""

from __future__ import annotations

from collections.abc import Callable

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import tessellum as ts
from tessellum.catalog_rules import ALPHA, BETA, PROBLEMS
from tessellum.layout import MultiAxisLayout, SlabLayout, TileLayout
from tessellum.layout.axis import axis_compatible, order_name
from tessellum.plans import NaivePlanner, SearchPlanner
from tessellum.plans.planner import edit_distance, find_routes
from tessellum.tensor import Tensor, coordinates


def _error(f: Callable[[], object]) -> Callable[[], str]:
    def run() -> str:
        try:
            return f"accepted: {f()}"
        except (ValueError, NotImplementedError) as e:
            return type(e).__name__

    return run


M = MultiAxisLayout
LAYOUTS = [
    ("row-major order in array libraries", lambda: order_name("R"), "C"),
    ("column-major order in array libraries", lambda: order_name("C"), "F"),
    ("20 cells in blocks of 5 over 4 ranks fit", lambda: axis_compatible(20, 5, 4), "True"),
    ("20 cells in blocks of 20 over 2 ranks fit", lambda: axis_compatible(20, 20, 2), "False"),
    ("rank 17 of a 2 by 3 by 4 mesh", lambda: M((2, 3, 4), ((0,),), 1).mesh_index(17), "(1, 1, 1)"),
    ("processors of a slab over a mesh of 2 by 3", lambda: SlabLayout((2, 3)).processors, "6"),
    ("processors of a 2 by 3 by 4 mesh", lambda: M((2, 3, 4), ((0,),), 1).processors, "24"),
    ("layouts with the same mapping and blocks are equal", lambda: M((3, 3), ((0, 1), ()), (1, None)) == M((3, 3), ((0, 1), None), 1), "True"),
    ("layouts with other blocks differ", lambda: M((2, 2), ((0,), (1,)), 1) == M((2, 2), ((0,), (1,)), 2), "False"),
    ("text of a layout", lambda: M((2, 3), ((1, 0), ()), 4), "D_[2,3]⊥{(1,0),∅}(4,∅)"),
    ("formula of a layout", lambda: M((2, 2), ((0,), ()), 4).latex(), r"$T_{\perp\{ 0,\emptyset \}(4,\emptyset)}$"),
    ("text of a slab", lambda: SlabLayout(4, 1, 3), "D_[4]⊥1(3)"),
    ("text of a tile", lambda: TileLayout(4, 2), "D_[4]⊥(2)"),
    ("a mapped axis makes a layout distributed", lambda: M((2, 2), ((0,), ()), 4).distributed, "True"),
    ("a layout without mapped axes is not distributed", lambda: M((2, 2), (None, None), 4).distributed, "False"),
    ("a layout of two axes does not fit a cube", lambda: M((2, 3), ((1,), (0,)), 1).compatible((6, 6, 6)), "False"),
    ("six ranks cannot deal five cells", lambda: M((2, 3), ((0, 1),), 1).compatible((5,)), "False"),
    ("most cells of a rank, 10 by 7 over 2 by 2 in blocks of 3 and 2", lambda: M((2, 2), ((0,), (1,)), (3, 2)).max_elements((10, 7)), "24"),
    ("most cells of a slab of 10 by 6 over 4 ranks", lambda: SlabLayout(4, 0, 3).max_elements((10, 6)), "18"),
    ("block sizes of undealt axes", lambda: M((3, 3), ((1, 0), ()), (-1, 5)).blocks, "(1, -1)"),
    ("a slab as a layout of several axes", lambda: SlabLayout(4, 1, 3).as_multi_axis(2), "D_[4]⊥{∅,0}(∅,3)"),
    ("one rank more block sizes than axes", _error(lambda: M((4,), ((0,),), (1, 1))), "ValueError"),
    ("a mesh dimension for two axes", _error(lambda: M((4, 4), ((0,), (0,)), 1)), "ValueError"),
    ("a mesh dimension that is not there", _error(lambda: M((4,), ((3,),), 1)), "ValueError"),
    ("a block of no cells", _error(lambda: M((4,), ((0,),), 0)), "ValueError"),
    ("a mesh of no processors", _error(lambda: M((4, 0), ((0,),), 1)), "ValueError"),
]

PLANS = [
    ("edits from kitten to sitting", lambda: edit_distance("kitten", "sitting"), "3"),
    ("a swap of neighbours is one edit", lambda: edit_distance("abc", "bac"), "1"),
    ("cheapest way from 1 to 10 by adding 1 or doubling", lambda: [s for _, s, _ in min(_doubling(10, 20), key=lambda r: r[1])[0]], "[1, 2, 4, 5, 10]"),
    ("its cost at 1 for each step", lambda: min(_doubling(10, 20), key=lambda r: r[1])[1], "4.0"),
    ("ways within two steps", lambda: len(_doubling(10, 20, max_depth=2)), "0"),
    ("layouts above twice the larger end's memory are skipped", lambda: _tight() <= 2 * 16, "True"),
    ("no plan between slabs", _error(lambda: NaivePlanner().plan((8, 8), SlabLayout(4), SlabLayout(4, 1))), "NotImplementedError"),
    ("no plan between meshes", _error(lambda: NaivePlanner().plan((8, 8), M((2, 2), ((0,), None), 1), M((4,), ((0,), None), 1))), "ValueError"),
    ("no plan to where it is", lambda: SearchPlanner(alpha=ALPHA, beta=BETA).plan(*PROBLEMS[1][:2], PROBLEMS[1][1])[1], "0.0"),
    ("a plan's last layout is the target", lambda: SearchPlanner(alpha=ALPHA, beta=BETA).plan(*PROBLEMS[2])[0][-1][1] == PROBLEMS[2][2], "True"),
]


def _doubling(goal: int, top_k: int, **options) -> list:
    return find_routes(1, goal, lambda x: [("add", x + 1, 1.0), ("double", 2 * x, 1.0)] if x < goal else [], lambda x, cost: cost, top_k=top_k, **options)


def _tight() -> int:
    """Most cells of a rank on the way between two layouts of 64 cells over 4 ranks."""
    planner = SearchPlanner(skip=lambda shape, a, b, x: x.max_elements(shape) > 2 * max(a.max_elements(shape), b.max_elements(shape)))
    plan, _ = planner.plan((8, 8), M((2, 2), ((0,), (1,)), 1), M((2, 2), (None, (0, 1)), 2))
    return max(layout.max_elements((8, 8)) for _, layout, _ in plan)


def _run(code: str, given: dict[str, tuple[int, ...]], hints: dict | None = None) -> Callable[[], object]:
    """Execution on zeros of some shapes."""

    def run():
        spark = SparkSession.getActiveSession()
        tensors = {n: Tensor(coordinates(spark, shape).withColumn("v", F.lit(0.0)), shape) for n, shape in given.items()}
        return sorted(ts.compile(code).execute(tensors, hints, spark))

    return run


ERRORS = [
    ("no expression", _error(lambda: ts.compile("A = ")), "ValueError"),
    ("a name without a capital", _error(lambda: ts.compile("a = B")), "ValueError"),
    ("a function that is not there", _error(lambda: ts.compile("A = nope(B)")), "ValueError"),
    ("two operands without an operator", _error(lambda: ts.compile("A = B C")), "ValueError"),
    ("one name with two orders", _error(lambda: ts.compile("A[i] = B[i]\nC = A[i,j]")), "ValueError"),
    ("an input is missing", _error(_run("A[i] = B[i] + C[i]", {"B": (3,)})), "ValueError"),
    ("an input of another order", _error(_run("A[i] = B[i]", {"B": (3, 3)})), "ValueError"),
    ("a shape hint of another order", _error(_run("A[i] = B[i]", {"B": (3,)}, {"A": (3, 3)})), "ValueError"),
    ("a literal beyond the axis", _error(_run("A = B[3]", {"B": (3,)})), "ValueError"),
    ("a literal inside the axis", _run("A = B[2]", {"B": (3,)}), "['A', 'B']"),
    ("an index with two sizes", _error(_run("A[i] = B[i] + C[i]", {"B": (3,), "C": (4,)})), "ValueError"),
    ("an index that nothing sizes", _error(_run("A[i] = i", {})), "ValueError"),
    ("a permuted read of the output", _error(_run("A[i,j] = A[j,i] + B[i,j]", {"A": (3, 3), "B": (3, 3)})), "ValueError"),
]

_CODE = """
# two statements need each other's results in order
Mean += X[i,j] / N
Centred[i,j] = X[i,j] - Mean   # a comment behind

Var += (Centred[i,j] ^ 2) / N
Scaled[i,j] = Centred[i,j] / sqrt(Var)
"""
PROGRAMS = [
    ("lines of statements, comments and empty lines counted", lambda: [s.line for s in ts.compile(_CODE).statements], "[3, 4, 6, 7]"),
    ("a statement's text without its comment", lambda: ts.compile(_CODE).statements[1].raw, "Centred[i,j] = X[i,j] - Mean"),
    ("inputs", lambda: ts.compile(_CODE).input_variables, "('X', 'N')"),
    ("lines of X", lambda: ts.compile(_CODE).variables["X"].lines, "(-1, 3, 4)"),
    ("order of Centred", lambda: ts.compile(_CODE).variables["Centred"].order, "2"),
    ("deepest loop and its line", lambda: ts.compile(_CODE).max_loop_depth, "(2, 3)"),
    ("most operations and their line", lambda: ts.compile(_CODE).max_op_count, "(2, 6)"),
    ("index variables of a product, those of the output first", lambda: ts.compile("R[k,i] += A[i,j] * B[j,k]").statements[0].index_variables, "('k', 'i', 'j')"),
    ("a name that is written first and then read is no input", lambda: ts.compile("A[i] = X[i]\nB[i] = A[i]").input_variables, "('X',)"),
    ("a name that is read first and then written is one", lambda: ts.compile("B[i] = A[i]\nA[i] = X[i]").input_variables, "('A', 'X')"),
    ("all tensors after execution", _run(_CODE, {"X": (2, 3), "N": ()}), "['Centred', 'Mean', 'N', 'Scaled', 'Var', 'X']"),
]


@pytest.mark.parametrize(("fact", "made", "right"), [*LAYOUTS, *PLANS, *ERRORS, *PROGRAMS])
def test_rules(spark, fact, made, right):
    assert str(made()) == right
