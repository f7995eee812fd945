from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tessellum as ts
from tessellum import inspect
from tessellum.layout import MultiAxisLayout, SlabLayout, TileLayout
from tessellum.layout.axis import axis_compatible, from_linear, max_block_size, order_name, splits, splits_frame, to_linear
from tessellum.layout.multi_axis import move
from tessellum.layout.simple import to_multi_axis
from tessellum.plans import Cost, IdealLowerBounds, NaivePlanner, SearchPlanner, execute_schedule, find_routes, schedule_frame
from tessellum.plans.planner import edit_distance

M = MultiAxisLayout


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=4), st.data())
def test_index_arithmetic(dims, data):
    position = data.draw(st.integers(0, int(np.prod(dims)) - 1))
    index = from_linear(position, dims)
    assert index == tuple(np.unravel_index(position, dims))
    assert to_linear(dims, index) == position
    assert from_linear(position, dims, "C") == tuple(np.unravel_index(position, dims[::-1]))


def test_index_errors():
    for args in (((2, 2), (1,)), ((2, 2), (2, 0)), ((2, 2), (0, 0), []), ((2, 2), (0, 0), [0, 1, 0])):
        with pytest.raises(ValueError):
            to_linear(*args)
    with pytest.raises(IndexError):
        from_linear(4, (2, 2))
    assert to_linear((4, 3, 2), (1, 2, 1), [2, 0]) == 5
    assert (order_name("C"), order_name("R")) == ("F", "C")
    with pytest.raises(ValueError):
        order_name("X")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 100), st.integers(1, 10), st.integers(0, 20))
def test_splits(size, procs, block):
    made = splits(size, block, procs)
    assert sum(n for n, _ in made) == size == made[-1][1]
    assert len(made) == (procs if not block else -(-size // block))
    b = max_block_size(size, procs)
    if size >= procs > 1:
        assert axis_compatible(size, b, procs) and (b + 1) * (procs - 1) >= size - (b == 1) * size


def test_block_examples(spark):
    assert max_block_size(20, 8) == 2 and max_block_size(20, 3) == 9 and max_block_size(20, 1) == 20
    for block in (0, 6):
        assert [(r["length"], r["ends"]) for r in splits_frame(spark, 20, block, 3).orderBy("id").collect()] == splits(20, block, 3)


@st.composite
def valid_layouts(draw):
    """A mesh, a mapping that uses each of its dimensions once at most, and positive blocks."""
    mesh = draw(st.lists(st.integers(1, 4), min_size=2, max_size=4))
    axes = draw(st.integers(2, 4))
    mapping = [[] for _ in range(axes)]
    mapping[0].append(0)
    for d in range(1, len(mesh)):
        if (axis := draw(st.integers(-1, axes - 1))) >= 0:
            mapping[axis].append(d)
    return mesh, mapping, draw(st.lists(st.integers(1, 9), min_size=axes, max_size=axes))


#: For each rule of the constructor, how to break it.
BROKEN = {
    "a block size for every axis": lambda mesh, mapping, blocks: (mesh, mapping, [*blocks, 1]),
    "no axis without one": lambda mesh, mapping, blocks: (mesh, mapping, blocks[:-1]),
    "a dimension on one axis": lambda mesh, mapping, blocks: (mesh, [*mapping[:-1], [*mapping[-1], 0]], blocks),
    "a dimension once on an axis": lambda mesh, mapping, blocks: (mesh, [[0, *mapping[0]], *mapping[1:]], blocks),
    "a dimension of the mesh": lambda mesh, mapping, blocks: (mesh, [*mapping[:-1], [*mapping[-1], len(mesh)]], blocks),
    "no negative dimension": lambda mesh, mapping, blocks: (mesh, [*mapping[:-1], [*mapping[-1], -len(mesh)]], blocks),
    "no empty block": lambda mesh, mapping, blocks: (mesh, mapping, [0, *blocks[1:]]),
    "no negative block": lambda mesh, mapping, blocks: (mesh, mapping, [-1 - blocks[0], *blocks[1:]]),
    "a mesh": lambda mesh, mapping, blocks: ((), mapping, blocks),
    "a mesh with processors": lambda mesh, mapping, blocks: ([0, *mesh[1:]], mapping, blocks),
}


@settings(max_examples=25, deadline=None)
@given(valid_layouts())
def test_valid_layouts_are_accepted(args):
    assert M(*args).processors == np.prod(args[0])


@pytest.mark.parametrize("rule", BROKEN)
@settings(max_examples=25, deadline=None)
@given(valid_layouts())
def test_each_rule_of_layouts(rule, args):
    with pytest.raises(ValueError):
        M(*BROKEN[rule](*args))


def test_layout_values():
    assert M((3, 3), ((1, 0), ()), (-1, 5)).blocks == (1, -1)
    assert M((3, 3), ((0, 1), ()), (1, None)) == M((3, 3), ((0, 1), None), 1)
    assert M((2, 2), ((0,), (1,)), 1) != M((2, 2), ((0,), (1,)), 2)
    assert str(M((2, 2), ((0,), ()), 4)) == "D_[2,2]⊥{0,∅}(4,∅)"
    assert str(M((2, 2, 2), ((0, 1), (2,)), 1)) == "D_[2,2,2]⊥{(0,1),2}(1,1)"
    assert str(M((2, 2, 2), ((), (0, 1, 2)), 3)) == "D_[2,2,2]⊥{∅,(0,1,2)}(∅,3)"
    assert M((2, 2), ((0,), ()), 4).distributed and not M((2, 2), (None, None), 4).distributed
    assert not M((2, 3), ((1, 0),), (2,)).compatible((20, 1))
    assert not M((2, 3, 2), ((0, 1), (), (2,)), 1).compatible((5, 5, 5))
    assert not M((2, 2), ((0,), ()), 20).compatible((20, 20))
    assert "emptyset" in M((2, 2), ((0,), ()), 4).latex() and SlabLayout(4, 1, 2).latex() and TileLayout(4, 2).latex()
    assert str(SlabLayout((2, 2), 1, 3)) == "D_[4]⊥1(3)" and str(TileLayout(4, 2)) == "D_[4]⊥(2)"


LAYOUTS = [
    (M((2, 3), ((1, 0), ()), (2, 1)), (20, 3)),
    (M((2, 2), ((0,), ()), 4), (20, 5)),
    (M((2, 2), (None, None), 4), (4, 5)),
    (M((2, 2, 2), ((0,), (2, 1)), (3, 1)), (10, 7)),
    (SlabLayout(3, 1, 2), (4, 9)),
    (SlabLayout(4, 0, 0), (11, 2)),
    (TileLayout(3, 2), (6, 4)),
]


@pytest.mark.parametrize(("layout", "shape"), LAYOUTS)
def test_ownership(spark, layout, shape):
    view = {}
    for r in layout.processor_view(spark, shape).collect():
        view.setdefault((r["d0"], r["d1"]), []).append(r["rank"])
    assert set(view) == set(itertools.product(*map(range, shape)))
    for cell, ranks in view.items():
        assert sorted(ranks) == sorted(layout.location(shape, cell))
    for rank in range(layout.processors):
        assert sum(rank in v for v in view.values()) == np.prod(layout.local_shape(shape, rank))
    assert layout.max_elements(shape) == max(np.prod(layout.local_shape(shape, r)) for r in range(layout.processors))


def coordinates_of(layout, cell):
    """The mesh coordinates that the owners of a cell share, by mesh dimension."""
    out = {}
    for x, dims, block in zip(cell, layout.mapping, layout.blocks, strict=True):
        if dims:
            sizes = [layout.mesh[d] for d in dims]
            out.update(zip(dims, map(int, np.unravel_index(x // block % int(np.prod(sizes)), sizes)), strict=True))
    return out


def attempt(f, *args):
    try:
        return f(*args)[0]
    except ValueError:
        return None


@settings(max_examples=60, deadline=None)
@given(valid_layouts(), st.data())
def test_collectives_move_cells_by_their_rules(args, data):
    """What each collective says of a cell's place, on drawn layouts and cells."""
    start = M(*args)
    shape = tuple(block * start.spread(k) * data.draw(st.integers(1, 3)) if dims else data.draw(st.integers(6, 40)) for k, (dims, block) in enumerate(zip(start.mapping, start.blocks, strict=True)))
    if not start.compatible(shape):
        return
    cells = [tuple(data.draw(st.integers(0, n - 1)) for n in shape) for _ in range(6)]
    places = [coordinates_of(start, c) for c in cells]

    def after(layout):
        return [coordinates_of(layout, c) for c in cells]

    if start.distributed:
        assert after(start.all_gather(shape)[0]) == [{}] * len(cells)
    for dims in start.mapping:
        for d in {*dims[:1], *dims[-1:]}:
            assert after(start.all_gather(shape, d)[0]) == [{k: v for k, v in p.items() if k != d} for p in places]
        for a, b in itertools.combinations(dims, 2):
            made = attempt(start.permute, shape, (a, b))
            assert (made is None) == (start.mesh[a] != start.mesh[b])
            swap = {a: b, b: a}
            assert made is None or after(made) == [{swap.get(k, k): v for k, v in p.items()} for p in places]
    for axis, d, block, minor in itertools.product(range(len(shape)), start.free_dims, (1, 2), (False, True)):
        made = attempt(start.split, shape, axis, d, block, minor)
        if made is not None:
            assert made.mapping[axis][-1 if minor else 0] == d
            assert [{k: v for k, v in p.items() if k != d} for p in after(made)] == places
    for source, target, mf, mt in itertools.product(range(len(shape)), range(len(shape)), (False, True), (False, True)):
        made = attempt(start.all_to_all, shape, source, target, 1, mf, mt) if start.mapping[source] else None
        if made is not None:
            moved = set(start.mapping[source][-1:] if mf else start.mapping[source])
            assert moved <= set(made.mapping[target])
            assert [{k: v for k, v in p.items() if k not in moved} for p in after(made)] == [{k: v for k, v in p.items() if k not in moved} for p in places]
            # The moved dimensions follow the target's coordinate alone.
            other = [tuple(x if k == target else 0 for k, x in enumerate(c)) for c in cells]
            assert [{d: p[d] for d in moved} for p in after(made)] == [{d: coordinates_of(made, c)[d] for d in moved} for c in other]
    for axis, dims in enumerate(start.mapping):
        for times in (1, 2):
            made = attempt(start.change_block, shape, axis, start.blocks[axis] * start.spread(axis) * times) if dims else None
            if made is not None:
                owner = [c[axis] // made.blocks[axis] % start.spread(axis) for c in cells]
                assert made.mapping == start.mapping and [tuple(p[d] for d in dims) for p in after(made)] == [tuple(map(int, np.unravel_index(v, [start.mesh[d] for d in dims]))) for v in owner]


@settings(max_examples=60, deadline=None)
@given(valid_layouts(), st.data())
def test_transfers_count_what_ranks_hold(args, data):
    start = M(*args)
    shape = tuple(12 * start.spread(k) * max(1, b) for k, b in enumerate(start.blocks))
    held = start.max_elements(shape)
    if start.distributed:
        procs = int(np.prod([start.spread(k) for k in range(len(shape))]))
        assert start.all_gather(shape)[1:] == (held * procs, procs) and held * procs == np.prod(shape)


def moves():
    """Own examples: a layout, its shape, and where a collective takes it."""
    two = M((3, 2), ((1, 0), ()), (2, None))
    yield two, (24, 6), two.all_gather((24, 6), 0)[0], "D_[3,2]⊥{1,∅}(6,∅)"
    yield two, (24, 6), two.all_gather((24, 6), 1)[0], "D_[3,2]⊥{0,∅}(2,∅)"
    yield two, (24, 6), two.all_to_all((24, 6), 0, 1, 1, True)[0], "D_[3,2]⊥{1,0}(6,1)"
    yield two, (24, 6), two.change_block((24, 6), 0, 1)[0], "D_[3,2]⊥{(1,0),∅}(1,∅)"
    one = M((2, 4), (None, (1,)), (None, 6))
    yield one, (9, 48), one.split((9, 48), 1, 0, minor=True)[0], "D_[2,4]⊥{∅,(1,0)}(∅,3)"
    yield one, (9, 48), one.split((9, 48), 0, 0, 3)[0], "D_[2,4]⊥{0,1}(3,6)"
    cube = M((2, 2), ((1, 0), ()), (3, None))
    yield cube, (12, 5), cube.permute((12, 5), (0, 1))[0], "D_[2,2]⊥{(0,1),∅}(3,∅)"


@pytest.mark.parametrize(("start", "shape", "target", "text"), list(moves()))
def test_moves_equal_direct_placement(spark, start, shape, target, text):
    assert str(target) == text
    tensor = ts.from_values(spark, np.arange(float(np.prod(shape))).reshape(shape))
    got = sorted(map(tuple, move(start.place(tensor), shape, start, target).select("rank", "d0", "d1", "v").collect()))
    want = sorted(map(tuple, target.place(tensor).select("rank", "d0", "d1", "v").collect()))
    assert got == want
    parts = {(r["rank"], r["p"]) for r in target.place(tensor).select("rank", F.spark_partition_id().alias("p")).collect()}
    assert all(r == p for r, p in parts)


@pytest.mark.parametrize(("layout", "shape"), [(SlabLayout(3, 1, 2), (4, 9)), (SlabLayout(4, 0, 0), (12, 2)), (TileLayout(3, 2), (12, 4)), (TileLayout(6, 2), (4, 6)), (TileLayout(4, 1), (2, 2)), (TileLayout(8, 1), (2, 2, 4)), (TileLayout(12, 1), (2, 3, 4)), (M((2, 2), ((1,), (0,)), 2), (9, 9))])
def test_conversion_places_cells_alike(layout, shape):
    made = to_multi_axis(layout, shape)
    assert all(made.location(shape, cell) == layout.location(shape, cell) for cell in itertools.product(*map(range, shape)))


@pytest.mark.parametrize(("layout", "shape"), [(SlabLayout(4, 0, 0), (11, 2)), (TileLayout(3, 2), (4, 6)), (TileLayout(4, 1), (3, 8)), (TileLayout(8, 1), (2, 2)), (TileLayout(4, 2), (5, 4))])
def test_what_has_no_such_layout(layout, shape):
    with pytest.raises(ValueError):
        to_multi_axis(layout, shape)


def test_collective_errors():
    none, a = M((2, 2), (None, None), 1), M((2, 3), ((0, 1), ()), 2)
    for f in (lambda: none.all_gather((8, 8)), lambda: none.all_to_all((8, 8), 0, 1), lambda: a.permute((24, 8), (0, 1)), lambda: a.change_block((24, 8), 0, 4), lambda: a.all_gather((24, 8), 5), lambda: a.all_to_all((24, 8), 0, 0), lambda: M((2, 2, 2), ((0, 1, 2),), 1).all_gather((24,), 1), lambda: M((2, 2), ((0,), (1,)), 1).permute((8, 8), (0, 1))):
        with pytest.raises(ValueError):
            f()


def test_costs():
    m = IdealLowerBounds()
    assert m.allgather(8, 80) == Cost(3, 70) and m.permute(2, 5) == Cost(1, 10)
    assert m.allreduce(4, 8) == Cost(2, 12, 6) and m.reduce_scatter(4, 8) == Cost(2, 6, 6)
    assert Cost(1, 2, 3, 4) + Cost(1, 1, 1, 9) == Cost(2, 3, 4, 9)
    assert edit_distance("ca", "abc") == 2 and edit_distance("ab", "ba") == 1 and edit_distance("", "xyz") == 3


def test_plans(spark):
    from tessellum.catalog import ALPHA, BETA, PROBLEMS

    for problem, cost in ((1, 1.4336), (2, 0.3968), (3, 0.28)):
        shape, start, target = PROBLEMS[problem]
        assert NaivePlanner(alpha=ALPHA, beta=BETA).plan(shape, start, target)[1] == pytest.approx(cost, rel=1e-4)
        schedule, found = SearchPlanner(alpha=ALPHA, beta=BETA, path_weight=1.02, max_depth=6, top_k=15).plan(shape, start, target)
        assert found <= cost * 1.0001 and schedule[-1][1] == target
    assert schedule_frame(spark, schedule).count() == len(schedule)
    tight = SearchPlanner(skip=lambda shape, a, b, x: x.max_elements(shape) > 2 * max(a.max_elements(shape), b.max_elements(shape)))
    start, target = M((2, 2), ((0,), (1,)), (1, 2)), M((2, 2), (None, (0, 1)), 2)
    plan, _ = tight.plan((8, 16), start, target)
    tensor = ts.from_values(spark, np.arange(128.0).reshape(8, 16))
    got = sorted(map(tuple, execute_schedule(start.place(tensor), (8, 16), plan).select("rank", "d0", "d1").collect()))
    assert got == sorted(map(tuple, target.place(tensor).select("rank", "d0", "d1").collect()))
    with pytest.raises(NotImplementedError):
        tight.plan((8, 16), SlabLayout(4), SlabLayout(4, 1))
    with pytest.raises(ValueError):
        tight.plan((8, 16), start, M((4,), ((0,), None), 1))
    with pytest.raises(ValueError):
        NaivePlanner().plan((8, 16), M((2, 2), (None, None), 1), target)
    routes = find_routes(0, 8, lambda x: [("+1", x + 1, 1.0), ("*2", x * 2, 1.5)] if x < 20 else [], top_k=3)
    assert len(routes) == 2 and all(r[0][0][1] == 0 and r[0][-1][1] == 8 for r in routes)


def test_inspection(spark):
    assert inspect.mesh_nodes(spark, (2, 3)).count() == 6 and inspect.mesh_edges(spark, (2, 3)).count() == 7
    cells = inspect.tensor_cells(spark, (3, 3), (1, None), M((2,), ((0,), None), 1))
    assert cells.where("highlight").count() == 3 and {r["rank"] for r in cells.collect()} == {0, 1}
    s = ts.compile("R[i,j] += X[i,k] * Y[k,j]").statements[0]
    marked = inspect.operation_cells(spark, s, {"i": 2, "j": 2, "k": 3}, {"i": 0, "j": 1}).where("highlight")
    assert marked.count() == 1 + 3 + 3
    assert inspect.mesh_grid(spark, (2, 2)).count() == 4
