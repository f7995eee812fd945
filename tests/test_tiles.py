"""Contractions on tiles against numpy, and what travels for them."""

from __future__ import annotations

import numpy as np
import pytest

import tessellum as ts
from tessellum.operators import lowering, tiles


def cut(monkeypatch, side, depth):
    monkeypatch.setattr(tiles, "SIDE", side)
    monkeypatch.setattr(tiles, "DEPTH", depth)


def run(spark, code, tiled=True, **given):
    made = ts.compile(code).execute({n: ts.from_values(spark, a) for n, a in given.items()}, spark=spark, tiled=tiled)
    return made[ts.compile(code).statements[-1].output.name]


def whole(rng, *shape):
    return rng.integers(-9, 9, shape).astype(float)


A, B, G, H = (whole(np.random.default_rng(1), *s) for s in ((7, 11), (11, 5), (3, 4, 6), (6, 3, 5)))
CASES = [
    ("R[p,r] += A[p,q] * B[q,r]", {"A": A, "B": B}, A @ B),
    ("R[r,p] -= (3 * B[q,r]) * A[p,q]", {"A": A, "B": B}, -3 * (A @ B).T),
    ("R[p,r] += (A[p,q] - B[q,r]) ^ 2", {"A": A, "B": B}, ((A[:, :, None] - B[None]) ** 2).sum(1)),
    ("R[p,r] += (A[p,q] > B[q,r]) && (B[q,r] > 0)", {"A": A, "B": B}, ((A[:, :, None] > B[None]) & (B[None] > 0)).sum(1)),
    ("R[p,r] += A[p,q] * A[p,q] * B[q,r]", {"A": A, "B": B}, (A * A) @ B),
    ("R[n,p,r] += G[n,p,q] * H[q,n,r]", {"G": G, "H": H}, np.einsum("npq,qnr->npr", G, H)),
    ("R[p,s] += A[p,q] * A[s,q]", {"A": A}, A @ A.T),
    ("R[n,r] += G[n,p,q] * K[(pq),r]", {"G": G, "K": (K := whole(np.random.default_rng(2), 24, 2))}, np.einsum("npq,pqr->nr", G, K.reshape(4, 6, 2))),
    ("R[(pr)] += A[p,q] * B[q,r]", {"A": A, "B": B}, (A @ B).ravel()),
]


@pytest.mark.parametrize(("code", "given", "want"), CASES)
@pytest.mark.parametrize("size", [(2, 3), (1024, 256)])
def test_tiles_equal_numpy(spark, monkeypatch, code, given, want, size):
    cut(monkeypatch, *size)
    assert tiles.recognise(ts.compile(code).statements[0], False) is not None
    assert np.array_equal(ts.to_numpy(run(spark, code, **given)), want)


@pytest.mark.parametrize("code", ["R[p] += A[p,q] * Z[q]", "R[p,r] += A[p,q] + B[q,r] * p", "R[p,r] *= A[p,q] * B[q,r]", "R[p,r] += A[p,q] * B[r,s]", "R[p,q,r] += A[p,q] * B[q,r]", "R[p,s] += A[p,q] * B[q,r] * C[r,s]", "R[p] += A[p,q] * B[p,q]"])
def test_other_statements_are_joined_by_cells(code):
    assert tiles.recognise(ts.compile(code).statements[0], False) is None


def test_not_numbers_and_infinities(spark, monkeypatch):
    cut(monkeypatch, 2, 2)
    a, b = A.copy(), B.copy()
    a[0, 0], a[1, 1], a[2, :], b[0, 0] = np.nan, np.inf, 0, -np.inf
    code = "R[p,r] += A[p,q] * B[q,r]"
    tiled, joined = (ts.to_numpy(run(spark, code, tiled=t, A=a, B=b)) for t in (True, False))
    assert np.array_equal(tiled, joined, equal_nan=True)


def test_32_bit_operands_compare_loosely(spark):
    a, b = np.array([[0.1, 1.0]]), np.array([[0.1], [1 + 1e-15]])
    given = {"A": ts.from_values(spark, a, "float"), "B": ts.from_values(spark, b)}
    for tiled in (True, False):
        out = ts.compile("R[p,r] += (A[p,q] == B[q,r])").execute(given, spark=spark, tiled=tiled)["R"]
        assert ts.to_numpy(out)[0, 0] == 1  # 0.1 as a 32-bit number is another; 1 is within 1e-14


def test_tiles_travel_instead_of_cells(spark, monkeypatch):
    """No join of cells in the plan; a part for each tile of a batch, far fewer rows than cells."""
    cut(monkeypatch, 16, 64)
    a = np.arange(64.0 * 64).reshape(64, 64) % 7
    out = run(spark, "R[p,r] += A[p,q] * A[q,r]", A=a)
    plan = out.frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "CoGroup" in plan
    assert np.array_equal(ts.to_numpy(out), a @ a)
    from pyspark.sql import functions as F

    tensor = ts.from_values(spark, a)
    parts = tiles.packed(tensor.frame, "v", F.lit(0), F.col("d0"), F.col("d1"), (16, 64))
    assert parts.count() <= 4 * tensor.frame.rdd.getNumPartitions() < a.size // 16


def test_meetings_hold_two_tiles_whatever_the_axes(spark, monkeypatch):
    """With one tile of the contracted axis, left and right still meet by pairs of tiles."""
    cut(monkeypatch, 4, 256)
    seen = []
    meet = tiles._meet

    def counted(plan, extents, tile):
        seen.append((extents, tile))
        return meet(plan, extents, tile)

    monkeypatch.setattr(tiles, "_meet", counted)
    a = whole(np.random.default_rng(3), 30, 3)
    assert np.array_equal(ts.to_numpy(run(spark, "R[p,s] += A[p,q] * A[s,q]", A=a)), a @ a.T)
    assert seen == [((30, 3, 30), (4, 3, 4))]


def test_work_decides(spark, monkeypatch):
    used = []
    monkeypatch.setattr(lowering.tiles, "contract", lambda *a, f=tiles.contract, **k: used.append(1) or f(*a, **k))
    run(spark, "R[p,r] += A[p,q] * B[q,r]", tiled=None, A=A, B=B)
    assert not used
    monkeypatch.setattr(tiles, "LEAST_WORK", 100)
    run(spark, "R[p,r] += A[p,q] * B[q,r]", tiled=None, A=A, B=B)
    run(spark, "R[p,r] += A[p,q] * B[q,r]", tiled=False, A=A, B=B)
    assert used == [1]


def test_tiles_as_a_layout(spark):
    a = whole(np.random.default_rng(4), 9, 14)
    cut = tiles.to_tiles(ts.from_values(spark, a), 4, 5)
    assert {(r["tile_i"], r["tile_k"]): len(r["x"]) for r in cut.collect()} == {(i, k): min(4, 9 - 4 * i) * min(5, 14 - 5 * k) for i in range(3) for k in range(3)}
    assert np.array_equal(ts.to_numpy(tiles.from_tiles(cut, (9, 14), 4, 5)), a)
    with pytest.raises(ValueError, match="order 1"):
        tiles.to_tiles(ts.from_values(spark, a[0]))


def shuffled(spark, frame):
    """Bytes that a frame's stages write to shuffles."""
    context = spark.sparkContext
    gateway, scala = context._gateway, context._jsc.sc()

    def stages():
        scala.listenerBus().waitUntilEmpty()
        found = scala.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s := found.apply(n)).stageId(): s.shuffleWriteBytes() for n in range(found.size())}

    last = max(stages(), default=-1)
    frame.write.format("noop").mode("overwrite").save()
    return sum(b for k, b in stages().items() if k > last)


@pytest.mark.parametrize("code", ["R[p,s] += A[p,q] * A[s,q]", "R[p,s] += (A[p,q] == A[s,q])"])
def test_all_pairs_shuffle_in_proportion_to_the_input(spark, monkeypatch, code):
    """twice the rows are four times the pairs, but each tile is shuffled once."""
    cut(monkeypatch, 16, 256)
    monkeypatch.setattr(tiles, "DEALT", 3)
    monkeypatch.setattr(tiles, "SHARE", 1 << 20)
    a = np.random.default_rng(5).integers(0, 50, (640, 32)).astype(float)
    written = [shuffled(spark, run(spark, code, A=a[:n]).frame) for n in (320, 640)]
    assert 0 < written[1] < 2.6 * written[0]


@pytest.mark.parametrize("dealt", [(64, 16), (2, 3)])
def test_crossed_tiles_equal_numpy(spark, monkeypatch, dealt):
    """More tiles along both axes than are copied, the last of each cut short; several letters on either side."""
    cut(monkeypatch, 2, 8)
    monkeypatch.setattr(tiles, "DEALT", dealt[0])
    monkeypatch.setattr(tiles, "SHARE", dealt[1])
    rng = np.random.default_rng(6)
    a, b = whole(rng, 11, 5), whole(rng, 5, 13)
    c, d = whole(rng, 3, 5, 5), whole(rng, 5, 2, 7)
    for code, given, want in (
        ("R[p,r] -= (A[p,q] * 3) * B[q,r]", {"A": a, "B": b}, -3 * a @ b),
        ("R[r,p] += (A[p,q] > B[q,r])", {"A": a, "B": b}, (a[:, :, None] > b[None]).sum(1).T),
        ("R[n,s,p,r] += C[n,p,q] * D[q,r,s]", {"C": c, "D": d}, np.einsum("npq,qrs->nspr", c, d)),
    ):
        out = run(spark, code, **given)
        assert "CartesianProduct" in out.frame._jdf.queryExecution().executedPlan().toString()
        assert np.array_equal(ts.to_numpy(out), want)


def test_crossed_tiles_leave_what_is_no_number(spark, monkeypatch):
    cut(monkeypatch, 2, 8)
    a = whole(np.random.default_rng(7), 11, 5)
    a[0, 0], a[3, 1], a[4, :], a[10, 2] = np.nan, np.inf, 0, -np.inf
    for code in ("R[p,s] += A[p,q] * A[s,q]", "R[p,s] += (A[p,q] == A[s,q])"):
        tiled, joined = (ts.to_numpy(run(spark, code, tiled=t, A=a)) for t in (True, False))
        assert np.array_equal(tiled, joined, equal_nan=True)


def test_crossed_tasks_follow_the_cores(spark, monkeypatch):
    """40 tiles a side were 1600 tasks of one pair each, mostly start-up."""
    cut(monkeypatch, 2, 8)
    out = run(spark, "R[p,s] += (A[p,q] == A[s,q])", A=whole(np.random.default_rng(8), 80, 3))
    assert 4 <= out.frame.rdd.getNumPartitions() <= 64


@pytest.mark.parametrize("operator", ["==", "!=", "<", ">", "<=", ">=", "&&", "||"])
def test_counts_beyond_a_byte(spark, monkeypatch, operator):
    """What is 1 or 0 is counted in bytes where they suffice: 0 to 256 of a tile's 256 steps, and 40 more."""
    cut(monkeypatch, 8, 256)
    a = (np.arange(296)[None] < np.array([0, 1, 255, 256, 257, 296])[:, None]).astype(float)
    by = {"==": np.equal, "!=": np.not_equal, "<": np.less, ">": np.greater, "<=": np.less_equal, ">=": np.greater_equal, "&&": np.logical_and, "||": np.logical_or}
    out = run(spark, f"R[p,s] += (A[p,q] {operator} A[s,q])", A=a)
    assert np.array_equal(ts.to_numpy(out), by[operator](a[:, None], a[None]).sum(2))
