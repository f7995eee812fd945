"""Tensors of stored cells against the same tensors filled up, and their plans."""

from __future__ import annotations

import numpy as np
import pytest

import tessellum as ts
from tessellum.lang.syntax import parse
from tessellum.operators import sparse
from tessellum.sources.tables import read_tensor, write_tensor


def some(rng, *shape):
    return (rng.integers(1, 5, shape) * (rng.random(shape) < 0.3)).astype(float)


RNG = np.random.default_rng(3)
A, B, C, V = some(RNG, 6, 8), some(RNG, 6, 8), some(RNG, 8, 5), RNG.integers(0, 4, 8).astype(float)


def stored(spark, x):
    rows = [(*map(int, at), float(x[at])) for at in zip(*np.nonzero(x), strict=True)]
    names = [f"i{k}" for k in range(x.ndim)]
    return ts.from_cells(spark.createDataFrame(rows, ", ".join([*(f"{n} long" for n in names), "x double"])), names, "x", x.shape)


#: Statement, whether its result is sparse, whether its plan may hold the grid.
CASES = [
    ("R[i,j] = A[i,j] * B[i,j]", True, False),
    ("R[i,j] = A[i,j] + B[i,j]", True, False),
    ("R[i,j] = A[i,j] - (B[i,j] * 2)", True, False),
    ("R[i,k] += A[i,j] * C[j,k]", True, False),
    ("R[i,m] += A[i,j] * A[m,j]", True, False),
    ("R[i] += A[i,j] * V[j]", True, False),
    ("R += A[i,j] + B[i,j]", False, False),
    ("R += A[i,j] * 0", False, True),
    ("R[i] -= sqrt(A[i,j]) * (B[i,j] > 2)", True, False),
    ("R[i,j] = (A[i,j] != B[i,j]) / 4", True, False),
    ("R[i] = A[i,j]", True, False),
    ("R[j] += A[i,j] * V[j] * B[i,j]", True, False),
    ("R[(ij)] = A[i,j] ^ 2", True, False),
    ("R[i,j] = (A[i,j] > 0) * (V[j] - B[i,j])", True, False),
    ("R[i] += A[i,j] * (V[j] == i)", True, True),
    ("R[i,j] = exp(A[i,j])", False, True),
    ("R[j,i] = A[i,j] + W[j]", True, True),
    ("R[i,j] = (A[i,j] * B[i,j]) + W[j]", True, True),
    ("R[i,j] = A[i,j] / 2 + i", False, True),
    ("R[i,j] = A[i,j] / B[i,j]", False, True),
    ("R[i,j] = A[i,j] == B[i,j]", False, True),
    ("R[i] *= A[i,j] + 1", False, True),
    ("R[i,j] = A[i,j]\nR[0,j] = V[j]", False, True),
    ("R[i,j] = A[i,j]\nR[i,j] = R[i,j] * 2 + B[i,j]", False, True),
]


@pytest.mark.parametrize(("code", "thin", "grid"), CASES)
def test_stored_cells_equal_filled_ones(spark, code, thin, grid):
    full = {n: ts.from_values(spark, x) for n, x in {"A": A, "B": B, "C": C, "V": V, "W": V}.items()}
    few = full | {n: stored(spark, x) for n, x in {"A": A, "B": B, "C": C, "W": V}.items()}
    want = ts.to_numpy(ts.compile(code).execute(full, spark=spark)["R"])
    out = ts.compile(code).execute(few, spark=spark)["R"]
    assert np.array_equal(ts.to_numpy(out), want, equal_nan=True)
    assert out.sparse == thin
    assert np.array_equal(ts.to_numpy(ts.dense(out)), want, equal_nan=True)
    plan = out.frame._jdf.queryExecution().optimizedPlan().toString()
    assert ("Range (" in plan) <= grid and "Cartesian" not in out.frame._jdf.queryExecution().executedPlan().toString()


def test_sums_of_sparse_tensors_take_one_exchange(spark):
    out = ts.compile("R[i,j] = A[i,j] + B[i,j]").execute({"A": stored(spark, A), "B": stored(spark, B)}, spark=spark)["R"]
    plan = out.frame._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 3  # one for each source's own sums


SUPPORTS = [
    ("A[i] * B[i]", [{"A", "B"}]),
    ("A[i] + B[i]", [{"A"}, {"B"}]),
    ("(A[i] + B[i]) * C[i]", [{"A", "C"}, {"B", "C"}]),
    ("A[i] + (A[i] * B[i])", [{"A"}]),
    ("A[i] * D[i]", [{"A"}]),
    ("A[i] + D[i]", [set()]),
    ("abs(-A[i]) / 3", [{"A"}]),
    ("A[i] / D[i]", [set()]),
    ("cos(A[i])", [set()]),
    ("A[i] < 0", [{"A"}]),
    ("A[i] <= B[i]", [set()]),
    ("A[i] ^ 0", [set()]),
    ("0 * A[i]", []),
    ("(A[i] && B[i]) || C[i]", [{"A", "B"}, {"C"}]),
]


@pytest.mark.parametrize(("text", "want"), SUPPORTS)
def test_support(text, want):
    (s,) = parse(f"R[i] = {text}")
    found = sparse.support(s.expression, lambda r: r.name != "D")
    assert sorted(sorted(r.name for r in c) for c in found) == sorted(map(sorted, want))


def test_stored_and_read_again(spark, tmp_path):
    write_tensor(stored(spark, A), str(tmp_path / "a"))
    back = read_tensor(spark, str(tmp_path / "a"))
    assert back.sparse and back.frame.count() == np.count_nonzero(A) and np.array_equal(ts.to_numpy(back), A)


def test_nothing_stored(spark):
    none = stored(spark, np.zeros((3, 4)))
    out = ts.compile("R += A[i,j] * A[i,j]\nT[i] += A[i,j]\nU[i,j] = A[i,j] + A[i,j]").execute({"A": none}, spark=spark)
    assert ts.to_numpy(out["R"]) == 0 and not ts.to_numpy(out["T"]).any() and out["U"].frame.count() == 0


@pytest.mark.parametrize("code", ["R[i] += (A[i,j] == 0)", "R -= cos(A[i,j])", "R[j] += (A[i,j] <= B[i,j]) + W[j]", "R[i] += exp(A[i,j]) / (B[i,j] + i)", "R[i] += A[i,j] ^ 0"])
def test_what_is_not_stored_is_counted(spark, code):
    """Sums that do not vanish at 0 equal those of filled tensors, and no grid of all index values is made."""
    given = {"A": A, "B": B, "W": V}
    results = []
    for make in (stored, ts.from_values):
        out = ts.compile(code).execute({n: ts.from_values(spark, x) if n == "W" else make(spark, x) for n, x in given.items()}, spark=spark)["R"]
        assert not out.sparse
        results.append(ts.to_numpy(out))
        if make is stored:
            assert f"Range (0, {A.size}," not in out.frame._jdf.queryExecution().optimizedPlan().toString()
    assert np.allclose(*results, rtol=1e-12, atol=0, equal_nan=True)
