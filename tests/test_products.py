"""Products that stay factors, and parts that several statements share."""

from __future__ import annotations

import numpy as np
import pytest

import tessellum as ts

B, C, D = (np.random.default_rng(k).integers(-5, 6, n).astype(float) for k, n in ((1, 6), (2, 7), (3, 7)))
M = np.random.default_rng(4).integers(-5, 6, (6, 7)).astype(float)
CASES = [
    ("O[i,j] = B[i] * C[j]\nR[i] += O[i,j] * D[j]", B * (C @ D)),
    ("O[i,j] = 2 * B[i] * C[j]\nR[j] -= O[i,j]", -2 * B.sum() * C),
    ("O[i,j] = B[i] * C[j]\nP[k,i,j] = O[i,j] * B[k]\nR[k] += P[k,i,j] * M[i,j]", B * (B @ M @ C)),
    ("O[i,j] = B[i] * C[j]\nR[i,m] += O[i,j] * O[m,j]", np.outer(B, B) * (C @ C)),
    ("O[i,j] = B[i] * C[j]\nR += O[i,j] * O[i,j]", (B @ B) * (C @ C)),
    ("O[j,i] = B[i] * C[j]\nR[i] += O[2,i] * B[i]", C[2] * B * B),
    ("O[i,j] = B[i] * M[i,j]\nR[j] += O[i,j]", B @ M),
]


def given(spark):
    return {n: ts.from_values(spark, x) for n, x in {"B": B, "C": C, "D": D, "M": M}.items()}


@pytest.mark.parametrize(("code", "want"), CASES)
def test_products_are_not_expanded(spark, code, want, monkeypatch):
    from tessellum.operators import lowering

    monkeypatch.setattr(lowering, "BROADCAST_CELLS", 1)  # nothing but a single cell is small
    grids = []
    monkeypatch.setattr(lowering.skew, "grid", lambda *a, f=lowering.skew.grid: grids.append(1) or f(*a))
    out = ts.compile(code).execute(given(spark), spark=spark)
    assert np.array_equal(ts.to_numpy(out["R"]), want)
    assert "Cartesian" not in out["R"].frame._jdf.queryExecution().executedPlan().toString()
    # Only the statements O and P, and a result that is an outer product itself, are expanded.
    assert len(grids) == code.split("R", 1)[0].count("=") - code.count("M[i,j]\nR") + (want.ndim == 2)


def test_the_product_itself_is_there_too(spark):
    out = ts.compile("O[i,j] = B[i] * C[j]\nR[i,j] = O[i,j] + 1\nT[j] += O[i,j] * (O[i,j] > 0)").execute(given(spark), spark=spark)
    o = np.outer(B, C)
    assert np.array_equal(ts.to_numpy(out["O"]), o) and np.array_equal(ts.to_numpy(out["R"]), o + 1) and np.array_equal(ts.to_numpy(out["T"]), (o * (o > 0)).sum(0))


def test_names_stand_for_their_latest_value(spark):
    out = ts.compile("O[i,j] = B[i] * C[j]\nB[i] = B[i] + 1\nR[i] += O[i,j] * D[j]").execute(given(spark), spark=spark)
    assert np.array_equal(ts.to_numpy(out["R"]), B * (C @ D))


def test_whole_numbers_truncate_first(spark):
    """A product stored as whole numbers is what later statements read."""
    x = ts.from_values(spark, np.array([1, 2, 3]), "int")
    out = ts.compile("O[i,j] = X[i] * X[j] * 0.5\nR[i] += O[i,j]").execute({"X": x}, spark=spark)
    assert ts.to_numpy(out["R"]).tolist() == [int(a * 0.5) + int(a) + int(a * 1.5) for a in (1, 2, 3)]


SOFT = "W[i,j] += M[i,k] * M[j,k]\nE[i] += exp(W[i,j])\nR[i,j] = exp(W[i,j]) / E[i]\nZ[i,k] += R[i,j] * M[j,k]"
KMEANS = "Dist[i,k] += (M[i,j] - K[k,j]) ^ 2\nMin[i] = 1000000\nL[i] = -1\nMin[i] += (Dist[i,k] < Min[i]) * (Dist[i,k] - Min[i])\nL[i] += (Dist[i,k] == Min[i]) * (k - L[i])\nN[l] += (L[i] == l)\nR[l,j] += M[i,j] * (L[i] == l)"


def scans(tensor):
    """Reads of sources and exchanges in a plan."""
    plan = tensor.frame._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("LogicalRDD") + plan.count("LocalRelation"), plan.count("Aggregate")


@pytest.mark.parametrize(("code", "output", "hints"), [(SOFT, "Z", {}), (KMEANS, "R", {"Min": (6,), "L": (6,), "N": (3,), "R": (3, 7)})])
def test_shared_parts_are_computed_once(spark, code, output, hints):
    given_ = {"M": ts.from_values(spark, M / 10), "K": ts.from_values(spark, M[:3] / 10)}
    apart, once = (ts.compile(code).execute(given_, hints, spark, shared=s)[output] for s in (False, True))
    assert np.allclose(ts.to_numpy(apart), ts.to_numpy(once))
    # A stored part is one scan, and what it was made of does not appear again.
    assert scans(once)[0] < scans(apart)[0] and scans(once)[1] < scans(apart)[1]


def test_equal_statements_are_one(spark):
    out = ts.compile("P[i] += M[i,j]\nQ[i] += M[i,j]\nM[i,j] = M[i,j] + 1\nR[i] += M[i,j]").execute(given(spark), spark=spark)
    assert out["P"] is out["Q"] and np.array_equal(ts.to_numpy(out["R"]), (M + 1).sum(1)) and np.array_equal(ts.to_numpy(out["Q"]), M.sum(1))
