"""Sums over ordering masks against numpy, at any number of runs."""

from __future__ import annotations

import numpy as np
import pytest

import tessellum as ts
from tessellum.operators import ranges

RNG = np.random.default_rng(5)
P, Q, W = RNG.integers(0, 9, 30).astype(float), RNG.integers(0, 9, 7).astype(float), RNG.integers(0, 9, 30).astype(float)
G, H = RNG.integers(0, 4, (3, 20)).astype(float), RNG.integers(0, 4, (3, 6)).astype(float)
P[3:6], Q[:4] = (np.nan, np.inf, -0.0), (np.nan, np.inf, -np.inf, 0.0)
COMPARE = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}


@pytest.mark.parametrize("op", COMPARE)
@pytest.mark.parametrize("run", [1 << 20, 4])
def test_masks_equal_numpy(spark, monkeypatch, op, run):
    monkeypatch.setattr(ranges, "RUN", run)
    f = COMPARE[op]
    given = {n: ts.from_values(spark, x) for n, x in {"P": P, "Q": Q, "W": W, "G": G, "H": H}.items()}
    cases = {
        f"R[i] += (P[j] {op} Q[i])": f(P[None], Q[:, None]).sum(1),
        f"R[i] -= 2 * W[j] * (Q[i] {op} P[j])": -2 * (f(Q[:, None], P[None]) * W).sum(1),
        f"R[i] += P[j] {op} P[i]": f(P[None], P[:, None]).sum(1),
        f"R[k,i] += (G[k,j] {op} H[k,i]) * H[k,i]": f(G[:, None, :], H[:, :, None]).sum(2) * H,
    }
    for code, want in cases.items():
        assert ranges.recognise(ts.compile(code).statements[0]) is not None
        out = ts.compile(code).execute(given, spark=spark)["R"]
        plan = out.frame._jdf.queryExecution().executedPlan().toString()
        assert np.array_equal(ts.to_numpy(out), want), code
        assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("code", ["R[i] += (P[j] == Q[i])", "R[i] *= (P[j] < Q[i])", "R[i] += (P[j] < Q[i]) * (P[j] > Q[i])", "R[i] += (P[j] < 3)", "R[i] += (P[j] < Q[i]) + 1", "R += (P[j] < Q[i])", "R[i] += (P[j] < Q[i]) * Z[i,j]", "R[k,i] += (G[k,j] < Q[i])", "R[i] += (P[j] < Q[i]) * j"])
def test_other_masks_are_joined(code):
    assert ranges.recognise(ts.compile(code).statements[0]) is None


def test_ties_are_one_row(spark, monkeypatch):
    """A value that a third of all cells have is aggregated before it is put in order."""
    monkeypatch.setattr(ranges, "RUN", 50)
    x = np.concatenate([np.full(200, 5.0), np.arange(400.0)])
    out = ts.compile("R[i] += (P[j] < P[i])").execute({"P": ts.from_values(spark, x)}, spark=spark)["R"]
    assert np.array_equal(ts.to_numpy(out), (x[None] < x[:, None]).sum(1))
