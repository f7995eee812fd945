"""Loops over long ranges: composed and streamed against the literal fold and numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

import tessellum as ts
from tessellum.operators import folds

X = np.random.default_rng(7).integers(0, 9, (3, 40)).astype(float)
LOOPS = [
    ("least", "M[i] = 100\nM[i] += (X[i,j] < M[i]) * (X[i,j] - M[i])"),
    ("least", "M = 100\nM = M + ((X[i,j] - M) * (M >= X[i,j]))"),
    ("most", "M = 0\nM += (M < X[i,j]) * (X[i,j] - M)"),
    ("affine", "M[i] = 1\nM[i] = M[i] * (X[i,j] != 8) + X[i,j]"),
    ("affine", "M[i] = -1\nM[i] += (X[i,j] == 0) * (j - M[i])"),
    ("affine", "M[i] = 1\nM[i] = (M[i] * 0) + (X[0,j] * i)"),
    ("affine", "M = 2\nM = 10 - (M * (X[i,j] == 3))"),
    ("affine", "M[i] = 64\nM[i] = X[i,j] - -M[i] / ((X[i,j] == 3) + 1)"),
    ("sum", "M[i] = 5\nM[i] = M[i] - X[i,j]"),
    ("affine", "M = 5\nM -= M - (M + X[i,j])"),
    ("product", "M = 1\nM = M * ((X[i,j] == 3) + 1)"),
    ("loop", "M[i] = 1048576\nM[i] /= ((X[i,j] == 3) * (M[i] * 0)) + ((X[i,j] == 3) + 1)"),
    ("loop", "M = 100000\nM -= (M > X[i,j]) * X[i,j]"),
    ("loop", "M[i] = 100\nM[i] = abs(M[i] - X[i,j]) + (j / 2)"),
    ("loop", "M[i] = 3\nM[i] = (M[i] ^ 2 == 9) || (M[i] < X[i,j] && i)"),
]


def results(spark, monkeypatch, code, x, chunk):
    monkeypatch.setattr(folds, "CHUNK", chunk)
    hints = {"M": (len(x),) if "M[i]" in code else ()}
    return ts.to_numpy(ts.compile(code).execute({"X": ts.from_values(spark, x)}, hints, spark)["M"])


@pytest.mark.parametrize(("form", "code"), LOOPS)
def test_long_loops_equal_the_literal_fold(spark, monkeypatch, form, code):
    assert folds.form(ts.compile(code).statements[1]) == form
    literal = results(spark, monkeypatch, code, X, 4096)
    for chunk in (5, 2):
        assert np.array_equal(results(spark, monkeypatch, code, X, chunk), literal)


@pytest.mark.parametrize("spoil", [(math.nan, 0), (math.inf, 3), (-math.inf, 5), (-math.inf, 39), (math.inf, 39)])
@pytest.mark.parametrize("code", [LOOPS[0][1], "M[i] = 0\nM[i] += (X[i,j] > M[i]) * (X[i,j] - M[i])"])
def test_values_that_spoil_a_loop(spark, monkeypatch, spoil, code):
    x = X.copy()
    x[1, spoil[1]] = spoil[0]
    assert np.array_equal(results(spark, monkeypatch, code, x, 5), results(spark, monkeypatch, code, x, 4096), equal_nan=True)


def test_no_array_is_longer_than_a_chunk(spark, monkeypatch):
    """A scalar over 30,000 steps: runs of 100, then runs of runs; least and most need no arrays at all."""
    monkeypatch.setattr(folds, "CHUNK", 100)
    x = ts.from_values(spark, np.arange(300.0)).frame
    from pyspark.sql import functions as F

    wide = ts.Tensor(x.select("d0", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(99).cast("bigint"))).alias("d1"), "v"), (300, 100))
    out = ts.compile("M = 1\nM = M * (X[i,j] != 250) + 1").execute({"X": wide}, {"M": ()}, spark)["M"]
    assert ts.to_numpy(out) == 49 * 100 + 1
    plan = out.frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 3 and "div 100" in plan
    least = ts.compile("M = 9\nM += (X[i,j] < M) * (X[i,j] - M)").execute({"X": wide}, {"M": ()}, spark)["M"]
    assert "collect_list" not in least.frame._jdf.queryExecution().optimizedPlan().toString() and ts.to_numpy(least) == 0


def test_short_loops_stay_literal(spark):
    """The loop's own rounding is kept where its steps fit into one array."""
    x = np.array([[5.123456789]])
    code = "M[i] = 1000\nM[i] += (X[i,j] < M[i]) * (X[i,j] - M[i])"
    assert ts.to_numpy(ts.compile(code).execute({"X": ts.from_values(spark, x)}, {"M": (1,)}, spark)["M"])[0] == 1000 + (5.123456789 - 1000)


@pytest.mark.parametrize("code", ["M = {s}\nM -= (M > X[i,j]) * X[i,j]", "M = {s}\nM = M - (X[i,j] * (X[i,j] <= M))"])
@pytest.mark.parametrize("start", [100000, 300, 40, 3, 0, -7])
@pytest.mark.parametrize("spoil", [None, -5.0, math.inf, -math.inf, math.nan])
def test_guarded_steps_by_runs(spark, monkeypatch, code, start, spoil):
    """Whatever the state meets, runs give what the literal loop gives, and no task sorts all steps."""
    x = X.copy()
    if spoil is not None:
        x[1, 7] = spoil
    code = code.format(s=start) if start >= 0 else code.format(s=f"0 - {-start}")
    literal = results(spark, monkeypatch, code, x, 4096)
    monkeypatch.setattr(folds, "streamed", None)
    assert np.array_equal(results(spark, monkeypatch, code, x, 16), literal, equal_nan=True)


def test_guarded_steps_of_too_many_runs_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(folds, "MOST_LOOKUPS", 1, raising=False)
    code = "M = 60\nM -= (M > X[i,j]) * X[i,j]"
    assert np.array_equal(results(spark, monkeypatch, code, X, 2), results(spark, monkeypatch, code, X, 4096))
