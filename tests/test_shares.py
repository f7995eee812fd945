"""Softmax by places: finite where exponents overflow, and what a program does with its total."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

import tessellum as ts
from tessellum import catalog
from tessellum.operators import shares

CODE = "E[i] += exp(X[i,j] * 1)\nR[i,j] = exp(X[i,j] * 1) / E[i]"


def softmax(x):
    with np.errstate(all="ignore"):
        top = np.where(np.isfinite(x), x, -np.inf).max(1, keepdims=True)
        shifted = np.exp(x - top)
        return shifted / shifted.sum(1, keepdims=True)


def run(spark, x, code=CODE):
    return ts.compile(code).execute({"X": ts.from_values(spark, np.asarray(x, float))}, spark=spark)


@pytest.mark.parametrize("low,high", [(-5, 5), (700, 4000), (-4000, -3000), (-1e5, 1e5), (511, 513), (-513, -511)])
def test_shares_equal_the_shifted_softmax(spark, low, high):
    x = np.random.default_rng(2).uniform(low, high, (4, 30))
    assert np.allclose(ts.to_numpy(run(spark, x)["R"]), softmax(x), rtol=1e-12, atol=0)


def test_neighbouring_places_count(spark):
    """Values on both sides of a place's edge share."""
    x = [[511.9999, 512.0001, 512.0, -1e9], [1e300, 1e300, 0.0, -1e300]]
    found = ts.to_numpy(run(spark, x)["R"])
    assert np.allclose(found[0], softmax(np.array(x[:1]))[0], rtol=1e-12) and found[1].tolist() == [0.5, 0.5, 0, 0]


def test_infinite_values(spark):
    x = [[np.inf, 1.0], [np.nan, 1.0], [-np.inf, 1.0], [-np.inf, -np.inf]]
    found = ts.to_numpy(run(spark, x)["R"])
    assert np.array_equal(found, [[np.nan, 0], [np.nan, np.nan], [0, 1], [np.nan, np.nan]], equal_nan=True)


def test_the_total_itself_stays_a_plain_sum(spark):
    out = run(spark, [[1000.0, 1.0]])
    assert ts.to_numpy(out["E"])[0] == np.inf and ts.to_numpy(out["R"]).tolist() == [[1.0, 0.0]]


@pytest.mark.parametrize("code", ["E[i] += exp(X[i,j])\nE[i] = E[i] * 2\nR[i,j] = exp(X[i,j]) / E[i]", "E[i] += exp(X[i,j])\nX[i,j] = X[i,j] + 1\nR[i,j] = exp(X[i,j]) / E[i]", "E[i] += exp(X[i,j] * 2)\nR[i,j] = exp(X[i,j]) / E[i]", "E[j] += exp(X[i,j])\nR[i,j] = exp(X[i,j]) / E[i]"])
def test_other_quotients_are_worked_out_as_written(spark, code, monkeypatch):
    monkeypatch.setattr(shares, "totals", None)  # not to be called
    x = np.random.default_rng(1).uniform(0, 1, (3, 3))
    with np.errstate(all="ignore"):
        e = {0: 2 * np.exp(x).sum(1), 1: np.exp(x).sum(1), 2: np.exp(2 * x).sum(1), 3: np.exp(x).sum(0)}
    k = ["E[i] = E", "X[i,j] = X", "* 2)", "E[j] +="].index(next(m for m in ("E[i] = E", "X[i,j] = X", "* 2)", "E[j] +=") if m in code))
    want = np.exp(x + (k == 1)) / e[k][:, None]
    assert np.allclose(ts.to_numpy(run(spark, x, code)["R"]), want)


def test_rows_are_exchanged_once(spark):
    """The rows are summed before they move; after that there is one row for each key and place."""
    out = run(spark, np.zeros((2, 2)))["R"]
    plan = out.frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "Window" not in plan


def test_without_shifting_a_share_is_the_quotient_as_written(spark):
    x = ts.from_values(spark, [[1000.0, 1.0], [2.0, 1.0]])
    out = ts.compile(CODE).execute({"X": x}, spark=spark, shifted=False)["R"]
    assert np.allclose(ts.to_numpy(out), [[np.nan, 0], softmax(np.array([[2.0, 1.0]]))[0]], equal_nan=True)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")
@pytest.mark.parametrize("copies", [100, 500, 600])
def test_attention_equals_its_sql_below_and_above_the_overflow(spark, tmp_path, copies):
    """As many customers as 1, 5 and 6 times sf0.1 have; exponents of some rows of the SQL overflow at 5 times."""
    con = duckdb.connect()
    for name, times in (("nation", 1), ("customer", copies)):
        con.sql(f"COPY (SELECT t.* FROM '/root/testdata/sf0.001/{name}.parquet' t, range({times})) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = sorted((r["d0"], r["d1"], repr(r["v"])) for r in catalog.QUERIES["attention_scores"](spark, str(tmp_path)).collect())
    want = sorted((i, j, repr(v)) for i, j, v in con.sql(catalog.ORACLES["attention_scores"]).fetchall())
    assert got == want and len(want) == 25 and ("nan" in {v for _, _, v in want}) == (copies > 100)
