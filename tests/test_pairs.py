"""Products of stored cells by ranges of the shared index, against numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

import tessellum as ts
from tessellum.operators import lowering, pairs
from test_tiles import shuffled

RNG = np.random.default_rng(11)
X, Y = ((RNG.integers(-4, 5, s) * (RNG.random(s) < 0.4)).astype(float) for s in ((9, 12), (7, 12)))
X[:, 3], Y[:, 3] = 2, 3  # a heavy value


def stored(spark, x):
    rows = [(*map(int, at), float(x[at])) for at in zip(*np.nonzero(x), strict=True)]
    return ts.from_cells(spark.createDataFrame(rows, "i long, k long, x double"), ["i", "k"], "x", x.shape)


@pytest.mark.parametrize(("code", "want"), [("R[i,j] += X[i,k] * Y[j,k]", X @ Y.T), ("R[j,i] -= (2 * Y[j,k]) * X[i,k]", -2 * (Y @ X.T))])
@pytest.mark.parametrize(("size", "batch"), [(5, 3), (1 << 22, 10000)])
def test_products_equal_numpy(spark, monkeypatch, code, want, size, batch):
    monkeypatch.setattr(lowering, "BROADCAST_CELLS", 1)
    monkeypatch.setattr(pairs, "PAIRS", size)
    monkeypatch.setattr(pairs, "CELLS", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = ts.compile(code).execute({"X": stored(spark, X), "Y": stored(spark, Y)}, spark=spark)["R"]
        cells = {(r["d0"], r["d1"]): r["v"] for r in out.frame.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    meets = (X != 0).astype(int) @ (Y != 0).T if want.shape == (9, 7) else (Y != 0).astype(int) @ (X != 0).T
    assert out.sparse and set(cells) == set(zip(*map(list, np.nonzero(meets)), strict=True))
    assert all(want[at] == v for at, v in cells.items())


def test_pairs_are_added_up_before_they_travel(spark):
    """400 neighbouring k with the same 10 by 10 cells: 40,000 pairs, of which each task passes on 100 sums at most."""
    cells = spark.range(4000).selectExpr("id div 10 as k", "id % 10 as i", "1.0D as x")
    made = pairs.multiply(cells, cells.withColumnRenamed("i", "j"), ["k"], ("x", "x"))
    assert sorted(r["x"] for r in made.collect()) == [400.0] * 100
    parts = next(iter(pairs._pairs(1)(iter(sample()))))
    assert parts.num_rows == 100 and set(parts.column("x").to_pylist()) == {400.0}


def sample():
    import pyarrow as pa

    k, side, at = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(2), np.arange(10), indexing="ij"))
    whole = pa.record_batch([pa.array(k), pa.array(side), pa.array(at), pa.array(np.ones(len(k)))], names=["k", "side", "at", "x"])
    return [whole.slice(n, 333) for n in range(0, len(k), 333)]


def product(spark, frame, shape):
    tensors = {n: ts.from_cells(frame, ["i", "k"], v, shape) for n, v in (("X", "x"), ("Y", "y"))}
    return ts.compile("R[i,j] += X[i,k] * Y[j,k]").execute(tensors, spark=spark)["R"]


def test_neither_pairs_nor_sums_travel(spark, monkeypatch):
    """40 cells a k that hardly ever meet again are 40 pairs a cell; what is shuffled are the cells."""
    monkeypatch.setattr(lowering, "BROADCAST_CELLS", 1)
    frame = spark.range(20_000).selectExpr("id div 40 as k", "pmod(xxhash64(id), 5000) as i", "1.0D as x", "2.0D as y")
    assert 0 < shuffled(spark, product(spark, frame, (5000, 500)).frame) < 2 * 20_000 * 20


@pytest.mark.parametrize(("held", "grid"), [(1 << 20, 128), (7, 128), (7, 1)])
def test_equal_cells_are_added_up(spark, monkeypatch, held, grid):
    """Cells given several times, partly without a value or a k, in one part, in many, and beyond the most parts."""
    monkeypatch.setattr(lowering, "BROADCAST_CELLS", 1)
    monkeypatch.setattr(pairs, "HELD", held)
    monkeypatch.setattr(pairs, "GRID", grid)
    rng = np.random.default_rng(3)
    rows = [(int(i), int(k), float(x), float(x * 2)) for i, k, x in zip(*(rng.integers(0, 9, 200) for _ in range(3)), strict=True)]
    x = np.zeros((9, 9))
    for i, k, v, _ in rows:
        x[i, k] += v
    more = [(0, 0, None, None)] + ([(0, None, 1.0, 1.0)] if grid > 1 else [])
    out = product(spark, spark.createDataFrame(rows + more, "i long, k long, x double, y double"), (9, 9))
    assert ("CartesianProduct" in out.frame._jdf.queryExecution().executedPlan().toString()) == (grid > 1)
    assert np.array_equal(ts.to_numpy(out), x @ (2 * x).T)


@pytest.mark.parametrize("met", [1, 5, 40, 1 << 20])
@pytest.mark.parametrize("scale", [1, 1 << 33])
@pytest.mark.parametrize("most", [3, 300])
def test_parts_as_runs_make_all_sums(monkeypatch, met, scale, most):
    """Few and many pairs a cell, in chunks of any size; numbers beyond 4 bytes and far apart; values that need 8 bytes."""
    monkeypatch.setattr(pairs, "MET", met)
    monkeypatch.setattr(pairs, "PACKED", 50)
    rng = np.random.default_rng(met + most)
    sides = [[rng.integers(0, most, 120) * scale, rng.integers(0, 6, 120) * scale, rng.integers(-9, 9, 120) / (1 if s else 10)] for s in range(2)]
    want = {}
    for k, i, x in zip(*sides[0], strict=True):
        for own, j, y in zip(*sides[1], strict=True):
            if k == own:
                want[i, j] = want.get((i, j), 0) + x * y
    cells = []
    for k, at, x in sides:
        batch = pa.record_batch([pa.array(np.zeros(120, np.int32)), pa.array(k), pa.array(at), pa.array(x)], names=["part", "k", "at", "x"])
        runs = pa.Table.from_batches(pairs._runs(batch.slice(n, 30) for n in range(0, 120, 30)))
        cells.append(pairs._cells(list(zip(*(runs.column(c).to_pylist() for c in ("size", "k0", "k", "at0", "at", "x")), strict=True))))
    made = [r for b in pairs._products(*cells) for r in b.to_pylist()]
    found = {(r["i"], r["j"]): r["x"] for r in made}
    assert len(found) == len(made) and set(found) == set(want)
    assert all(abs(found[at] - x) < 1e-9 for at, x in want.items())


def test_parts_that_share_nothing_make_nothing():
    left, right = ((np.array([k]), np.array([0]), np.array([1.0])) for k in (1, 2))
    assert not list(pairs._products(left, right)) and not list(pairs._products(pairs._cells([]), right))
