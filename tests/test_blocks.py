"""Tensors stored in blocks: what slices read and write, and what an interrupted write leaves."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessellum as ts
from tessellum.sources import blocks

A = np.arange(40.0 * 30).reshape(40, 30)


@pytest.fixture
def path(spark, tmp_path):
    blocks.write_blocks(ts.from_values(spark, A), str(tmp_path / "a"), (5, 5), 60)
    return str(tmp_path / "a")


def files(spark, path):
    return {r["file"]: r for r in blocks.manifest(spark, path).collect()}




def test_round_trip(spark, path):
    back = blocks.read_blocks(spark, path)
    assert np.array_equal(ts.to_numpy(back), A)
    listed = files(spark, path)
    assert len(listed) > 10 and sum(r["cells"] for r in listed.values()) == A.size


def test_slices_read_files_that_meet_them(spark, path):
    back, count = blocks.read_blocks(spark, path), len(files(spark, path))
    for code, want in (("R[j] = T[7,j]", A[7]), ("R[i] = T[i,12]", A[:, 12]), ("R = T[39,0]", A[39, 0]), ("R[i] = T[i,j]", A[:, -1]), ("R += T[3,j]", A[3].sum())):
        out = ts.compile(code).execute({"T": back}, spark=spark)["R"]
        assert np.array_equal(ts.to_numpy(out), want)
        assert len(out.frame.inputFiles()) <= count / 3
    cell = ts.compile("R = T[39,0]").execute({"T": back}, spark=spark)["R"]
    assert len(cell.frame.inputFiles()) <= 2


def test_rows_read_for_a_slice(spark, tmp_path):
    """Of a stored tensor of many files, a slice reads under a tenth: by the scan's own count of files."""
    shape = (400, 7)
    grid = ts.tensor.coordinates(spark, shape).withColumn("v", (F.col("d0") * 7 + F.col("d1")).cast("double"))
    blocks.write_blocks(ts.Tensor(grid, shape), str(tmp_path / "b"), (8, 7), 100)
    back = blocks.read_blocks(spark, str(tmp_path / "b"))
    out = ts.compile("R[j] = T[123,j]").execute({"T": back}, spark=spark)["R"]
    assert ts.to_numpy(out).tolist() == [123 * 7.0 + k for k in range(7)]
    assert 10 * len(out.frame.inputFiles()) <= len(back.frame.inputFiles())


def test_a_slice_replaces_only_files_that_meet_it(spark, path):
    before = files(spark, path)
    new = np.arange(30.0) * -1
    blocks.write_slice(ts.from_values(spark, new), path, {0: 7})
    after, want = files(spark, path), A.copy()
    want[7] = new
    assert np.array_equal(ts.to_numpy(blocks.read_blocks(spark, path)), want)
    touched = {f for f, r in before.items() if r["low_d0"] <= 7 <= r["high_d0"]}
    assert set(before) - touched == set(before) & set(after) and len(touched) < len(before) / 2
    blocks.write_slice(ts.from_values(spark, np.array(5.0)), path, {0: 0, 1: 29})
    want[0, 29] = 5
    assert np.array_equal(ts.to_numpy(blocks.read_blocks(spark, path)), want)


def test_the_number_of_files_is_bounded(spark, tmp_path, monkeypatch):
    """Files of a large tensor hold more cells; a slice that is replaced does not cut them up again."""
    monkeypatch.setattr(blocks, "MOST_FILES", 8, raising=False)
    place, want = str(tmp_path / "m"), A.copy()
    blocks.write_blocks(ts.from_values(spark, A), place, (5, 5), 10)
    assert 4 < len(files(spark, place)) <= 8
    for row in (7, 7, 30):
        blocks.write_slice(ts.from_values(spark, np.arange(30.0) - row), place, {0: row})
        want[row] = np.arange(30.0) - row
    assert len(files(spark, place)) <= 16 and np.array_equal(ts.to_numpy(blocks.read_blocks(spark, place)), want)


def test_an_interrupted_write_leaves_the_old_version(spark, path, monkeypatch, tmp_path):
    reader = blocks.read_blocks(spark, path)
    monkeypatch.setattr(blocks, "_write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        blocks.write_slice(ts.from_values(spark, np.zeros(30)), path, {0: 7})
    (tmp_path / "a" / "manifests" / "2").mkdir()  # begun, without its mark
    assert np.array_equal(ts.to_numpy(blocks.read_blocks(spark, path)), A)
    monkeypatch.undo()
    blocks.write_slice(ts.from_values(spark, np.zeros(30)), path, {0: 7})
    want = A.copy()
    want[7] = 0
    assert np.array_equal(ts.to_numpy(blocks.read_blocks(spark, path)), want)
    assert np.array_equal(ts.to_numpy(reader), A)  # whoever began earlier keeps his version


def test_sparse_tensors(spark, tmp_path):
    x = np.where(A % 7 == 0, A, 0)
    cells = ts.from_cells(spark.createDataFrame([(i, j, float(x[i, j])) for i, j in itertools.product(range(40), range(30)) if x[i, j]], "i long, j long, x double"), ["i", "j"], "x", x.shape)
    blocks.write_blocks(cells, str(tmp_path / "s"), (5, 5), 20)
    back = blocks.read_blocks(spark, str(tmp_path / "s"))
    assert back.sparse and np.array_equal(ts.to_numpy(back), x)
    blocks.write_slice(ts.from_values(spark, np.ones(40)), str(tmp_path / "s"), {1: 3})
    x[:, 3] = 1
    assert np.array_equal(ts.to_numpy(blocks.read_blocks(spark, str(tmp_path / "s"))), x)


def test_errors(spark, path, tmp_path):
    with pytest.raises(ValueError, match="blocks"):
        blocks.read_blocks(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="scalar"):
        blocks.write_blocks(ts.from_values(spark, 1.0), str(tmp_path / "x"))
    for part, axes in ((np.zeros(29), {0: 7}), (np.zeros(30), {0: 40})):
        with pytest.raises(ValueError, match="slice"):
            blocks.write_slice(ts.from_values(spark, part), path, axes)


@pytest.mark.parametrize("counts", [(5, 3), (1, 8), (4, 4, 2), (7,)])
def test_morton_numbers_are_different_and_near(spark, counts):
    grid = ts.tensor.coordinates(spark, counts)
    made = grid.withColumn("z", blocks.morton([F.col(f"d{k}") for k in range(len(counts))], counts)).collect()
    assert len({r["z"] for r in made}) == int(np.prod(counts))
    assert all(r["z"] >> sum(max(1, (n - 1).bit_length()) for n in counts) == 0 for r in made)
