from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellum.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, dims string, row string"
LEAST, MOST = -(2**63), 2**63 - 1


def brute(data, every=100, k=5, m=5, percent=80):
    rows = [(i, label, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, label in data if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for at, (anchor, own, v) in enumerate(rows):
        if anchor % every:
            continue
        scored = [(min(MOST, max(LEAST, sum(a * b for a, b in zip(v, w, strict=True)))), i, label) for n, (i, label, w) in enumerate(rows) if n != at and len(w) == len(v)]
        for ps, pid in sorted(((s, i) for s, i, label in scored if label == own), key=lambda x: (-x[0], x[1]))[:k]:
            fits = sorted(((s, i) for s, i, label in scored if label != own and percent * ps <= 100 * s <= 100 * ps), key=lambda x: (-x[0], x[1]))[:m]
            out += [(anchor, pid, r, i, ps, s) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, data, **options):
    df = spark.createDataFrame([(i, e, label, "a", "b", "c") for i, e, label in data], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("label"), **options).collect())


def vectors(seed, n=900, d=16, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    own = rng.integers(0, labels, n)
    own[: n // 3] = 0  # a label with a third of all rows and more
    return [(i, (centres[own[i]] * 0.6 + rng.normal(size=d) * 0.5).tolist(), int(own[i])) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"piece": 50, "block": 2}, {"positives": 3, "negatives": 8, "percent": 50, "piece": 130}])
def test_equals_brute_force(spark, options):
    data = vectors(1)
    data += [(1000 + i, data[100][1], i % 3) for i in range(40)]  # ties
    data += [(None, data[1][1], 1), (2000, None, 1), (2100, [None] * 16, 1), (2200, [float("nan")] + [0.0] * 15, 1), (2300, [float("inf")] + [0.0] * 15, 1), (2400, [0.0] * 16, 1), (2401, [0.0] * 16, 2), (2402, [0.0] * 16, 1)]
    data += [(2500, [1.0, 2.0], 0), (2501, [3.0, 4.0], 0), (2502, [2.9, 4.0], 1), (2600, [], 0), (2601, [], 0), (2602, [], 1), (2700, data[3][1], None)]
    want = brute(data, k=options.get("positives", 5), m=options.get("negatives", 5), percent=options.get("percent", 80))
    assert len(want) > 50 and run(spark, data, **options) == want


def test_repeated_anchor_rows(spark):
    """Each row of a repeated id is an anchor, and a candidate for the other."""
    data = [(100, [2.0, 0.0], 0), (100, [2.0, 0.5], 0), (1, [1.9, 0.1], 1), (2, [1.7, 0.3], 1), (3, [1.0, 1.0], 0)]
    found = run(spark, data)
    assert found == brute(data) and {r[1] for r in found} >= {100}


def test_large_numbers(spark):
    """Beyond what doubles hold exactly, and beyond 64 bits."""
    data = [(0, [1e15, 1.0], 0), (1, [1e3, 2.0], 0), (2, [9e2, 2.0], 1), (100, [1e30], 0), (101, [1e30], 0), (102, [1e30], 1), (200, [2e9, -3e9], 0), (201, [2e9, 1.0], 0), (202, [1.9e9, 5.0], 1)]
    assert run(spark, data) == brute(data)


@pytest.mark.parametrize("data", [[], [(5, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 2)]])
def test_nothing_to_find(spark, data):
    assert run(spark, data) == []


def test_bit_planes_round_trip():
    rng = np.random.default_rng(2)
    for low, high in ((-1, 1), (0, 2), (-300, 200), (0, 1 << 40), (-(1 << 60), 5), (-8, 8)):
        x = rng.integers(low, high, (37, 5)).astype(float)
        x[0, 0], x[1, 1] = low, high - 1
        bits, raw = hard_negatives.bit_planes(x)
        assert (hard_negatives.Planes(raw, bits, 37, 5).values() == x.astype(np.int64).astype(float)).all()
    bits, raw = hard_negatives.bit_planes(np.array([[1e30, -1.0]]))
    assert bits == 0 and (hard_negatives.Planes(raw, bits, 1, 2).values() == [[1e30, -1.0]]).all()


def test_planes_drop_pairs_early_and_never_wrongly():
    """What refine keeps holds all of the k best; long before the last plane most pairs are gone."""
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(4000, 32)) * 60)
    a = np.floor(rng.normal(size=(20, 32)) * 60)
    bits, raw = hard_negatives.bit_planes(x)
    planes = hard_negatives.Planes(raw, bits, 4000, 32)
    unpacked = []
    plane, planes.plane = planes.plane, lambda b: unpacked.append(b) or plane(b)
    scores = a @ x.T
    lows, highs = np.full((20, 2), -1e4), np.tile([2e4, np.inf], (20, 1))
    i, j, s = hard_negatives.refine(a, planes, np.ones(scores.shape, bool), lows, highs, 5)
    assert unpacked == list(range(bits - 1, -1, -1)) and (s == scores[i, j]).all() and len(i) < 20 * 20
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    for m in range(20):
        for w in range(2):
            inside = [(-scores[m, n], n) for n in range(4000) if lows[m, w] <= scores[m, n] <= highs[m, w]]
            assert all((m, n) in kept for _, n in sorted(inside)[:5] if -sorted(inside)[4][0] < -_)
            assert sum((m, n) in kept for _, n in inside) >= min(5, len(inside))
