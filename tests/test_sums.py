"""Exact sums: the same bits in any order, equal to exact arithmetic."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import tessellum as ts
from tessellum.operators import sums


def exact(values):
    total = sum(map(Fraction, values))
    try:
        return total.numerator / total.denominator
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def bits(x):
    return np.float64(x).tobytes() if x == x else b"nan"


def test_any_partitioning_gives_the_same_bits(spark):
    rng = random.Random(4)
    values = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-300, 300) for _ in range(3000)]
    values += [5e-324, -5e-324, 2.0**-1022, 1.7e308, -1.7e308, 0.0, -0.0, 2.0**48, 2.0**48 - 2.0**-4, 65536.0, 65535.99999999999]
    rng.shuffle(values)
    frame = spark.createDataFrame([(k % 7, v) for k, v in enumerate(values)], "g long, v double")
    want = {g: bits(exact(values[g::7])) for g in range(7)}
    plain = set()
    for parts in (1, 4, 64):
        dealt = frame.repartition(parts)
        plain.add(dealt.agg({"v": "sum"}).first()[0])
        assert bits(sums.exact_sum(dealt, [], dealt["v"]).first()["x"]) == bits(exact(values))
        assert {r["g"]: bits(r["x"]) for r in sums.exact_sum(dealt, ["g"], dealt["v"]).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=12))
def test_parts_hold_every_double(values):
    """The cut into whole numbers, as the columns make it."""
    cells = []
    for v in values:
        place = math.floor(math.log2(abs(v)) / 16) if v else 0
        rest, parts = v * 2.0 ** (-8 * place) * 2.0 ** (-8 * place), {}
        for k in range(5):
            parts[f"p{k}"] = math.floor(rest)
            rest = (rest - parts[f"p{k}"]) * 65536.0
        assert rest == 0
        cells.append({"bin": place, **parts})
    assert not values or sums._together(cells) == exact(values)


@pytest.mark.parametrize(("values", "want"), [([math.nan, 1.0], math.nan), ([math.inf, -math.inf], math.nan), ([math.inf, 1.0], math.inf), ([-math.inf, 1e308], -math.inf), ([1.7e308, 1.7e308], math.inf), ([], 0.0), ([0.1] * 10, 1.0), ([1e100, 1.0, -1e100], 1.0)])
def test_special_values(spark, values, want):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert bits(sums.exact_sum(frame, [], frame["v"]).first()["x"]) == bits(want)


def test_programs_with_exact_sums(spark):
    x = np.array([[1e100, 1.0, -1e100], [0.1, 0.2, 0.3]])
    given = {"X": ts.from_values(spark, x)}
    out = ts.compile("R[i] += X[i,j]\nT -= X[i,j]\nC[i,j] += X[i,j]").execute(given, spark=spark, exact=True)
    assert ts.to_numpy(out["R"]).tolist() == [1.0, exact([0.1, 0.2, 0.3])]
    assert ts.to_numpy(out["T"]) == -exact([1.0, 0.1, 0.2, 0.3]) and np.array_equal(ts.to_numpy(out["C"]), x)
    sparse = {"X": ts.from_cells(given["X"].frame, ["d0", "d1"], "v", (2, 3))}
    assert ts.to_numpy(ts.compile("R[i] += X[i,j] * X[i,j]").execute(sparse, spark=spark, exact=True)["R"]).tolist() == [exact([1e100 * 1e100, 1.0, 1e100 * 1e100]), exact([0.1 * 0.1, 0.2 * 0.2, 0.3 * 0.3])]
