from __future__ import annotations

import math

import numpy as np
import pytest

from tessellum.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def brute(data, every=100, k=10):
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in data if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    asked = {}
    for i, v in whole:
        if i % every == 0:
            asked.setdefault(i, v)
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, data, **options):
    df = spark.createDataFrame([(i, e, 0, "x") for i, e in data], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, **options).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    lengths = rng.lognormal(0, 1, 900)
    data = [(i, (rng.normal(size=16) * lengths[i]).tolist()) for i in range(900)]
    data += [(1000 + i, data[7][1]) for i in range(40)]  # ties
    data += [(None, data[1][1]), (2000, None), (2100, [None] * 16), (2200, [float("nan")] + [0.0] * 15), (2300, [float("inf")] + [0.0] * 15), (2400, [0.0] * 16), (2500, [1.0, 2.0]), (2501, [3.0, 4.0]), (2600, [])]
    assert run(spark, data) == brute(data)
    assert run(spark, data, query_block=3, lead=4) == brute(data)
    assert run(spark, data, query_block=4, shard=100, k=3) == brute(data, k=3)


def test_few_and_large(spark):
    data = [(0, [1.0, -2.0]), (1, [3.0, 0.5]), (100, [1e9, 1.0])]
    assert run(spark, data) == brute(data)
    with_huge = run(spark, [(0, [1e30]), (1, [1e30]), (2, [-1e30])])
    assert with_huge == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_repeated_query_ids(spark):
    """The least vector asks, whatever the order of rows; other rows of the id are no candidates."""
    data = [(100, [2.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0]), (100, [1.0, 5.0])]
    want = [(100, 1, 2, 15 * 1024**2), (100, 2, 1, 6 * 1024**2)]
    assert run(spark, data) == run(spark, data[::-1]) == want


@pytest.mark.parametrize("data", [[], [(5, [1.0])], [(100, [1.0])]])
def test_nothing_to_find(spark, data):
    assert run(spark, data) == []
