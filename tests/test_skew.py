"""Joins where one value of the index holds half of the rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessellum as ts
from tessellum.operators import lowering, skew


def sides(spark, n=4000):
    left = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).cast("long").alias("k"), F.col("id").alias("i"), F.lit(1.0).alias("x"))
    right = spark.range(400).select(F.when(F.col("id") < 40, 0).otherwise(F.col("id") % 97).cast("long").alias("k"), F.col("id").alias("j"), F.lit(2.0).alias("y"))
    return left, right


@pytest.mark.parametrize("shares", [1, 4, 64])
def test_the_same_rows(spark, shares):
    left, right = sides(spark)
    want = Counter(map(tuple, left.join(right, "k").select("k", "i", "x", "j", "y").collect()))
    assert Counter(map(tuple, skew.join(left, right, ["k"], shares).select("k", "i", "x", "j", "y").collect())) == want


def test_tasks_are_even(spark):
    """The largest task has at most twice the mean; joined plainly, the heavy value's has over half."""
    left, right = sides(spark)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)

        def loads(joined):
            return [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]

        plain, even = loads(left.join(right, "k")), loads(skew.join(left, right, ["k"], 64))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(plain) == sum(even) and max(plain) > sum(plain) / 2 and max(even) <= 2 * sum(even) / 8


def test_few_values_are_heavy(spark):
    left, right = sides(spark)
    assert [(r["k"], r["n"]) for r in skew.heavy(left, ["k"], 20, "n").collect()] == [(0, 11)]
    assert skew.heavy(right, ["k"], 20, "n").count() <= 20


def test_contractions_of_stored_cells_deal_heavy_values(spark, monkeypatch):
    monkeypatch.setattr(lowering, "BROADCAST_CELLS", 10)
    rng = np.random.default_rng(1)
    x, y = (rng.integers(1, 4, (60, 30)) * (rng.random((60, 30)) < 0.05) for _ in range(2))
    x[:, 3], y[:20, 3] = 1, 2  # one index value with half of the rows

    def stored(v):
        rows = [(int(i), int(j), float(v[i, j])) for i, j in zip(*np.nonzero(v), strict=True)]
        return ts.from_cells(spark.createDataFrame(rows, "i long, j long, x double"), ["i", "j"], "x", v.shape)

    out = ts.compile("R[i,m] += X[i,k] * Y[m,k]").execute({"X": stored(x), "Y": stored(y)}, spark=spark)["R"]
    assert np.array_equal(ts.to_numpy(out), x @ y.T)
    assert "_l" in out.frame._jdf.queryExecution().analyzed().toString()


def test_outer_products_meet_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(lowering, "BROADCAST_CELLS", 10)
    monkeypatch.setattr(skew, "EDGE", 7)
    b, c = np.arange(20.0) - 5, np.arange(33.0) * 2
    out = ts.compile("R[i,j] = B[i] * C[j] + 1").execute({"B": ts.from_values(spark, b), "C": ts.from_values(spark, c)}, spark=spark)["R"]
    assert np.array_equal(ts.to_numpy(out), np.outer(b, c) + 1)
    plan = out.frame._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
