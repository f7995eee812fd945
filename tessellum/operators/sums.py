"""Sums of doubles that do not depend on the order: exact, rounded once.

Every double is cut into whole numbers of 16 bits at fixed places: the place of its highest digit is its
bin, five whole numbers hold all of its 53 bits.  They are added up by bin as 64-bit whole numbers,
which is exact and merges in any order, with partial sums before the only exchange.  What then is left
of a cell, at most 135 rows, is put together and rounded to the nearest double.

The result is that of exact arithmetic, so any partitioning gives the same bits.  NaN, or infinite values of both
signs, give NaN; infinite values of one sign that value; sums beyond the largest double are infinite.
A cell may sum 2**46 values; beyond, Spark's overflow check ends the query instead of giving a wrong sum.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a part, and parts below the highest one.
_BITS, _PARTS = 16, 4
#: Bins of what has no digits.
_NAN, _UP, _DOWN = 1000, 1001, 1002


def _together(cells: list[dict]) -> float:
    """The double nearest to the sum of some bins."""
    bins = {c["bin"] for c in cells}
    if not bins:
        return 0.0
    if _NAN in bins or {_UP, _DOWN} <= bins:
        return math.nan
    if _UP in bins or _DOWN in bins:
        return math.inf if _UP in bins else -math.inf
    low = min(bins)
    total = 0
    for c in cells:
        parts = 0
        for k in range(_PARTS + 1):
            parts = (parts << _BITS) + c[f"p{k}"]
        total += parts << _BITS * (c["bin"] - low)
    shift = _BITS * (low - _PARTS)
    try:
        return float(total << shift) if shift >= 0 else total / (1 << -shift)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def exact_sum(frame: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys.., x): the exact sum of a value by key, rounded once; without rows, a scalar is 0."""

    @F.pandas_udf("double")
    def rounded(cells: pd.Series) -> pd.Series:
        return pd.Series([_together(list(c)) for c in cells], dtype=float)

    v = F.col("v")
    place = F.floor(F.log2(F.abs(v)) / _BITS).cast("int")
    odd = F.when(F.isnan(v), _NAN).when(v == math.inf, _UP).when(v == -math.inf, _DOWN)
    cut = frame.select(*keys, value.cast("double").alias("v")).withColumn("odd", odd)
    cut = cut.withColumn("bin", F.coalesce("odd", F.when(v == 0, 0).otherwise(place)))
    # Powers of two are exact; in two steps they stay in range.
    half = F.pow(F.lit(2.0), -F.col("bin") * (_BITS // 2))
    cut = cut.withColumn("rest", F.when(F.col("odd").isNull(), v * half * half).otherwise(F.lit(0.0)))
    for k in range(_PARTS + 1):
        cut = cut.withColumn(f"p{k}", F.floor("rest")).withColumn("rest", (F.col("rest") - F.col(f"p{k}").cast("double")) * float(1 << _BITS))
    parts = [f"p{k}" for k in range(_PARTS + 1)]
    bins = cut.groupBy(*keys, "bin").agg(*(F.sum(p).alias(p) for p in parts))
    gathered = F.collect_list(F.struct("bin", *parts)).alias("cells")
    made = bins.groupBy(*keys).agg(gathered) if keys else bins.agg(gathered)
    # NaN comes back from Python as null, and nothing else does.
    return made.select(*keys, F.coalesce(rounded("cells"), F.lit(math.nan)).alias("x"))
