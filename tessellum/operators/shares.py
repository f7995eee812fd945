"""Shares of exponentials that do not overflow.

A sum of ``exp(x)`` is kept as (place, sum of ``exp(x - 512 * place)``), a state that merges: sums of one place are
added, and a row counts at its own place and at the next, so that the sums at the highest place hold all
that matters there; what lies 512 below adds less than a factor of 1e-222.  So one aggregate over
(key, place), with partial sums before its exchange, is all that sees the rows; a second one picks the
highest place of each key from one row for each place.

Infinite values and NaN give what ``exp(x) / sum`` gives: all shares are NaN with a NaN, and with an infinite
value its own share is NaN and the others are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exponents of one place; twice as many stay below the largest double.
STEP = 512.0
#: Places above those of all numbers, and below.
_INFINITE, _NAN, _NOTHING = 2.0**1018, 2.0**1019, -(2.0**1018)


def _place(x: Column) -> Column:
    # Doubles from 2**62 on are whole multiples of the step already.
    near = F.when(F.abs(x) < 2.0**62, F.floor(x / STEP).cast("double")).otherwise(x / STEP)
    return F.when(F.isnan(x), F.lit(_NAN)).when(x == float("inf"), F.lit(_INFINITE)).when(x == float("-inf"), F.lit(_NOTHING)).otherwise(near)


def totals(rows: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """(keys.., place, total): the sum of exp(x) by key is total * exp(512 * place)."""
    own = rows.select(*keys, x.alias("value"), _place(x).alias("own"))
    # So far out the next place is the same number.
    alone = F.abs("own") >= 2.0**53
    twice = F.when(alone, F.array(F.col("own"))).otherwise(F.array(F.col("own"), F.col("own") + 1))
    each = own.select(*keys, "value", "own", F.explode(twice).alias("place"))
    part = F.when(F.col("own") >= _INFINITE, F.col("value")).otherwise(F.exp(F.col("value") - F.col("place") * STEP))
    sums = each.groupBy(*keys, "place").agg(F.sum(part).alias("total"), F.max(F.col("own") == F.col("place")).alias("held"))
    top = F.max(F.when(F.col("held"), F.struct("place", "total"))).alias("top")
    best = sums.groupBy(*keys).agg(top) if keys else sums.agg(top)
    return best.select(*keys, F.col("top.place").alias("place"), F.col("top.total").alias("total"))


def share(x: Column) -> Column:
    """exp(x) by the total of its key; where all values are minus infinity that is 0 / 0."""
    return F.when(F.col("total") == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.exp(x - F.col("place") * STEP), F.col("total")))
