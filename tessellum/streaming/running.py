"""Sum reductions over a stream of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_sum(cells: DataFrame, keep: Sequence[int], event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """``C[keep] += A[...]`` over a streaming frame (d0, ..., v): totals of the cells seen so far.

    With an event time, sums are kept for each hour and closed once ``delay`` has passed.
    """
    keys = [F.col(f"d{k}").alias(f"d{i}") for i, k in enumerate(keep)]
    if event_time is None:
        return cells.groupBy(*keys).agg(F.sum("v").alias("v"))
    timed = cells.withWatermark(event_time, delay)
    return timed.groupBy(F.window(event_time, "1 hour").alias("hour"), *keys).agg(F.sum("v").alias("v"))
