"""Replacing sorted spans of code points in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with its (start, end) spans replaced by ``mark``.

    Spans are sorted by start; overlapping ones count as one.  Built-in functions only.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, span):
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        inside = span["start"] < state["at"]
        parts = F.when(inside, state["parts"]).otherwise(F.concat(state["parts"], F.array(gap, F.lit(mark))))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), parts.alias("parts"))

    def finish(state):
        return F.array_join(F.concat(state["parts"], F.array(F.substring(text, state["at"] + 1, F.lit(2147483647)))), "")

    return F.aggregate(spans, start, step, finish)
