"""Sums over an ordering mask as range lookups.

``Out[i..] += (X[j..] < Y[i..]) * W[j..] * U[i..]`` adds, for each cell of Y, the weights of all smaller cells of X.
Instead of comparing all pairs, the distinct values of both sides are put in order once, with the weight
that X has at each, and running sums tell what lies below or above: n log n work and no product of the
sides.

Values are cut into runs of about ``RUN`` cells at quantiles, each run is summed in one task, and what lies
in earlier runs is added from one row for each run.  Equal values are one row beforehand, so ties do not
gather.  Index variables that both sides and the output share split everything by key.  NaN is neither
below nor above anything, -0.0 equals 0.0, infinite values are in order, as the language has it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.lang.syntax import Infix, Node, Number, Read, Statement

#: Cells in a run, and the most runs; beyond, runs grow.
RUN = 1 << 20
MOST_RUNS = 4096
_MIRROR = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True)
class Ordering:
    """``scale * sum of weights where x operator y``."""

    x: Read
    operator: str
    y: Read
    keys: tuple[str, ...]
    weights: tuple[Read, ...]
    factors: tuple[Read, ...]
    scale: float


def _factors(node: Node) -> list[Node]:
    if isinstance(node, Infix) and node.operator == "*":
        return [*_factors(node.left), *_factors(node.right)]
    return [node]


def recognise(statement: Statement) -> Ordering | None:
    """The parts of a sum of weights over one ordering mask between a reduced and a kept tensor; else None."""
    if statement.kind not in ("+=", "-="):
        return None
    out = set(statement.output.letters)
    masks, reads, scale = [], [], 1.0
    for f in _factors(statement.expression):
        if isinstance(f, Number):
            scale *= f.value
        elif isinstance(f, Read):
            reads.append(f)
        elif isinstance(f, Infix) and f.operator in _MIRROR and isinstance(f.left, Read) and isinstance(f.right, Read):
            masks.append(f)
        else:
            return None
    if len(masks) != 1:
        return None
    (mask,) = masks
    x, operator, y = mask.left, mask.operator, mask.right
    if set(y.letters) - out:
        x, operator, y = y, _MIRROR[operator], x
    keys = tuple(c for c in x.letters if c in out)
    reduced = set(x.letters) - out
    if not reduced or set(y.letters) != out or set(keys) - set(y.letters) or set(statement.index_variables) != set(x.letters) | out:
        return None
    weights = tuple(r for r in reads if set(r.letters) - out)
    factors = tuple(r for r in reads if not set(r.letters) - out)
    if any(set(r.letters) - set(x.letters) for r in weights):
        return None
    return Ordering(x, operator, y, keys, weights, factors, scale)


def sums(points: DataFrame, asked: DataFrame, keys: list[str], operator: str, cells: int, run: int | None = None) -> DataFrame:
    """(keys.., v, total) for each distinct v of ``asked``: the sum of w over ``points`` (keys.., v, w) with point operator v."""
    size = run or RUN
    marked = points.select(*keys, "v", "w").unionByName(asked.select(*keys, "v", F.lit(0.0).alias("w"))).where(~F.isnan("v"))
    placed = marked.groupBy(*keys, "v").agg(F.sum("w").alias("w"))
    parts = min(MOST_RUNS, max(1, math.ceil(cells / size)))
    bounds: list[float] = []
    if parts > 1:
        # One small job: the bounds have to be the same wherever the plan is run again.
        finite = marked.where(F.abs("v") < float("inf"))
        found = finite.agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"]
        bounds = sorted(set(found or []))
    rising = operator[0] == "<"
    order = F.col("v").asc() if rising else F.col("v").desc()
    number = F.lit(0) if not bounds else _run_of(F.col("v"), bounds)
    last = 0 if operator.endswith("=") else -1
    inside = Window.partitionBy(*keys, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    cut = placed.withColumn("run", number)
    local = cut.withColumn("inside", F.coalesce(F.sum("w").over(inside), F.lit(0.0)))
    if not bounds:
        return local.select(*keys, "v", F.col("inside").alias("total"))
    totals = cut.groupBy(*keys, "run").agg(F.sum("w").alias("w"))
    before = Window.partitionBy(*keys).orderBy(F.col("run").asc() if rising else F.col("run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "run", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("before"))
    return local.join(starts, [*keys, "run"]).select(*keys, "v", (F.col("before") + F.col("inside")).alias("total"))


def _run_of(value: Column, bounds: list[float]) -> Column:
    """How many bounds lie below a value, by halving a padded list."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    padded = [*bounds, *[float("nan")] * (2 * steps[0] - 1 - len(bounds))]
    listed = F.array(*map(F.lit, padded))
    # NaN is above all numbers here, so padding is never below a value.
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) < value, at + step).otherwise(at))
