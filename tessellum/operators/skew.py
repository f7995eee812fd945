"""Joins on an index of which a few values hold much of the rows, and without any index.

A value of the shared index is heavy if it holds more than one in ``SHARES`` of a side's rows; there are at
most ``SHARES`` of them, so their list is broadcast.  The rows of a heavy value are dealt into as many parts
as it has shares, and only the other side's rows of that value are copied, once for each part; all other rows
stay as they are.  Both sides are treated in turn, so a value that is heavy on both meets in a grid of
parts.  Counting needs one aggregate of each side by the index, with partial counts before its exchange.

An outer product has as many rows as its sides multiplied, whatever is done; as a grid, each side is dealt
into parts of about ``EDGE`` rows and every pair of parts meets by its numbers, so tasks are even and a row
is copied once for each ``EDGE`` rows that it is multiplied with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The part of a side's rows that one task may get, as one in so many, and the most heavy values.
SHARES = 256
#: Rows of a side in one part of a grid.
EDGE = 4096


def heavy(frame: DataFrame, keys: list[str], shares: int, name: str) -> DataFrame:
    """(keys.., parts): values that hold more than one in ``shares`` of the rows, and how many parts they are dealt into."""
    counts = frame.groupBy(*keys).agg(F.count("*").alias("rows"))
    total = frame.agg(F.count("*").alias("total"))
    parts = F.ceil(F.col("rows") * shares / F.col("total")).cast("int")
    return counts.join(F.broadcast(total), F.col("rows") * shares > F.col("total")).select(*keys, parts.alias(name))


def sides(left: DataFrame, right: DataFrame, keys: list[str], shares: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of such a join, with the numbers ``_l`` and ``_r`` of the parts that meet."""
    shares = shares or SHARES
    # At most ``shares`` rows each, by their definition.
    found = [F.broadcast(heavy(side, keys, shares, name)) for side, name in ((left, "_l"), (right, "_r"))]

    def dealt(frame: DataFrame, own: int) -> DataFrame:
        """Rows with the numbers of both sides' parts: their own by a hash, the other's all."""
        marked = frame
        for h in found:
            marked = marked.join(h, keys, "left")
        names = ("_l", "_r")
        rest = [c for c in frame.columns if c not in keys]
        part = F.pmod(F.xxhash64(*rest), F.coalesce(names[own], F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce(names[1 - own], F.lit(1)) - 1))
        placed = marked.withColumn("_own", part).withColumn("_other", other).drop(*names)
        return placed.withColumnsRenamed({"_own": names[own], "_other": names[1 - own]})

    return dealt(left, 0), dealt(right, 1)


def join(left: DataFrame, right: DataFrame, keys: list[str], shares: int | None = None) -> DataFrame:
    """An inner join on ``keys``; no pair of parts holds more than about one in ``shares`` of either side."""
    left, right = sides(left, right, keys, shares)
    return left.join(right, [*keys, "_l", "_r"]).drop("_l", "_r")


def grid(left: DataFrame, right: DataFrame, left_rows: int, right_rows: int) -> DataFrame:
    """All pairs of rows, as an equi-join of numbered parts."""
    down, across = (max(1, -(-n // EDGE)) for n in (left_rows, right_rows))

    def dealt(frame: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        return frame.withColumn(own, F.pmod(F.xxhash64(*frame.columns), F.lit(parts)).cast("int")).withColumn(other, each)

    pairs = dealt(left, "_l", down, "_r", across).join(dealt(right, "_r", across, "_l", down), ["_l", "_r"])
    return pairs.drop("_l", "_r")
