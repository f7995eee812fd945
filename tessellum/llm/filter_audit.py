"""How filters interact: SQL CUBE over failure flags, then pairs of subsets.

1. *Flags.*  Every row fails or passes each filter by its whole text alone, and the duplicate filter by
   the least id of its text.  Rows are pre-aggregated before anything is joined on a text, so the copies
   of one text are a row for each part and label however many they are.
2. *Cube.*  ``CUBE (part, flags)`` over the counts by part and flags.  A row of the cube in which every
   selected flag is false counts the rows that survive the selected filters: one row for each subset.
3. *Pairs.*  Step s of an order leads from the subset before it to the subset after it; two joins on
   subsets give what it keeps and removes.  The same pairs give the rest: the first step of a filter
   removes all that fails it, its last step what fails nothing else, and the sum over all orders is
   its share in the sense of Shapley.

Null and empty texts are equal, empty and have no words; a null part is the part ''.  A row without an
id has no place among ids: it neither fails the duplicate filter nor makes others fail it, and has no
label.  Of rows that repeat the least id of a text none fails.  An id whose label rows disagree counts
as 1 where one of them says 1.  Texts of any length are cut into words whole.  An empty table has no
parts and gives no rows.  Columns of other names are not read.  Built-in functions only.
"""

from __future__ import annotations

import functools
import itertools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm import storage

#: Splits texts at runs of white space.
_SPACE = "[\\x20\\x09-\\x0D]+"
#: Groups that rows without an id are dealt to where they are joined by id.
_SPREAD = 1024


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D on a text that is not null: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows by part and the flags A to E: (part, A, ..., E, n, good, toxic)."""
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    flags = text_failures(F.col("text"))
    flagged = given.select("id", "part", F.unhex(F.sha2("text", 256)).alias("print"), *(c.alias(n) for n, c in flags.items()))
    # Repeated rows become one with a count before they meet by id or text.
    once = flagged.groupBy("id", "part", "print", *flags).agg(F.count("*").alias("n"))
    said = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(*said).withColumn("spread", F.lit(0))
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("print"), F.lit(_SPREAD)).cast("int")).otherwise(0)
    marked = once.withColumn("spread", spread).join(marks, ["id", "spread"], "left").fillna(0, ["good", "toxic"])

    known = F.col("id").isNotNull()
    by_text = marked.groupBy("print", "part", "good", "toxic", *flags).agg(
        F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"), F.min(F.when(known, F.struct("id", "n"))).alias("least")
    )
    # A text has a row for each part and label now, whatever the number of its copies.
    first = F.min("least.id").over(Window.partitionBy("print"))
    fresh = F.col("unknown") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    cut = by_text.withColumn("first", first).withColumn("fresh", fresh)
    both = F.array(F.struct(F.lit(False).alias("E"), F.col("fresh").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("fresh")).alias("n")))
    rows = cut.select("part", "good", "toxic", *flags, F.explode(both).alias("x")).select("part", "good", "toxic", *flags, "x.E", "x.n").where("n > 0")
    return rows.groupBy("part", *flags, "E").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(counts: DataFrame, names: list[str], measures: list[str]) -> DataFrame:
    """(part, subset, measures): rows of each part that fail none of a subset's filters, zeros included.

    ``counts`` holds measures by part and flags; bit i of ``subset`` stands for ``names[i]``.
    """
    cube = counts.cube("part", *reversed(names)).agg(*(F.sum(m).alias(m) for m in measures), F.grouping_id().alias("left_out"))
    full = (1 << len(names)) - 1
    failing = functools.reduce(operator.or_, (F.coalesce(F.col(n), F.lit(False)) for n in names))
    cells = cube.where((F.col("left_out") <= full) & ~failing).select("part", (F.lit(full) - F.col("left_out")).cast("int").alias("subset"), *measures)
    grid = cells.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(full))).alias("subset"))
    return grid.join(cells, ["part", "subset"], "left").fillna(0, measures)


def steps(spark, names: list[str]) -> DataFrame:
    """(filter_order, step, filter, before, after) of every order; before and after are subsets."""
    rows = []
    for order in itertools.permutations(range(len(names))):
        before = 0
        for k, i in enumerate(order):
            rows.append(("".join(names[x] for x in order), k + 1, names[i], before, before | 1 << i))
            before |= 1 << i
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def interactions(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row for each part, order and step; ``counts`` as :func:`failure_counts` makes them.

    The orders of n filters are n!, so ``names`` has to be short.
    """
    # A few rows for each part, which the cube's readers share.
    counts = storage.table(counts, "failures")
    subsets = survivors(counts, names, ["n", "good", "toxic"])
    plan = steps(counts.sparkSession, names)
    old = subsets.select("part", F.col("subset").alias("before"), F.col("n").alias("n0"), F.col("good").alias("good0"), F.col("toxic").alias("toxic0"))
    new = subsets.select("part", F.col("subset").alias("after"), F.col("n").alias("kept"), F.col("good").alias("good1"), F.col("toxic").alias("toxic1"))
    paired = old.join(plan, "before").join(new, ["part", "after"])
    removed = paired.select("part", "filter_order", "step", "filter", "before", "after", "kept", (F.col("n0") - F.col("kept")).alias("removed"), (F.col("good0") - F.col("good1")).alias("good_lost"), (F.col("toxic0") - F.col("toxic1")).alias("toxic_lost"))
    each = Window.partitionBy("part", "filter")
    first = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(each)
    alone = F.max(F.when(F.col("after") == (1 << len(names)) - 1, F.col("removed"))).over(each)
    whole = removed.select("*", first.alias("fails"), alone.alias("unique_fails"), F.sum("removed").over(each).alias("shapley"))
    return whole.select("part", "filter_order", "step", *(F.col(c).cast("long").alias(c) for c in ("kept", "removed")), (F.col("fails") - F.col("removed")).cast("long").alias("redundant"), *(F.col(c).cast("long").alias(c) for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The five filters A to E over ``docs`` in all 120 orders."""
    return interactions(failure_counts(docs, labels, id_col, text_col, part_col), list("ABCDE"))
