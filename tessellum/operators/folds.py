"""Ordered folds over ranges of any length.

A statement that reads the cell it writes is a loop of steps ``state -> f(state)``.  Steps of some forms
compose into one function of the same form, and composition may be bracketed in any way, so parts of a
range are composed apart and put together in order:

========  ======================================================  ========================================
form      step                                                    composed as
========  ======================================================  ========================================
sum       state + b                                               the sum of b
product   a * state                                               the product of a
affine    a * state + b, a and b free of the state                (a, b) by runs of ``CHUNK``, then runs of runs
least     state + (x < state) * (x - state)                       the least x
most      state + (x > state) * (x - state)                       the greatest x
guarded   state - (state > x) * x, or with >=                     by runs; see :func:`guarded_totals`
loop      anything else                                           not composed: one sorted pass for each cell
========  ======================================================  ========================================

Ranges of at most ``CHUNK`` steps are folded literally, in one array, whatever their form.  Beyond, no array
is longer than that, and sum, product, least and most need none.  Composed steps are rounded in another
order than the loop's: results are equal where the numbers are whole and below 2**53, and the least value
is that value itself, where the loop may add a rounding error to it.  States are expected to be finite; not so
numbers among x are followed as the loop does.  ``loop`` streams through sorted rows and holds a batch of
them, but the steps of one output cell are one task's work.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions import arrays
from tessellum.functions.scalars import NAN
from tessellum.lang.syntax import Call, Index, Infix, Negative, Node, Number, Read, Statement, walk

#: Steps in one array.
CHUNK = 4096


def step_of(statement: Statement) -> Node:
    """The new state as an expression."""
    out = statement.output
    return statement.expression if statement.kind == "=" else Infix(statement.kind[0], out, statement.expression)


def _reads(node: Node, out: Read) -> bool:
    return any(isinstance(n, Read) and n.name == out.name for n in walk(node))


def extreme(node: Node, out: Read) -> tuple[str, Node] | None:
    """("least" or "most", x) for ``out + (x < out) * (x - out)`` and its mirror images."""
    if not (isinstance(node, Infix) and node.operator == "+" and node.left == out and isinstance(node.right, Infix) and node.right.operator == "*"):
        return None
    for mask, gap in ((node.right.left, node.right.right), (node.right.right, node.right.left)):
        if not (isinstance(mask, Infix) and mask.operator in ("<", ">", "<=", ">=") and isinstance(gap, Infix) and gap.operator == "-" and gap.right == out):
            continue
        x, below = gap.left, mask.operator[0] == "<"
        if _reads(x, out):
            continue
        if (mask.left, mask.right) == (x, out):
            return ("least" if below else "most"), x
        if (mask.left, mask.right) == (out, x):
            return ("most" if below else "least"), x
    return None


def guarded(node: Node, out: Read) -> tuple[Node, bool] | None:
    """(x, whether equality subtracts) for ``out - (out > x) * x`` and its mirror images."""
    if not (isinstance(node, Infix) and node.operator == "-" and node.left == out and isinstance(node.right, Infix) and node.right.operator == "*"):
        return None
    for mask, x in ((node.right.left, node.right.right), (node.right.right, node.right.left)):
        if isinstance(mask, Infix) and not _reads(x, out):
            if (mask.left, mask.right) == (out, x) and mask.operator in (">", ">="):
                return x, mask.operator == ">="
            if (mask.left, mask.right) == (x, out) and mask.operator in ("<", "<="):
                return x, mask.operator == "<="
    return None


def guarded_totals(rows: DataFrame, at: Column, x: Column) -> DataFrame:
    """(run, s, high, low, odd) of runs of ``CHUNK`` steps ``state - (state > x) * x``.

    A run subtracts its sum s from any state above ``high``, the greatest of each x and all before it, and
    leaves a state alone that no x but 0 is below, ``low`` being the least; only states between need its steps.
    """
    placed = rows.select(at.cast("bigint").alias("at"), x.cast("double").alias("x"))
    runs = placed.groupBy(F.expr(f"at div {CHUNK}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("steps"))
    begin = F.struct(F.lit(0.0).alias("s"), F.lit(-math.inf).alias("high"))
    step = lambda f, c: F.struct((f["s"] + c["x"]).alias("s"), F.when(c["x"] != 0, F.greatest(f["high"], f["s"] + c["x"])).otherwise(f["high"]).alias("high"))
    least = F.array_min(F.transform("steps", lambda c: F.when(c["x"] != 0, c["x"])))
    odd = F.exists("steps", lambda c: F.isnan(c["x"]) | (F.abs(c["x"]) == math.inf))
    return runs.select("run", F.aggregate("steps", begin, step).alias("f"), F.coalesce(least, F.lit(math.inf)).alias("low"), odd.alias("odd")).select("run", "f.s", "f.high", "low", "odd")


Part = Node | None


def _plus(a: Part, b: Part, operator: str) -> Part:
    if b is None:
        return a
    if a is None:
        return b if operator == "+" else Infix("*", Number(-1.0, "-1"), b)
    return Infix(operator, a, b)


def affine(node: Node, out: Read) -> tuple[Part, Part] | None:
    """(a, b) of ``a * out + b``, None for 0; None if the expression has another form."""
    if node == out:
        return Number(1.0, "1"), None
    if not _reads(node, out):
        return None, node
    match node:
        case Negative():
            inner = affine(node.inner, out)
            return None if inner is None else tuple(_plus(None, p, "-") if p is not None else None for p in inner)
        case Infix(operator=("+" | "-") as operator):
            left, right = affine(node.left, out), affine(node.right, out)
            return None if left is None or right is None else (_plus(left[0], right[0], operator), _plus(left[1], right[1], operator))
        case Infix(operator="*"):
            state, free = (node.left, node.right) if _reads(node.left, out) else (node.right, node.left)
            inner = affine(state, out)
            return None if inner is None or _reads(free, out) else tuple(p if p is None else Infix("*", p, free) for p in inner)
        case Infix(operator="/") if not _reads(node.right, out):
            inner = affine(node.left, out)
            return None if inner is None else tuple(p if p is None else Infix("/", p, node.right) for p in inner)
    return None


def form(statement: Statement) -> str:
    """How a statement that reads its output is folded over a range longer than ``CHUNK``."""
    step, out = step_of(statement), statement.output
    found = extreme(step, out)
    if found is not None:
        return found[0]
    parts = affine(step, out)
    if parts is None:
        return "loop"
    if parts[0] == Number(1.0, "1"):
        return "sum"
    return "product" if parts[1] is None else "affine"


def composed(statement: Statement, rows: DataFrame, keys: list[str], at: Column, steps: int, column: Callable[[Node], Column]) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(frame by keys, result of a state) of a statement whose :func:`form` is not ``loop``.

    ``rows`` hold one step each, ``at`` is its place in the range of ``steps``, ``column`` makes an
    expression free of the state.
    """
    step, out, kind = step_of(statement), statement.output, form(statement)

    def grouped(frame: DataFrame, *aggregates: Column) -> DataFrame:
        return frame.groupBy(*keys).agg(*aggregates) if keys else frame.agg(*aggregates)

    if kind in ("least", "most"):
        best, end, wrong = (F.min, -math.inf, math.inf) if kind == "least" else (F.max, math.inf, -math.inf)
        x = F.col("x")
        made = rows.select(*keys, at.alias("at"), column(extreme(step, out)[1]).alias("x"))
        # Infinite steps: towards the end of the order they win and spoil the next step, the others spoil their own.
        spoilt = F.count_if(F.isnan(x) | (x == wrong)).alias("spoilt")
        frame = grouped(made, best("x").alias("x"), spoilt, F.count_if(x == end).alias("ends"), F.max_by("x", "at").alias("last"))

        def result(state: Column) -> Column:
            better = F.least(state, x) if kind == "least" else F.greatest(state, x)
            odd = (F.col("spoilt") > 0) | (F.col("ends") > 1) | ((F.col("ends") == 1) & (F.col("last") != end))
            return F.when(odd, F.lit(NAN)).otherwise(better)

        return frame, result
    a, b = affine(step, out)
    if kind == "sum":
        frame = grouped(rows.select(*keys, (column(b) if b is not None else F.lit(0.0)).alias("x")), F.sum("x").alias("x"))
        return frame, lambda state: state + F.col("x")
    if kind == "product":
        frame = grouped(rows.select(*keys, (column(a) if a is not None else F.lit(0.0)).alias("x")), F.product("x").alias("x"))
        return frame, lambda state: state * F.col("x")
    parts = rows.select(*keys, at.cast("bigint").alias("at"), *((column(p) if p is not None else F.lit(0.0)).alias(n) for p, n in ((a, "a"), (b, "b"))))

    def then(f: Column, g: Column) -> Column:
        """g after f.  What f adds as 0 stays 0 under any factor."""
        carried = F.when(f["b"] == 0, F.lit(0.0)).otherwise(g["a"] * f["b"])
        return F.struct((g["a"] * f["a"]).alias("a"), (carried + g["b"]).alias("b"))

    left = steps
    while left > 1:
        runs = parts.groupBy(*keys, F.expr(f"at div {CHUNK}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("at", "a", "b"))).alias("steps"))
        whole = F.aggregate("steps", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), then)
        parts = runs.select(*keys, F.col("run").alias("at"), whole.alias("f")).select(*keys, "at", "f.a", "f.b")
        left = -(-left // CHUNK)
    return parts.select(*keys, "a", "b"), lambda state: F.col("a") * state + F.col("b")


def _walked(state: float, until: float, inclusive: bool, batches: Iterator[pa.RecordBatch]) -> tuple[float, float | None]:
    """The state after some runs, and the first run, from ``until`` on, whose steps it needs."""
    for batch in batches:
        for run, s, high, low, odd in zip(*(batch.column(c).to_pylist() for c in ("run", "s", "high", "low", "odd")), strict=True):
            if run < until:
                continue
            if not odd and (state > high or (inclusive and state == high)):
                state -= s
            elif odd or not (state < low or (not inclusive and state == low)):
                return state, run
    return state, None


#: Runs whose steps are looked up one after another; with more, all steps are streamed.
MOST_LOOKUPS = 64


def guarded_fold(statement: Statement, totals: DataFrame, steps: DataFrame, state: float, at: Column, x: Column) -> float | None:
    """The state of a scalar loop of guarded steps from the ``totals`` of its runs; None if too many runs need their steps.

    Totals are walked in order in one task, a row for each ``CHUNK`` steps.  A run that needs its steps has
    only these read from ``steps``.
    """
    inclusive, begin = guarded(step_of(statement), statement.output)[1], 0
    ordered = totals.coalesce(1).sortWithinPartitions("run")
    for _ in range(MOST_LOOKUPS):

        def walk_on(batches: Iterator[pa.RecordBatch], state: float = state, begin: int = begin) -> Iterator[pa.RecordBatch]:
            made, run = _walked(state, begin, inclusive, batches)
            yield pa.record_batch([pa.array([made]), pa.array([run], pa.int64())], names=["state", "run"])

        found = ordered.mapInArrow(walk_on, "state double, run long").first()
        state, run = found["state"], found["run"]
        if run is None:
            return state
        own = steps.where((at >= run * CHUNK) & (at < (run + 1) * CHUNK)).select(at.alias("at"), x.cast("double").alias("x"))
        for r in sorted(own.collect()):
            if state > r["x"] or (inclusive and state == r["x"]):
                state -= r["x"]
            elif math.isnan(r["x"]) or math.isinf(r["x"]):
                state -= 0.0 * r["x"]
        begin = run + 1
    return None


def _scalar(node: Node, out: Read, places: dict[Read | str, int], loose: bool) -> Callable[[float, tuple], float]:
    """An expression as a function of the state and a row, with the results of the column forms."""
    match node:
        case Number():
            return lambda s, r, v=node.value: v
        case Index():
            return lambda s, r, k=places[node.name]: float(r[k])
        case Read():
            if node.name == out.name:
                return lambda s, r: s
            return lambda s, r, k=places[node]: r[k]
        case Negative():
            inner = _scalar(node.inner, out, places, loose)
            return lambda s, r: -inner(s, r)
        case Call():
            inner, f = _scalar(node.inner, out, places, loose), arrays.function(node.function)
            return lambda s, r: float(f(inner(s, r)))
    f, g, op = _scalar(node.left, out, places, loose), _scalar(node.right, out, places, loose), node.operator
    plain = {
        "+": lambda s, r: f(s, r) + g(s, r),
        "-": lambda s, r: f(s, r) - g(s, r),
        "*": lambda s, r: f(s, r) * g(s, r),
        "<": lambda s, r: 1.0 if f(s, r) < g(s, r) else 0.0,
        ">": lambda s, r: 1.0 if f(s, r) > g(s, r) else 0.0,
        "<=": lambda s, r: 1.0 if f(s, r) <= g(s, r) else 0.0,
        ">=": lambda s, r: 1.0 if f(s, r) >= g(s, r) else 0.0,
    }
    if op in plain:
        return plain[op]
    slow = arrays.operator(op, loose)
    return lambda s, r: float(slow(f(s, r), g(s, r)))


def streamed(statement: Statement, rows: DataFrame, keys: list[str], at: Column, names: dict[Read, str], loose: bool) -> DataFrame:
    """(keys.., x): every output cell's steps in order, in one sorted pass.  ``rows`` hold the state to begin with too."""
    step, out = step_of(statement), statement.output
    reads = [r for r in statement.reads if r.name != out.name]
    letters = [n.name for n in dict.fromkeys(n for n in walk(step) if isinstance(n, Index))]
    wanted = ["state", *(names[r] for r in reads), *(f"at_{c}" for c in letters)]
    places = {**{r: k + 1 for k, r in enumerate(reads)}, **{c: k + 1 + len(reads) for k, c in enumerate(letters)}}
    dealt = rows.select(*keys, at.cast("bigint").alias("at"), "state", *(names[r] for r in reads), *(F.col(c).alias(f"at_{c}") for c in letters))
    dealt = (dealt.repartition(*keys) if keys else dealt.coalesce(1)).sortWithinPartitions(*keys, "at")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _scalar(step, out, places, loose)

        def done(closed: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*closed, strict=True))
            return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:width]), pa.array(columns[width], pa.float64())], names=[*keys, "x"])

        key, state, closed = None, 0.0, []
        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in keys), strict=True) if width else itertools.repeat(())
            for own, row in zip(cells, zip(*(batch.column(c).to_pylist() for c in wanted), strict=True), strict=bool(width)):
                if own != key:
                    if key is not None:
                        closed.append((*key, state))
                    key, state = own, row[0]
                state = f(state, row)
            if len(closed) >= 4096:
                yield done(closed)
                closed = []
        if key is not None:
            closed.append((*key, state))
        if closed:
            yield done(closed)

    return dealt.mapInArrow(run, ", ".join([*(f"{k} long" for k in keys), "x double"]))
