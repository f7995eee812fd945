"""One statement as a DataFrame.

Subscripts become filters and renames, shared index variables equi-joins, reduced ones a grouped
aggregate or an ordered fold; what remains is left to Catalyst.

* ``=`` keeps the last iteration: reduced variables are fixed at their last value in the inputs,
  before any join.
* ``+=`` and ``-=`` on a fresh output sum from 0, ``*=`` multiplies from 1, ``/=`` divides 0.
* A statement that reads the cell it writes is a loop over the reduced variables in order of first
  appearance, each step seeing the last one's result; long loops are composed from parts where their
  steps allow (:mod:`tessellum.operators.folds`).
* Under ``+=`` a product is contracted pair by pair, smallest result first, and a mask
  ``T[i] == l`` over an index that nothing else binds becomes a group key.
* A sum over two tensors that has much to do is worked out on tiles (:mod:`tessellum.operators.tiles`).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.scalars import BINARY, UNARY, divide
from tessellum.lang.syntax import Call, Index, Infix, Negative, Node, Number, Read, Statement, walk
from tessellum.operators import folds, pairs, ranges, skew, sparse, sums, tiles
from tessellum.operators import shares as shifted
from tessellum.sources.tables import shared_root
from tessellum.tensor import Tensor, coordinates, dense, promote

#: Tensors of at most this many cells are broadcast in joins; sizes are known from metadata.
BROADCAST_CELLS = 200_000


@dataclass
class Table:
    """Rows of some index variables and value columns."""

    frame: DataFrame
    letters: tuple[str, ...]
    cells: int
    #: Whether rows are those of stored cells, which may gather at some values of an index.
    sparse: bool = False
    #: Rows of the same columns whose values are added up to those of ``frame``, where such are given.
    given: DataFrame | None = None


def bind_sizes(statement: Statement, tensors: dict[str, Tensor], hint: tuple[int, ...] | None) -> dict[str, int]:
    """The size of each index variable; ValueError where tensors and subscripts disagree."""
    sizes: dict[str, int] = {}
    given = [(r, tensors[r.name].shape) for r in statement.reads if r.name in tensors]
    for r in statement.reads:
        if r.name not in tensors:
            raise ValueError(f"line {statement.line}: input {r.name} is missing")
    if hint is not None:
        given.append((statement.output, tuple(hint)))
    for r, shape in given:
        if len(r.subscripts) != len(shape):
            raise ValueError(f"line {statement.line}: {r} has {len(r.subscripts)} subscripts, the tensor has order {len(shape)}")
        for s, n in zip(r.subscripts, shape, strict=True):
            if isinstance(s, int) and s >= n:
                raise ValueError(f"line {statement.line}: subscript {s} of {r} is out of bounds for size {n}")
            if isinstance(s, str) and len(s) == 1 and sizes.setdefault(s, n) != n:
                raise ValueError(f"line {statement.line}: index {s} has sizes {sizes[s]} and {n}")
    for r, shape in given:
        for s, n in zip(r.subscripts, shape, strict=True):
            if isinstance(s, str) and len(s) > 1:
                unknown = [c for c in dict.fromkeys(s) if c not in sizes]
                if len(unknown) == 1 and len(set(s)) == len(s):
                    rest = math.prod(sizes[c] for c in s if c != unknown[0])
                    if rest and n % rest == 0:
                        sizes[unknown[0]] = n // rest
                        unknown = []
                if unknown:
                    raise ValueError(f"line {statement.line}: index {unknown[0]} has no size; give a shape for {statement.output.name}")
                need = math.prod(sizes[c] for c in s)
                if need > n or (r is statement.output and need != n):
                    raise ValueError(f"line {statement.line}: ({s}) needs {need} cells of an axis of {n}")
    for c in statement.index_variables:
        if c not in sizes:
            raise ValueError(f"line {statement.line}: index {c} has no size; give a shape for {statement.output.name}")
    return sizes


def output_shape(statement: Statement, sizes: dict[str, int], hint: tuple[int, ...] | None) -> tuple[int, ...]:
    if hint is not None:
        return tuple(hint)
    if any(isinstance(s, int) for s in statement.output.subscripts):
        raise ValueError(f"line {statement.line}: writing to a slice of {statement.output.name} needs the tensor or its shape")
    return tuple(math.prod(sizes[c] for c in s) for s in statement.output.subscripts)


def joined_position(letters: str, sizes: dict[str, int]) -> Column:
    """The row-major position of some index variables on one axis."""
    at = F.col(letters[0])
    for c in letters[1:]:
        at = at * sizes[c] + F.col(c)
    return at


def read_rows(read: Read, tensor: Tensor, sizes: dict[str, int], fixed: dict[str, int], value: str) -> Table:
    """A tensor's cells as rows of index variables; ``fixed`` ones are filtered and dropped."""
    frame, made = tensor.frame, {}
    if tensor.pick is not None:
        places = {k: s if isinstance(s, int) else fixed.get(s) for k, s in enumerate(read.subscripts)}
        frame = tensor.pick({k: at for k, at in places.items() if at is not None})
    last = read.subscripts[-1] if read.subscripts else None
    at = last if isinstance(last, int) else fixed.get(last)
    picked = tensor.arrays is not None and at is not None
    if picked:  # one element of each array instead of a row for each
        frame = tensor.arrays.select("d0", F.element_at("x", at + 1).alias("v"))
    for k, s in enumerate(read.subscripts[:-1] if picked else read.subscripts):
        axis = F.col(f"d{k}")
        if isinstance(s, int):
            frame = frame.where(axis == s)
            continue
        stride = total = math.prod(sizes[c] for c in s)
        if len(s) > 1 and total < tensor.shape[k]:
            frame = frame.where(axis < total)
        for c in s:
            stride //= sizes[c]
            own = axis if len(s) == 1 else F.pmod(F.expr(f"d{k} div {stride}"), F.lit(sizes[c]))
            if c in fixed:
                frame = frame.where(own == fixed[c])
            elif c in made:
                frame = frame.where(own == made[c])
            else:
                made[c] = own
    kept = frame.select(*(own.cast("bigint").alias(c) for c, own in made.items()), F.col("v").cast("double").alias(value))
    given = read_rows(read, replace(tensor, frame=tensor.given, given=None), sizes, fixed, value).frame if tensor.given is not None else None
    return Table(kept, tuple(made), math.prod(sizes[c] for c in made), tensor.sparse, given)


def small(table: Table) -> DataFrame:
    return F.broadcast(table.frame) if table.cells <= BROADCAST_CELLS else table.frame


def join(a: Table, b: Table, sizes: dict[str, int]) -> Table:
    """Equi-join on shared index variables; the smaller side is broadcast if its known size allows.

    Where both sides are larger and one holds stored cells only, heavy values of the index are dealt out;
    where they share no index variable, they meet in a grid of parts.
    """
    shared = [c for c in a.letters if c in b.letters]
    letters = (*a.letters, *(c for c in b.letters if c not in a.letters))
    cells = math.prod(sizes[c] for c in letters)
    if shared and (a.sparse or b.sparse) and min(a.cells, b.cells) > BROADCAST_CELLS:
        return Table(skew.join(a.frame, b.frame, shared), letters, cells, True)
    if not shared and min(a.cells, b.cells) > BROADCAST_CELLS:
        return Table(skew.grid(a.frame, b.frame, a.cells, b.cells), letters, cells, a.sparse or b.sparse)
    left, right = (a.frame, small(b)) if b.cells <= a.cells else (small(a), b.frame)
    frame = left.join(right, shared) if shared else left.crossJoin(right)
    return Table(frame, letters, cells, a.sparse or b.sparse)


def join_all(tables: list[Table], sizes: dict[str, int]) -> Table:
    """All tables, those that share variables and make the smallest result first."""
    rest = sorted(tables, key=lambda t: -t.cells)
    out = rest.pop(0)
    while rest:
        best = min(rest, key=lambda t: (math.prod(sizes[c] for c in {*out.letters, *t.letters}), not set(out.letters) & set(t.letters)))
        rest.remove(best)
        out = join(out, best, sizes)
    return out


def domain(table: Table | None, letters: list[str], sizes: dict[str, int], spark) -> Table:
    """Extend rows by all values of index variables that no tensor binds."""
    missing = [c for c in letters if table is None or c not in table.letters]
    if not missing:
        return table
    grid = coordinates(spark, [sizes[c] for c in missing])
    named = Table(grid.select(*(F.col(f"d{k}").alias(c) for k, c in enumerate(missing))), tuple(missing), math.prod(sizes[c] for c in missing))
    return named if table is None else join(table, named, sizes)


def to_column(node: Node, value: Callable[[Read], Column], index: Callable[[str], Column], loose: bool) -> Column:
    """An expression as a column; ``loose``: equality within 1e-14, as 32-bit operands have it."""
    match node:
        case Number():
            return F.lit(node.value)
        case Index():
            return index(node.name).cast("double")
        case Read():
            return value(node)
        case Negative():
            return -to_column(node.inner, value, index, loose)
        case Call():
            return UNARY[node.function](to_column(node.inner, value, index, loose))
        case Infix():
            return BINARY[node.operator](to_column(node.left, value, index, loose), to_column(node.right, value, index, loose), loose)


def store(column: Column, dtype: str) -> Column:
    """A double as a cell of a type; whole-number types truncate."""
    if dtype in ("double", "float"):
        return column.cast(dtype)
    if dtype == "boolean":
        return column != 0
    return F.when(~F.isnan(column), column.cast(dtype)).otherwise(F.lit(0).cast(dtype))


def output_dtype(statement: Statement, tensors: dict[str, Tensor], old: Tensor | None) -> str:
    """The type of a new output: that of one input, the wider of two, else double."""
    if old is not None:
        return old.dtype
    names = list(dict.fromkeys(r.name for r in statement.reads))
    if not statement.index_variables:
        return "double"
    if len(names) == 1:
        return tensors[names[0]].dtype
    if len(names) == 2:
        a, b = (tensors[n] for n in names)
        if (a.order == 0) != (b.order == 0):  # a scalar does not widen a tensor of its kind
            return (b if a.order == 0 else a).dtype if _kind(a.dtype) == _kind(b.dtype) else promote(a.dtype, b.dtype)
        return promote(a.dtype, b.dtype)
    return "double"


def _kind(dtype: str) -> str:
    return "real" if dtype in ("float", "double") else dtype if dtype == "boolean" else "whole"


def factors(node: Node) -> list[Node] | None:
    """The factors of a product of tensors, numbers and masks; None for anything else."""
    if isinstance(node, Infix) and node.operator == "*":
        left, right = factors(node.left), factors(node.right)
        return None if left is None or right is None else left + right
    if isinstance(node, Read | Number) or _mask(node):
        return [node]
    return None


def _mask(node: Node) -> tuple[Read, str] | None:
    """(T, l) for ``T == l`` or ``l == T``."""
    if isinstance(node, Infix) and node.operator == "==":
        for a, b in ((node.left, node.right), (node.right, node.left)):
            if isinstance(a, Read) and isinstance(b, Index):
                return a, b.name
    return None


def lower(statement: Statement, tensors: dict[str, Tensor], spark, hint: tuple[int, ...] | None = None, old: Tensor | None = None, accumulate: bool = False, tiled: bool | None = None, exact: bool = False) -> Tensor:
    """The tensor a statement makes from ``tensors``.

    ``old`` is the output's earlier value where it is read, or written in part; ``accumulate`` adds a
    compound assignment onto it even if the expression does not read it.  ``tiled`` says whether
    contractions of two tensors are worked out on tiles; None: where they have much to do.  ``exact``
    sums do not depend on the order (:mod:`tessellum.operators.sums`); they are made of all terms, one by one.
    """
    out = statement.output
    if old is not None:
        old = dense(old)
        hint = old.shape
    sizes = bind_sizes(statement, tensors, hint)
    shape = output_shape(statement, sizes, hint)
    statement, tensors = opened(statement, tensors)
    own = [r for r in statement.reads if r.name == out.name]
    if any(r.subscripts != out.subscripts for r in own):
        raise ValueError(f"line {statement.line}: {out.name} is read under other subscripts than it is written; the result would depend on the order of the loop")
    dtype = output_dtype(statement, tensors, old)
    loose = any(tensors[r.name].dtype == "float" for r in statement.reads)
    reduced = [c for c in statement.index_variables if c not in out.letters]
    if any(tensors[r.name].sparse for r in statement.reads):
        made = None if own or accumulate or old is not None else _stored(statement, tensors, sizes, reduced, loose, spark, exact)
        if made is not None:
            return _write_stored(made, statement, sizes, shape, dtype)
        made = None if own or accumulate or old is not None or exact else _filled(statement, tensors, sizes, reduced, loose, spark)
        if made is not None:
            return _write(made, statement, sizes, shape, dtype, None, spark)
        tensors = {n: dense(t) for n, t in tensors.items()}
    if own:
        cells = _loop(statement, tensors, sizes, reduced, old, loose, spark)
    elif accumulate:
        cells = _onto(statement, tensors, sizes, reduced, old, loose, spark, exact)
    elif statement.kind == "=":
        cells = _last(statement, tensors, sizes, reduced, loose, spark)
    else:
        cells = _reduce(statement, tensors, sizes, reduced, loose, spark, tiled, exact)
    made = _write(cells, statement, sizes, shape, dtype, old, spark)
    return replace(made, product=_product(statement, tensors, dtype)) if old is None and not own and not reduced else made


def _product(statement: Statement, tensors: dict[str, Tensor], dtype: str):
    """The factors of an output that is a product of tensors, each with the output's axes that it lies along."""
    parts, out = factors(statement.expression), statement.output.subscripts
    if statement.kind != "=" or dtype != "double" or parts is None or any(not isinstance(p, Read | Number) for p in parts):
        return None
    reads = [p for p in parts if isinstance(p, Read)]
    plain = all(isinstance(s, str) and len(s) == 1 for r in (statement.output, *reads) for s in r.subscripts) and len(set(out)) == len(out)
    if len(reads) < 2 or not plain or {c for r in reads for c in r.letters} != set(out):
        return None
    return math.prod(p.value for p in parts if isinstance(p, Number)), tuple((tuple(out.index(c) for c in r.subscripts), tensors[r.name]) for r in reads)


def opened(statement: Statement, tensors: dict[str, Tensor]) -> tuple[Statement, dict[str, Tensor]]:
    """A sum of products with products among its tensors replaced by their factors, so that they are never expanded."""
    parts = factors(statement.expression)
    if statement.kind not in ("+=", "-=") or parts is None or any(not isinstance(p, Read | Number) for p in parts):
        return statement, tensors
    made, known, changed = [], dict(tensors), False
    for p in parts:
        found = tensors[p.name].product if isinstance(p, Read) and p.name != statement.output.name else None
        if found is None:
            made.append(p)
            continue
        scale, factored = found
        changed = True
        if scale != 1.0:
            made.append(Number(scale, repr(scale)))
        for k, (axes, tensor) in enumerate(factored):
            name = f"{p.name}.{k}"
            known[name] = tensor
            made.append(Read(name, tuple(p.subscripts[a] for a in axes)))
    if not changed:
        return statement, tensors
    expression = made[0]
    for p in made[1:]:
        expression = Infix("*", expression, p)
    return opened(replace(statement, expression=expression), known)


def shares(statement: Statement, totals: dict[str, tuple[Statement, dict[str, Tensor]]], now: dict[str, Tensor]) -> Node | None:
    """E of ``R = exp(E) / D`` where D still is the sum of ``exp(E)`` that ``totals`` says it is; else None."""
    match statement:
        case Statement(kind="=", expression=Infix(operator="/", left=Call(function="exp", inner=inner), right=Read() as total)) if total.name in totals:
            made, read = totals[total.name]
            same = made.expression == statement.expression.left and made.output == total and all(now.get(n) is t for n, t in read.items())
            letters = {c for n in walk(inner) for c in (n.letters if isinstance(n, Read) else (n.name,) if isinstance(n, Index) else ())}
            return inner if same and set(statement.output.letters) == letters else None
    return None


def lower_shares(statement: Statement, inner: Node, tensors: dict[str, Tensor], spark, hint: tuple[int, ...] | None = None) -> Tensor:
    """``R = exp(E) / D`` with both shifted alike, so that no exponent overflows (:mod:`tessellum.operators.shares`)."""
    tensors = {n: dense(t) for n, t in tensors.items()}
    sizes = bind_sizes(statement, tensors, hint)
    letters, keys = list(statement.output.letters), list(statement.expression.right.letters)
    loose = any(tensors[r.name].dtype == "float" for r in statement.reads)
    rows = _rows(replace(statement, expression=inner), tensors, sizes, letters, {}, spark)
    named = _names(replace(statement, expression=inner))
    value = to_column(inner, lambda r: F.col(named[r]), F.col, loose)
    cells = Table(rows.frame.select(*letters, value.alias("x")), tuple(letters), rows.cells)
    totals = Table(shifted.totals(cells.frame, keys, F.col("x")), tuple(keys), math.prod(sizes[c] for c in keys))
    both = join(cells, totals, sizes)
    made = Table(both.frame.select(*letters, shifted.share(F.col("x")).alias("x")), tuple(letters), both.cells)
    return _write(made, statement, sizes, output_shape(statement, sizes, hint), output_dtype(statement, tensors, None), None, spark)


def _names(statement: Statement) -> dict[Read, str]:
    return {r: f"t{k}" for k, r in enumerate(statement.reads)}


def _rows(statement: Statement, tensors: dict[str, Tensor], sizes: dict[str, int], letters: list[str], fixed: dict[str, int], spark) -> Table:
    names = _names(statement)
    tables = [read_rows(r, tensors[r.name], sizes, fixed, names[r]) for r in statement.reads]
    joined = join_all(tables, sizes) if tables else None
    if joined is None and not letters:
        return Table(spark.range(1).select(), (), 1)
    return domain(joined, letters, sizes, spark)


def _last(statement: Statement, tensors, sizes, reduced, loose, spark) -> Table:
    fixed = {c: sizes[c] - 1 for c in reduced}
    letters = list(statement.output.letters)
    rows, names = _rows(statement, tensors, sizes, letters, fixed, spark), _names(statement)
    value = to_column(statement.expression, lambda r: F.col(names[r]), lambda c: F.lit(fixed[c]) if c in fixed else F.col(c), loose)
    return Table(rows.frame.select(*letters, value.alias("x")), tuple(letters), rows.cells)


def _finish(kind: str, total: Column) -> Column:
    return {"+=": total, "-=": -total, "*=": total, "/=": divide(F.lit(0.0), total)}[kind]


def _reduce(statement: Statement, tensors, sizes, reduced, loose, spark, tiled: bool | None = None, exact: bool = False) -> Table:
    letters, names = list(statement.output.letters), _names(statement)
    if exact and reduced and statement.kind in ("+=", "-="):
        rows = _rows(statement, tensors, sizes, [*letters, *reduced], {}, spark)
        value = to_column(statement.expression, lambda r: F.col(names[r]), F.col, loose)
        total = sums.exact_sum(rows.frame, letters, value)
        return Table(total.select(*letters, _finish(statement.kind, F.col("x")).alias("x")), tuple(letters), math.prod(sizes[c] for c in letters))
    plan = tiles.recognise(statement, loose) if tiled is not False else None
    if plan is not None and (tiled or math.prod(sizes[c] for c in statement.index_variables) >= tiles.LEAST_WORK):
        sides = [read_rows(r, tensors[r.name], sizes, {}, names[r]) for r in (plan.left, plan.right)]
        made = tiles.contract(plan, sides[0].frame, sides[1].frame, sizes, (names[plan.left], names[plan.right]))
        return Table(made.select(*letters, _finish(statement.kind, F.col("x")).alias("x")), tuple(letters), math.prod(sizes[c] for c in letters))
    mask = ranges.recognise(statement)
    if mask is not None:
        return _ordered(statement, mask, tensors, sizes, spark)
    if statement.kind in ("+=", "-="):
        parts = factors(statement.expression)
        if parts is not None and sum(not isinstance(p, Number) for p in parts) > 0:
            table = _contract(statement, parts, tensors, sizes, letters, loose, spark)
            return Table(table.frame.select(*letters, _finish(statement.kind, F.col("x")).alias("x")), tuple(letters), table.cells)
    rows = _rows(statement, tensors, sizes, [*letters, *reduced], {}, spark)
    value = to_column(statement.expression, lambda r: F.col(names[r]), F.col, loose)
    return _aggregate(statement.kind, rows.frame.select(*letters, value.alias("x")), letters, reduced, rows.cells)


def _stored(statement: Statement, tensors, sizes, reduced, loose, spark, exact: bool = False) -> Table | None:
    """A statement over stored cells; None if it does not vanish where nothing is stored."""
    letters, names = list(statement.output.letters), _names(statement)
    if statement.kind not in ("=", "+=", "-="):
        return None

    def stored(r: Read) -> bool:
        return tensors[r.name].sparse

    clauses = sparse.support(statement.expression, stored)
    if frozenset() in clauses or not clauses:
        return None
    parts = factors(statement.expression)
    if statement.kind != "=" and parts is not None and not exact and not any(_mask(p) for p in parts):
        table = _contract(statement, parts, tensors, sizes, letters, loose, spark)
        x = F.col("x") if letters else F.coalesce("x", F.lit(0.0))
        return Table(table.frame.select(*letters, _finish(statement.kind, x).alias("x")), tuple(letters), table.cells)
    fixed = {c: sizes[c] - 1 for c in reduced} if statement.kind == "=" else {}
    kept = [c for c in statement.index_variables if c not in fixed]
    reads = {r: (t.frame, t.letters, names[r]) for r in statement.reads for t in [read_rows(r, tensors[r.name], sizes, fixed, names[r])]}

    def extended(frame: DataFrame, own: tuple[str, ...], wanted: list[str]) -> DataFrame:
        return domain(Table(frame, own, math.prod(sizes[c] for c in own)), wanted, sizes, spark).frame

    rows = sparse.rows(clauses, reads, stored, kept, extended)
    value = to_column(statement.expression, lambda r: F.col(names[r]), lambda c: F.lit(fixed[c]) if c in fixed else F.col(c), loose)
    cells = math.prod(sizes[c] for c in letters)
    if statement.kind == "=":
        return Table(rows.select(*letters, value.alias("x")), tuple(letters), cells)
    total = sums.exact_sum(rows, letters, value) if exact else sparse.summed(rows, letters, value)
    return Table(total.select(*letters, _finish(statement.kind, F.col("x")).alias("x")), tuple(letters), cells)


def _filled(statement: Statement, tensors, sizes, reduced, loose, spark) -> Table | None:
    """A sum that does not vanish where nothing is stored: the stored places, and for all others at once what it is there.

    None if that is not the same for all places of an output cell, or a sparse tensor lacks an index variable.
    """
    letters, every = list(statement.output.letters), list(statement.index_variables)
    stored = [r for r in statement.reads if tensors[r.name].sparse]
    absent = replace(statement, expression=sparse.absent(statement.expression, set(stored)))
    if statement.kind not in ("+=", "-=") or not reduced or set(absent.index_variables) - set(letters) or any(set(r.letters) != set(every) for r in stored):
        return None
    names = _names(statement)
    reads = {r: (t.frame, t.letters, names[r]) for r in statement.reads for t in [read_rows(r, tensors[r.name], sizes, {}, names[r])]}

    def extended(frame: DataFrame, own: tuple[str, ...], wanted: list[str]) -> DataFrame:
        return domain(Table(frame, own, math.prod(sizes[c] for c in own)), wanted, sizes, spark).frame

    places = sparse.rows(frozenset(frozenset([r]) for r in stored), reads, stored.__contains__, every, extended)
    value = to_column(statement.expression, lambda r: F.col(names[r]), F.col, loose)
    found = places.select(*letters, value.alias("x")).groupBy(*letters).agg(F.sum("x").alias("x"), F.count("*").alias("places"))
    rest = _rows(absent, tensors, sizes, letters, {}, spark)
    named = _names(absent)
    nothing = to_column(absent.expression, lambda r: F.col(named[r]), F.col, loose)
    both = rest.frame.join(found, letters, "left") if letters else rest.frame.crossJoin(found)
    left = math.prod(sizes[c] for c in reduced) - F.coalesce("places", F.lit(0))
    total = F.coalesce("x", F.lit(0.0)) + F.when(left > 0, left * nothing).otherwise(F.lit(0.0))
    return Table(both.select(*letters, _finish(statement.kind, total).alias("x")), tuple(letters), rest.cells)


def _write_stored(cells: Table, statement: Statement, sizes, shape, dtype: str) -> Tensor:
    """Rows of index variables as the stored cells of the output."""
    place = [F.lit(s).cast("bigint") if isinstance(s, int) else joined_position(s, sizes) for s in statement.output.subscripts]
    made = cells.frame.select(*(p.alias(f"d{k}") for k, p in enumerate(place)), store(F.col("x"), dtype).alias("v"))
    return Tensor(made, tuple(shape), dtype, sparse=bool(place))


def _ordered(statement: Statement, mask: ranges.Ordering, tensors, sizes, spark) -> Table:
    """A sum of weights over an ordering mask: looked up in sorted runs."""
    letters, keys = list(statement.output.letters), list(mask.keys)
    x = read_rows(mask.x, tensors[mask.x.name], sizes, {}, "v")
    weight, points = F.lit(1.0), x
    for k, r in enumerate(mask.weights):
        points = join(points, read_rows(r, tensors[r.name], sizes, {}, f"w{k}"), sizes)
        weight = weight * F.col(f"w{k}")
    y = read_rows(mask.y, tensors[mask.y.name], sizes, {}, "v")
    totals = ranges.sums(points.frame.select(*keys, "v", weight.alias("w")), y.frame.select(*keys, "v"), keys, mask.operator, x.cells + y.cells)
    both = Table(y.frame.join(totals, [*keys, "v"], "left").select(*letters, (F.coalesce("total", F.lit(0.0)) * mask.scale).alias("x")), tuple(letters), y.cells)
    for k, r in enumerate(mask.factors):
        both = join(both, read_rows(r, tensors[r.name], sizes, {}, f"u{k}"), sizes)
        both = Table(both.frame.select(*letters, (F.col("x") * F.col(f"u{k}")).alias("x")), both.letters, both.cells)
    return Table(both.frame.select(*letters, _finish(statement.kind, F.col("x")).alias("x")), tuple(letters), both.cells)


def _onto(statement: Statement, tensors, sizes, reduced, old: Tensor, loose, spark, exact: bool = False) -> Table:
    """A compound assignment onto earlier values that its expression does not read: one aggregate, then one join."""
    total = "+=" if statement.kind in ("+=", "-=") else "*="
    made = _reduce(replace(statement, kind=total), tensors, sizes, reduced, loose, spark, exact=exact)
    both = join(read_rows(statement.output, old, sizes, {}, "state"), made, sizes)
    state, x = F.col("state"), F.col("x")
    value = {"+=": state + x, "-=": state - x, "*=": state * x, "/=": divide(state, x)}[statement.kind]
    return Table(both.frame.select(*statement.output.letters, value.alias("x")), tuple(statement.output.letters), both.cells)


def _aggregate(kind: str, frame: DataFrame, letters: list[str], reduced: list[str], cells: int) -> Table:
    if not reduced:
        return Table(frame.select(*letters, _finish(kind, F.col("x")).alias("x")), tuple(letters), cells)
    total = F.sum("x") if kind in ("+=", "-=") else F.product("x")
    made = frame.groupBy(*letters).agg(total.alias("x")) if letters else frame.agg(total.alias("x"))
    return Table(made.select(*letters, _finish(kind, F.col("x")).alias("x")), tuple(letters), cells)


def _contract(statement: Statement, parts: list[Node], tensors, sizes, letters: list[str], loose: bool, spark) -> Table:
    """A sum of products: join two factors at a time and sum what no other factor needs."""
    scale, tables, keyed = 1.0, [], {}
    bound = {c for p in parts if isinstance(p, Read) for c in p.letters}
    for k, p in enumerate(parts):
        mask = _mask(p)
        if isinstance(p, Number):
            scale *= p.value
        elif isinstance(p, Read):
            tables.append(read_rows(p, tensors[p.name], sizes, {}, f"x{k}"))
        elif mask[1] in letters and mask[1] not in bound | set(mask[0].letters) | set(keyed):
            # The mask binds its index: label values become keys, cells without a label are filled later.
            keyed[mask[1]] = p
            table = read_rows(mask[0], tensors[mask[0].name], sizes, {}, "label")
            label = F.col("label")
            exact = F.abs(label - F.round(label)) < 1e-14 if loose else label == F.floor(label)
            hit = table.frame.where(~F.isnan(label) & (label > -0.5) & (label < sizes[mask[1]] - 0.5)).where(exact)
            hit = hit.select(*table.letters, F.round(label).cast("bigint").alias(mask[1]), F.lit(1.0).alias(f"x{k}"))
            tables.append(Table(hit, (*table.letters, mask[1]), table.cells))
        else:
            table = read_rows(mask[0], tensors[mask[0].name], sizes, {}, "label")
            table = domain(table, [*table.letters, mask[1]], sizes, spark)
            value = BINARY["=="](F.col("label"), F.col(mask[1]).cast("double"), loose)
            tables.append(Table(table.frame.select(*table.letters, value.alias(f"x{k}")), table.letters, table.cells))

    def named(frame: DataFrame | None, own: tuple[str, ...], k: int) -> DataFrame | None:
        return None if frame is None else frame.select(*own, F.col(next(c for c in frame.columns if c.startswith("x"))).alias(f"f{k}"))

    tables = [Table(named(t.frame, t.letters, k), t.letters, t.cells, t.sparse, named(t.given, t.letters, k)) for k, t in enumerate(tables)]
    uncovered = [c for c in statement.index_variables if c not in {x for t in tables for x in t.letters}]
    tables = [_presum(t, letters, [o for o in tables if o is not t], sizes) for t in tables] if not keyed else tables
    made = len(tables)
    while len(tables) > 1:
        couples = [(a, b) for i, a in enumerate(tables) for b in tables[i + 1 :]]
        a, b = min(couples, key=lambda p: (not set(p[0].letters) & set(p[1].letters), math.prod(sizes[c] for c in {*p[0].letters, *p[1].letters}), p[0].cells + p[1].cells))
        rest = [t for t in tables if t is not a and t is not b]
        if not rest and _paired(a, b, letters):
            tables = [_multiplied(a, b, sizes, made)]
            break
        both = join(a, b, sizes)
        (x,), (y,) = ([c for c in t.frame.columns if c.startswith("f")] for t in (a, b))
        product = Table(both.frame.select(*both.letters, (F.col(x) * F.col(y)).alias(f"f{made}")), both.letters, both.cells, both.sparse)
        made += 1
        tables = [*rest, _presum(product, letters, rest, sizes)]
    table = tables[0]
    (x,) = (c for c in table.frame.columns if c.startswith("f"))
    for c in uncovered:
        if c not in letters:
            scale *= sizes[c]
    table = Table(table.frame.select(*table.letters, (F.col(x) * scale if scale != 1.0 else F.col(x)).alias("x")), table.letters, table.cells)
    extra = [c for c in table.letters if c not in letters]
    if extra:
        keys = [c for c in letters if c in table.letters]
        summed = table.frame.groupBy(*keys).agg(F.sum("x").alias("x")) if keys else table.frame.agg(F.sum("x").alias("x"))
        table = Table(summed, tuple(keys), math.prod(sizes[c] for c in keys))
    if keyed:
        grid = domain(None, list(table.letters), sizes, spark)
        filled = grid.frame.join(table.frame, list(table.letters), "left").select(*table.letters, F.coalesce("x", F.lit(0.0)).alias("x"))
        table = Table(filled, table.letters, table.cells)
    return domain(table, letters, sizes, spark) if letters else table


def _paired(a: Table, b: Table, letters: list[str]) -> bool:
    """Whether the last two factors hold stored cells, share only what is summed, and are too many to broadcast."""
    shared = set(a.letters) & set(b.letters)
    own = [set(t.letters) - shared for t in (a, b)]
    return a.sparse and b.sparse and min(a.cells, b.cells) > BROADCAST_CELLS and bool(shared) and not shared & set(letters) and all(o and o <= set(letters) for o in own)


def _multiplied(a: Table, b: Table, sizes: dict[str, int], number: int) -> Table:
    """Their product, summed over what they share (:mod:`tessellum.operators.pairs`)."""
    keys = [c for c in a.letters if c in b.letters]
    own = [tuple(c for c in t.letters if c not in keys) for t in (a, b)]
    values = [next(c for c in t.frame.columns if c.startswith("f")) for t in (a, b)]
    spark = a.frame.sparkSession
    counts = [pairs.parts(t.given.count(), spark.sparkContext.defaultParallelism) if t.given is not None else math.inf for t in (a, b)]
    crossed = max(counts) <= pairs.GRID
    inner = [tiles.position(tuple(keys), sizes).alias("k")] if crossed else keys
    sides = [(t.given if crossed else t.frame).select(*inner, tiles.position(o, sizes).alias(n), v) for t, o, n, v in zip((a, b), own, ("i", "j"), values, strict=True)]
    summed = pairs.crossed(*sides, tuple(values), tuple(counts)) if crossed else pairs.multiply(*sides, keys, tuple(values))
    both = (*own[0], *own[1])
    named = summed.select(*tiles.letters_of("i", own[0], sizes), *tiles.letters_of("j", own[1], sizes), F.col("x").alias(f"f{number}"))
    return Table(named, both, math.prod(sizes[c] for c in both), True)


def _presum(table: Table, letters: list[str], others: list[Table], sizes: dict[str, int]) -> Table:
    """Sum over index variables that neither the output nor another factor needs."""
    needed = set(letters).union(*(o.letters for o in others)) if others else set(letters)
    keep = [c for c in table.letters if c in needed]
    if len(keep) == len(table.letters):
        return table
    (x,) = (c for c in table.frame.columns if c.startswith("f"))
    frame = table.frame.groupBy(*keep).agg(F.sum(x).alias(x)) if keep else table.frame.agg(F.sum(x).alias(x))
    return Table(frame, tuple(keep), math.prod(sizes[c] for c in keep), table.sparse, table.given.select(*keep, x) if table.given is not None else None)


def _loop(statement: Statement, tensors, sizes, reduced, old: Tensor | None, loose, spark) -> Table:
    """A statement that reads the cell it writes: steps in the order of the reduced variables.

    Short ranges are folded in one array for each output cell, long ones composed from parts or
    streamed (:mod:`tessellum.operators.folds`).
    """
    letters, names, out = list(statement.output.letters), _names(statement), statement.output
    start = old if old is not None else tensors[out.name]
    others = [r for r in statement.reads if r.name != out.name]
    state = read_rows(out, start, sizes, {}, "state")
    tables = [read_rows(r, tensors[r.name], sizes, {}, names[r]) for r in others]
    joined = join_all(tables, sizes) if tables else None
    rows = domain(joined, [*reduced], sizes, spark) if reduced or joined else None

    def step(acc: Column, value: Callable[[Read], Column], index: Callable[[str], Column]) -> Column:
        return to_column(folds.step_of(statement), lambda r: acc if r.name == out.name else value(r), index, loose)

    if not reduced:
        both = join(state, rows, sizes) if rows is not None else state
        both = domain(both, letters, sizes, spark)
        return Table(both.frame.select(*letters, step(F.col("state"), lambda r: F.col(names[r]), F.col).alias("x")), tuple(letters), both.cells)
    steps = math.prod(sizes[c] for c in reduced)
    if steps > folds.CHUNK:
        return _long_loop(statement, rows, state, sizes, reduced, steps, names, loose, spark)
    keys = [c for c in letters if c in rows.letters]
    each = F.struct(*(F.col(c) for c in reduced), *(F.col(names[r]) for r in others))
    listed = F.array_sort(F.collect_list(each)).alias("steps")
    gathered = rows.frame.groupBy(*keys).agg(listed) if keys else rows.frame.agg(listed)
    both = join(state, Table(gathered, tuple(keys), math.prod(sizes[c] for c in keys)), sizes)
    both = domain(both, letters, sizes, spark)
    folded = F.aggregate("steps", F.col("state"), lambda acc, s: step(acc, lambda r: s[names[r]], lambda c: s[c] if c in reduced else F.col(c)))
    return Table(both.frame.select(*letters, folded.alias("x")), tuple(letters), both.cells)


def _long_loop(statement: Statement, rows: Table, state: Table, sizes, reduced, steps: int, names, loose, spark) -> Table:
    """The same where one cell's steps are too many for an array."""
    letters, out = list(statement.output.letters), statement.output
    at = joined_position("".join(reduced), sizes)
    if folds.form(statement) == "loop":
        made = _guarded_loop(statement, rows, state, at, names, loose, spark) if not letters else None
        if made is not None:
            return made
        both = domain(join(state, rows, sizes), letters, sizes, spark)
        return Table(folds.streamed(statement, both.frame, letters, at, names, loose), tuple(letters), state.cells)
    # Index variables of the output that a step computes with belong to its key.
    used = [n.name for n in walk(statement.expression) if isinstance(n, Index)]
    rows = domain(rows, [c for c in dict.fromkeys(used) if c in letters], sizes, spark)
    keys = [c for c in letters if c in rows.letters]
    made, result = folds.composed(statement, rows.frame, keys, at, steps, lambda node: to_column(node, lambda r: F.col(names[r]), F.col, loose))
    both = domain(join(state, Table(made, tuple(keys), math.prod(sizes[c] for c in keys)), sizes), letters, sizes, spark)
    return Table(both.frame.select(*letters, result(F.col("state")).alias("x")), tuple(letters), both.cells)


def _guarded_loop(statement: Statement, rows: Table, state: Table, at: Column, names, loose, spark) -> Table | None:
    """A scalar loop of steps that subtract what the state exceeds, from totals of its runs; None for other steps."""
    found = folds.guarded(folds.step_of(statement), statement.output)
    if found is None:
        return None
    x = to_column(found[0], lambda r: F.col(names[r]), F.col, loose)
    shared_root(spark)
    totals = folds.guarded_totals(rows.frame, at, x).checkpoint(eager=True)
    value = folds.guarded_fold(statement, totals, rows.frame, state.frame.first()["state"], at, x)
    return None if value is None else Table(spark.range(1).select(F.lit(value).alias("x")), (), 1)


def _write(cells: Table, statement: Statement, sizes, shape, dtype: str, old: Tensor | None, spark) -> Tensor:
    """Rows of index variables as cells of the output; cells that are not written keep their value, or are 0."""
    out = statement.output
    place = [F.lit(s).cast("bigint") if isinstance(s, int) else joined_position(s, sizes) for s in out.subscripts]
    keys = [f"d{k}" for k in range(len(place))]
    made = cells.frame.select(*(p.alias(k) for p, k in zip(place, keys, strict=True)), store(F.col("x"), dtype).alias("v"))
    axes = [1 if isinstance(s, int) else math.prod(sizes[c] for c in s) for s in out.subscripts]
    plain = len(set("".join(s for s in out.subscripts if isinstance(s, str)))) == sum(len(s) for s in out.subscripts if isinstance(s, str))
    if tuple(axes) == tuple(shape) and plain:
        return Tensor(made, tuple(shape), dtype)
    before = old.frame if old is not None else coordinates(spark, shape).select(*keys, store(F.lit(0.0), dtype).alias("v"))
    return Tensor(made.unionByName(before.join(made.select(*keys), keys, "left_anti").select(*keys, "v")), tuple(shape), dtype)


def reads_itself(statement: Statement) -> bool:
    return any(isinstance(n, Read) and n.name == statement.output.name for n in walk(statement.expression))
