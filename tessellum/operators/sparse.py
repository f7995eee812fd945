"""Tensors of which only some cells are stored, all others being 0.

Which stored cells can make an expression differ from 0 is read off the expression: its *support* is a set
of clauses, each a set of sparse reads that all have to be stored.  A product needs both sides, a sum
either, ``exp`` of anything is never 0 by absence.  Joins follow the clauses:

* one clause: an inner join of its reads on shared index variables, other sparse reads joined from the
  left with 0 where they are absent;
* several clauses of one read each, all over the same index variables: their cells one under another and
  one aggregate, with a single exchange;
* several clauses otherwise: the union of the places that each clause allows, then as for one clause;
* a clause without reads: the expression does not vanish where nothing is stored.  A sum over tensors that
  have all index variables takes its stored places one by one and all others at once, by their number, if the
  expression is the same at all of one output cell; otherwise the tensors are filled up first.

Absent cells count as 0 and numbers as finite: that 0 times an infinite number is no number is not seen for
cells that are not stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.lang.syntax import Call, Index, Infix, Negative, Node, Number, Read

Clauses = frozenset[frozenset[Read]]
ANYWHERE: Clauses = frozenset([frozenset()])
NOWHERE: Clauses = frozenset()
#: Functions that keep 0.
_KEEP_ZERO = {"abs", "sqrt", "sin", "tan", "asin", "atan", "sinh", "tanh", "asinh", "atanh", "ceil", "floor"}


def _least(clauses) -> Clauses:
    """Without clauses that ask for more than another."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def support(node: Node, sparse: Callable[[Read], bool]) -> Clauses:
    """Where an expression can differ from 0."""

    def of(n: Node) -> Clauses:
        return support(n, sparse)

    match node:
        case Number():
            return ANYWHERE if node.value != 0 else NOWHERE
        case Index():
            return ANYWHERE
        case Read():
            return frozenset([frozenset([node])]) if sparse(node) else ANYWHERE
        case Negative():
            return of(node.inner)
        case Call():
            return of(node.inner) if node.function in _KEEP_ZERO else ANYWHERE
        case Infix(operator="*" | "&&"):
            return _least({a | b for a in of(node.left) for b in of(node.right)})
        case Infix(operator="+" | "-" | "||" | "!=" | "<" | ">"):
            return _least(of(node.left) | of(node.right))
        case Infix(operator="/" | "^", right=Number(value=v)) if v > 0:
            return of(node.left)
        case Infix(operator="/", right=Number(value=v)) if v < 0:
            return of(node.left)
    return ANYWHERE


def absent(node: Node, reads: set[Read]) -> Node:
    """An expression with 0 for some reads."""
    match node:
        case Read() if node in reads:
            return Number(0.0, "0")
        case Negative():
            return Negative(absent(node.inner, reads))
        case Call():
            return Call(node.function, absent(node.inner, reads))
        case Infix():
            return Infix(node.operator, absent(node.left, reads), absent(node.right, reads))
    return node


def rows(clauses: Clauses, reads: dict[Read, tuple[DataFrame, tuple[str, ...], str]], sparse: Callable[[Read], bool], letters: list[str], domain: Callable[[DataFrame | None, tuple[str, ...], list[str]], DataFrame]) -> DataFrame:
    """Rows of all ``letters`` with the value of every read, for all places that the clauses allow.

    ``reads`` holds (frame, letters, value column) of each; ``domain`` extends rows by all values of missing letters.
    """
    dense = [r for r in reads if not sparse(r)]
    alone = [next(iter(c)) for c in clauses if len(c) == 1]
    if len(clauses) > 1 and len(alone) == len(clauses) and all(set(reads[r][1]) == set(letters) for r in alone):
        # Each cell carries one value; the aggregate brings those of one place together.
        parts = []
        for r in alone:
            frame, _, value = reads[r]
            parts.append(frame.select(*letters, *((F.col(value) if q is r else F.lit(0.0)).alias(reads[q][2]) for q in alone)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        sums = [F.sum(reads[r][2]).alias(reads[r][2]) for r in alone]
        out = out.groupBy(*letters).agg(*sums) if letters else out.agg(*(F.coalesce(F.sum(reads[r][2]), F.lit(0.0)).alias(reads[r][2]) for r in alone))
        return _joined(out, tuple(letters), [r for r in reads if sparse(r) and r not in alone], dense, reads)
    if len(clauses) == 1:
        (clause,) = clauses
        needed = sorted(clause, key=str)
        out, own = reads[needed[0]][0], reads[needed[0]][1]
        for r in needed[1:]:
            out, own = _both(out, own, reads[r])
        for r in dense:
            out, own = _both(out, own, reads[r])
        out = domain(out, own, letters)
        return _joined(out, tuple(letters), [r for r in reads if sparse(r) and r not in clause], [], reads)
    places = None
    for clause in sorted(clauses, key=lambda c: sorted(map(str, c))):
        needed = sorted(clause, key=str)
        out, own = reads[needed[0]][0].select(*reads[needed[0]][1]), reads[needed[0]][1]
        for r in needed[1:]:
            frame, named, _ = reads[r]
            out, own = _both(out, own, (frame.select(*named), named, ""))
        found = domain(out, own, letters).select(*letters)
        places = found if places is None else places.unionByName(found)
    return _joined(places.distinct(), tuple(letters), [r for r in reads if sparse(r)], dense, reads)


def _both(out: DataFrame, own: tuple[str, ...], read: tuple[DataFrame, tuple[str, ...], str]) -> tuple[DataFrame, tuple[str, ...]]:
    frame, named, _ = read
    shared = [c for c in own if c in named]
    made = out.join(frame, shared) if shared else out.crossJoin(frame)
    return made, (*own, *(c for c in named if c not in own))


def _joined(out: DataFrame, own: tuple[str, ...], absent: list[Read], dense: list[Read], reads) -> DataFrame:
    """With the values of more reads: 0 where a sparse one has none."""
    for r in absent:
        frame, named, value = reads[r]
        out = (out.join(frame, list(named), "left") if named else out.crossJoin(frame)).fillna(0.0, [value])
    for r in dense:
        out, _ = _both(out, own, reads[r])
    return out


def summed(frame: DataFrame, letters: list[str], value: Column) -> DataFrame:
    """(letters.., x): sums by output cell; a scalar is 0 where there are no rows."""
    made = frame.select(*letters, value.alias("x"))
    return made.groupBy(*letters).agg(F.sum("x").alias("x")) if letters else made.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))
