"""Compiled programs: analysis, execution, and their structure as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessellum.lang.syntax import Call, Statement, parse
from tessellum.operators.lowering import lower, lower_shares, reads_itself, shares
from tessellum.sources.tables import settled
from tessellum.tensor import Tensor


@dataclass(frozen=True)
class Variable:
    """A tensor's name, order, and the lines it is written (-1: given from outside) or read on."""

    name: str
    order: int
    lines: tuple[int, ...]


@dataclass
class Program:
    statements: list[Statement]
    variables: dict[str, Variable] = field(init=False)
    input_variables: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        written = {s.output.name for s in self.statements}
        seen: set[str] = set()
        inputs: dict[str, None] = {}
        orders: dict[str, int] = {}
        lines: dict[str, list[int]] = {}
        for s in self.statements:
            for r in s.reads:
                if r.name not in written or (r.name not in seen and r.name not in inputs):
                    inputs.setdefault(r.name)
            for r in (s.output, *s.reads):
                if orders.setdefault(r.name, len(r.subscripts)) != len(r.subscripts):
                    raise ValueError(f"Invalid program: line {s.line}: {r.name} has orders {orders[r.name]} and {len(r.subscripts)}")
                at = lines.setdefault(r.name, [])
                if s.line not in at:
                    at.append(s.line)
            seen.add(s.output.name)
        self.input_variables = tuple(inputs)
        self.variables = {n: Variable(n, k, tuple(([-1] if n in inputs else []) + sorted(lines[n]))) for n, k in orders.items()}

    @property
    def max_loop_depth(self) -> tuple[int, int]:
        """(loops, line) of the first statement with most index variables."""
        best = max(self.statements, key=lambda s: s.loop_count)
        return best.loop_count, best.line

    @property
    def max_op_count(self) -> tuple[int, int]:
        best = max(self.statements, key=lambda s: s.op_count)
        return best.op_count, best.line

    def execute(self, inputs: dict[str, Tensor], shape_hints: dict[str, tuple[int, ...]] | None = None, spark: SparkSession | None = None, tiled: bool | None = None, exact: bool = False, shared: bool = False, shifted: bool = True) -> dict[str, Tensor]:
        """All tensors by name, the inputs included.  Nothing runs until a frame is used, but for
        counts of the given cells of two large sparse tensors that are multiplied.

        Shapes are inferred; ``shape_hints`` override and are needed only for index ranges that no
        tensor fixes.  A name stands for its latest value at each statement.  ``tiled`` and ``exact``
        as in :func:`tessellum.operators.lowering.lower`.  Statements that say the same of the same tensors
        are one.  With ``shared``, what sums or joins and is read by several statements is computed once, when
        the program is executed, and checkpointed; what has one reader stays part of it.  Without ``shifted``, shares of
        exponentials are worked out as written, so one whose total overflows is infinity by infinity, no number.
        """
        spark = spark or SparkSession.getActiveSession()
        hints = dict(shape_hints or {})
        missing = [n for n in self.input_variables if n not in inputs]
        if missing:
            raise ValueError(f"inputs are missing: {', '.join(missing)}")
        for n, t in inputs.items():
            if n in self.variables and self.variables[n].order != t.order:
                raise ValueError(f"{n} has order {t.order}; the program uses order {self.variables[n].order}")
        for n, shape in hints.items():
            if n in self.variables and self.variables[n].order != len(shape):
                raise ValueError(f"the shape of {n} has {len(shape)} axes; the program uses order {self.variables[n].order}")
        now = dict(inputs)
        #: Sums of exponentials by name, with what they were made of.
        totals: dict[str, tuple[Statement, dict[str, Tensor]]] = {}
        #: Results by what they were made of.  All tensors are held, so that no other takes the identity of one.
        same: dict[tuple, Tensor] = {}
        held: list[Tensor] = list(now.values())
        readers = self._readers()
        for at, s in enumerate(self.statements):
            name = s.output.name
            made_of = None if reads_itself(s) or name in now else (s.kind, s.output.subscripts, s.expression, tuple(id(now[r.name]) for r in s.reads), tuple(hints[name]) if name in hints else None)
            if made_of in same:
                totals.pop(name, None)
                now[name] = same[made_of]
                continue
            inner = shares(s, totals, now) if shifted else None
            totals.pop(name, None)
            if inner is not None and name not in now:
                now[name] = lower_shares(s, inner, now, spark, hints.get(name))
                self._kept(now, s, readers[at], shared, same, made_of, held)
                continue
            if s.kind == "+=" and isinstance(s.expression, Call) and s.expression.function == "exp" and not reads_itself(s):
                totals[name] = (s, {r.name: now[r.name] for r in s.reads})
            partial = any(isinstance(x, int) for x in s.output.subscripts) or len(s.output.letters) < sum(len(x) for x in s.output.subscripts if isinstance(x, str))
            old = now.get(name) if reads_itself(s) or partial else None
            hint = None if old is not None else hints.get(name)
            if hint is None and old is None and name in now and len(now[name].shape) == len(s.output.subscripts):
                try:
                    now[name] = lower(s, now, spark, None, None, tiled=tiled, exact=exact)
                    held.append(now[name])
                    continue
                except ValueError:
                    hint = now[name].shape
            now[name] = lower(s, now, spark, hint, old, tiled=tiled, exact=exact)
            self._kept(now, s, readers[at], shared, same, made_of, held)
        return now

    def _readers(self) -> list[int]:
        """For each statement, how many others read its result before the name gets another value."""
        out = []
        for at, s in enumerate(self.statements):
            count = 0
            for later in self.statements[at + 1 :]:
                count += any(r.name == s.output.name for r in later.reads)
                if later.output.name == s.output.name:
                    break
            out.append(count)
        return out

    @staticmethod
    def _kept(now: dict[str, Tensor], s: Statement, readers: int, shared: bool, same: dict[tuple, Tensor], made_of: tuple | None, held: list[Tensor]) -> None:
        """Store a result that several statements read, and remember what it was made of."""
        if shared and readers > 1 and (s.kind != "=" or len(s.reads) > 1):
            now[s.output.name] = settled(now[s.output.name])
        held.append(now[s.output.name])
        if made_of is not None:
            same[made_of] = now[s.output.name]

    def iterate(self, inputs: dict[str, Tensor], rounds: int, carried: tuple[str, ...], shape_hints: dict[str, tuple[int, ...]] | None = None, spark: SparkSession | None = None) -> dict[str, Tensor]:
        """The carried tensors after some rounds, each of which starts from the last one's.

        They are computed and checkpointed after every round, so plans do not grow.
        """
        now = dict(inputs)
        for _ in range(rounds):
            made = self.execute(now, shape_hints, spark)
            now |= {n: settled(made[n]) for n in carried}
        return {n: now[n] for n in carried}

    def statement_stats(self, spark: SparkSession) -> DataFrame:
        """(line, raw, loops, ops) of every statement."""
        return spark.createDataFrame([(s.line, s.raw, s.loop_count, s.op_count) for s in self.statements], "line int, raw string, loops int, ops int")

    def variable_usage(self, spark: SparkSession) -> DataFrame:
        """(name, order, lines) of every tensor."""
        return spark.createDataFrame([(v.name, v.order, list(v.lines)) for v in self.variables.values()], "name string, `order` int, lines array<int>")

    def explain(self, inputs: dict[str, Tensor], shape_hints: dict[str, tuple[int, ...]] | None = None) -> None:
        """Print the physical plan of every statement's result."""
        for name, t in self.execute(inputs, shape_hints).items():
            if name not in inputs:
                print(f"-- {name} {t.shape} {t.dtype}")
                t.frame.explain("formatted")


def compile(code: str) -> Program:  # noqa: A001
    """A program from source text; ValueError("Invalid program: ...") if it is not one."""
    return Program(parse(code))


def evaluate(statement: str | Statement, inputs: dict[str, Tensor], shape_hint: tuple[int, ...] | None = None, spark: SparkSession | None = None) -> Tensor:
    """The result of one statement.  A compound assignment to a supplied tensor goes on from its values."""
    spark = spark or SparkSession.getActiveSession()
    if isinstance(statement, str):
        (statement,) = parse(statement)
    old = inputs.get(statement.output.name)
    return lower(statement, inputs, spark, shape_hint, old, accumulate=old is not None and statement.kind != "=")
