"""Scalar operators on double columns with IEEE 754 results under ANSI SQL settings.

ANSI mode raises on division by zero, turns logarithms of non-positive numbers into NULL and orders
NaN above all numbers; the expressions here give infinities and NaN, and comparisons with NaN are
false.  Truth values are 0.0 and 1.0.  All are built-in functions and stay in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def truth(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def divide(a: Column, b: Column) -> Column:
    infinite = F.when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    # The sign of a zero divisor shows in its text only.
    signed = F.when(b.cast("string").startswith("-"), -infinite).otherwise(infinite)
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(signed)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def _same(a: Column, b: Column, loose: bool) -> Column:
    if loose:
        return F.abs(a - b) < 1e-14
    return (a == b) & ~F.isnan(a)


def _logarithm(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: F.when(a > 0, f(a)).when(a == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    # Doubles from 2**52 on are whole already, and infinities and NaN have no whole number.
    return lambda a: F.when(F.abs(a) < float(1 << 52), f(a).cast("double")).otherwise(a)


BINARY: dict[str, Callable[[Column, Column, bool], Column]] = {
    "+": lambda a, b, loose: a + b,
    "-": lambda a, b, loose: a - b,
    "*": lambda a, b, loose: a * b,
    "/": lambda a, b, loose: divide(a, b),
    "^": lambda a, b, loose: F.pow(a, b),
    "==": lambda a, b, loose: truth(_same(a, b, loose)),
    "!=": lambda a, b, loose: truth(~_same(a, b, loose)),
    "&&": lambda a, b, loose: truth((a != 0) & (b != 0)),
    "||": lambda a, b, loose: truth((a != 0) | (b != 0)),
    "<": lambda a, b, loose: truth((a < b) & ~F.isnan(b)),
    ">": lambda a, b, loose: truth((a > b) & ~F.isnan(a)),
    "<=": lambda a, b, loose: truth((a <= b) & ~F.isnan(a) & ~F.isnan(b)),
    ">=": lambda a, b, loose: truth((a >= b) & ~F.isnan(a) & ~F.isnan(b)),
}

UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "exp": F.exp,
    "log": _logarithm(F.ln),
    "log2": _logarithm(F.log2),
    "log10": _logarithm(F.log10),
    "sqrt": F.sqrt,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": F.acosh,
    "atanh": F.atanh,
    "ceil": _whole(F.ceil),
    "floor": _whole(F.floor),
}


def register(name: str, function: Callable[[Column], Column]) -> None:
    """Make a function of one column callable by ``name`` in programs."""
    if not name.isidentifier() or not name.islower():
        raise ValueError(f"a function needs a lower-case name, not {name!r}")
    UNARY[name] = function
