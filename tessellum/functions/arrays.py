"""The operators of the language on numpy arrays of doubles, with the same results as the column forms.

Used where a statement is worked out on dense blocks.  A function that was added with ``register`` has no
form here; statements that call one stay with columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tessellum.lang.syntax import Call, Infix, Negative, Node, Number, Read, walk


def _power(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # One to a power that is no number, or infinite, is no number for columns.
    odd = np.isnan(b) | (np.isinf(b) & (np.abs(a) == 1))
    return np.where(odd, np.nan, np.power(a, b))


def _same(a: np.ndarray, b: np.ndarray, loose: bool) -> np.ndarray:
    return np.abs(a - b) < 1e-14 if loose else a == b


#: Operators that give 1 or 0, as booleans.
TESTS: dict[str, Callable] = {
    "==": _same,
    "!=": lambda a, b, loose: ~_same(a, b, loose),
    "&&": lambda a, b, loose: (a != 0) & (b != 0),
    "||": lambda a, b, loose: (a != 0) | (b != 0),
    "<": lambda a, b, loose: a < b,
    ">": lambda a, b, loose: a > b,
    "<=": lambda a, b, loose: a <= b,
    ">=": lambda a, b, loose: a >= b,
}
_BINARY: dict[str, Callable] = {
    "+": lambda a, b, loose: a + b,
    "-": lambda a, b, loose: a - b,
    "*": lambda a, b, loose: a * b,
    "/": lambda a, b, loose: a / b,
    "^": lambda a, b, loose: _power(a, b),
    **{name: (lambda test: lambda a, b, loose: test(a, b, loose).astype(float))(test) for name, test in TESTS.items()},
}
_UNARY: dict[str, Callable] = {
    "abs": np.abs, "exp": np.exp, "log": np.log, "log2": np.log2, "log10": np.log10, "sqrt": np.sqrt, "sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "acos": np.arccos,
    "atan": np.arctan, "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh, "asinh": np.arcsinh, "acosh": np.arccosh, "atanh": np.arctanh, "ceil": np.ceil, "floor": np.floor,
}


def supported(node: Node) -> bool:
    """Whether an expression of tensors and numbers has a form on arrays."""
    return all(isinstance(n, Number | Read | Negative | Infix) or (isinstance(n, Call) and n.function in _UNARY) for n in walk(node))


def function(name: str) -> Callable:
    """A function of the language on one number or an array."""

    def run(a):
        with np.errstate(all="ignore"):
            return _UNARY[name](np.float64(a))

    return run


def operator(name: str, loose: bool = False) -> Callable:
    """An infix operator of the language on two numbers or arrays."""

    def run(a, b):
        with np.errstate(all="ignore"):
            return _BINARY[name](np.float64(a), np.float64(b), loose)

    return run


def evaluate(node: Node, value: Callable[[Read], np.ndarray], loose: bool = False) -> np.ndarray:
    """An expression over broadcast arrays."""
    with np.errstate(all="ignore"):
        return _evaluate(node, value, loose)


def test(node: Infix, value: Callable[[Read], np.ndarray], loose: bool = False) -> np.ndarray:
    """An expression whose operator is one of ``TESTS``, as booleans."""
    with np.errstate(all="ignore"):
        return TESTS[node.operator](_evaluate(node.left, value, loose), _evaluate(node.right, value, loose), loose)


def _evaluate(node: Node, value, loose: bool) -> np.ndarray:
    match node:
        case Number():
            return np.float64(node.value)
        case Read():
            return value(node)
        case Negative():
            return -_evaluate(node.inner, value, loose)
        case Call():
            return _UNARY[node.function](_evaluate(node.inner, value, loose))
        case Infix():
            return _BINARY[node.operator](_evaluate(node.left, value, loose), _evaluate(node.right, value, loose), loose)
    raise ValueError(f"{node} has no form on arrays")
