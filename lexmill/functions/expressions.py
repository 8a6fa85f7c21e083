"""Mathematical and logical expressions, parsed once for each form and evaluated for all its rows as arrays.

A form is an expression with its numbers taken out; claims that differ in numbers only share one. Values are arrays of
shape (rows, points): numbers have one column of points, variables as many as they are looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np

NUMBER = re.compile(r"(?<![A-Za-z_0-9.])[0-9]+(?:[.][0-9]+)?(?![A-Za-z_0-9])")
_TOKEN = re.compile(r"\s*(?:(#)|([A-Za-z_][A-Za-z0-9_]*)|(\*\*|>>|<->|->|[-+*/%^(),!&|~]))")
#: Left binding powers of operators; powers bind to the right.
_LEFT = {"<->": 1, "->": 2, ">>": 2, "or": 3, "|": 3, "xor": 3, "and": 4, "&": 4, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "**": 9, "^": 9}
_RIGHT = {"**", "^", "->", ">>"}
_WORDS = {"and", "or", "not", "xor"}
Node = tuple
QUADRATURE = 48


class Unreadable(ValueError):
    pass


def form_of(text: str) -> tuple[str, list[float]]:
    """An expression with # for each number, and the numbers."""
    numbers: list[float] = []
    return NUMBER.sub(lambda m: numbers.append(float(m[0])) or "#", text), numbers


def parsed(form: str) -> Node:
    """The tree of a form: ("number", k), ("name", x), ("op", o, a, b), ("neg" | "not" | "!", a), ("call", f, args), ("tuple", items)."""
    tokens, at = [], 0
    text = form.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(form)
        tokens.append(m[0].strip())
        at = m.end()
    tokens.append("")
    place, numbers = 0, 0

    def take(wanted: str | None = None) -> str:
        nonlocal place
        t = tokens[place]
        if wanted is not None and t != wanted or wanted is None and not t:
            raise Unreadable(form)
        place += 1
        return t

    def items() -> list[Node]:
        out = []
        while tokens[place] != ")":
            out.append(expression(0))
            if tokens[place] != ")":
                take(",")
        take(")")
        return out

    def first() -> Node:
        nonlocal numbers
        t = take()
        if t == "#":
            numbers += 1
            return ("number", numbers - 1)
        if t == "(":
            own = items()
            if not own:
                raise Unreadable(form)
            return own[0] if len(own) == 1 else ("tuple", own)
        if t in ("-", "+"):
            inner = expression(8)
            return ("neg", inner) if t == "-" else inner
        if t in ("not", "~"):
            return ("not", expression(5))
        if re.match("[A-Za-z_]", t) and t not in _WORDS:
            if tokens[place] == "(":
                take("(")
                return ("call", t, items())
            return ("name", t)
        raise Unreadable(form)

    def expression(least: int) -> Node:
        left = first()
        while True:
            t = tokens[place]
            if t == "!":
                take()
                left = ("!", left)
            elif t in _LEFT and _LEFT[t] > least:
                take()
                left = ("op", t, left, expression(_LEFT[t] - (t in _RIGHT)))
            else:
                return left

    tree = expression(0)
    take("")
    return tree


def names(tree: Node) -> set[str]:
    """The free names of a tree, but for constants."""
    match tree:
        case ("name", x):
            return set() if x in CONSTANTS else {x}
        case ("call", "integrate" | "Integral", [f, ("tuple", [("name", x), a, b])]):
            return names(f) - {x} | names(a) | names(b)
        case ("call", _, args) | ("tuple", args):
            return set().union(*map(names, args))
        case ("op", _, a, b):
            return names(a) | names(b)
        case ("neg" | "not" | "!", a):
            return names(a)
    return set()


def _factorial(n: np.ndarray) -> np.ndarray:
    table = np.array([float(math.factorial(k)) for k in range(171)])
    whole = (n >= 0) & (n == np.floor(n)) & (n < len(table))
    return np.where(whole, table[np.where(whole, n, 0).astype(int)], np.nan)


def _falling(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return np.where(k > n, 0.0, _factorial(n) / _factorial(np.where(k > n, 0, n - k)))


def _binomial(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    n, k = np.broadcast_arrays(n, k)
    low = np.minimum(k, n - k)
    out = np.where(low < 0, 0.0, 1.0)
    for i in range(1, int(min(np.nanmax(low, initial=0), 2000)) + 1):
        out = np.where(i <= low, np.round(out * (n - low + i) / i), out)
    return np.where((k == np.floor(k)) & (n == np.floor(n)) & (low <= 2000), out, np.nan)


CONSTANTS = {"pi": math.pi, "E": math.e, "e": math.e, "true": 1.0, "false": 0.0, "True": 1.0, "False": 0.0}
CALLS: dict[str, Callable] = {"sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan, "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh}
CALLS |= {"exp": np.exp, "log": np.log, "ln": np.log, "sqrt": np.sqrt, "abs": np.abs, "Abs": np.abs, "factorial": _factorial, "binomial": _binomial, "C": _binomial, "P": _falling, "A": _falling}
CALLS |= {"gcd": lambda a, b: np.gcd(a.astype(np.int64), b.astype(np.int64)).astype(float), "lcm": lambda a, b: np.lcm(a.astype(np.int64), b.astype(np.int64)).astype(float)}
_TRUTH = {"And": lambda *x: np.minimum.reduce(x), "Or": lambda *x: np.maximum.reduce(x), "Not": lambda a: 1 - a, "Implies": lambda a, b: np.maximum(1 - a, b), "implies": lambda a, b: np.maximum(1 - a, b), "Equivalent": lambda a, b: 1.0 * (a == b), "Xor": lambda a, b: 1.0 * (a != b)}
_OPS: dict[str, Callable] = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "%": np.mod, "**": np.power, "^": np.power, "and": np.minimum, "&": np.minimum, "or": np.maximum, "|": np.maximum, "xor": _TRUTH["Xor"], "->": _TRUTH["Implies"], ">>": _TRUTH["Implies"], "<->": _TRUTH["Equivalent"]}


def evaluated(tree: Node, numbers: np.ndarray, bound: dict[str, np.ndarray]) -> np.ndarray:
    """The values of a tree for rows of numbers and names bound to arrays of shape (rows or 1, points); nan where there is none."""

    def value(n: Node, names: dict[str, np.ndarray]) -> np.ndarray:
        match n:
            case ("number", k):
                return numbers[:, k : k + 1]
            case ("name", x) if x in names:
                return names[x]
            case ("name", x) if x in CONSTANTS:
                return np.full((1, 1), CONSTANTS[x])
            case ("neg", a):
                return -value(a, names)
            case ("not", a):
                return 1 - value(a, names)
            case ("!", a):
                return _factorial(value(a, names))
            case ("op", o, a, b):
                return _OPS[o](value(a, names), value(b, names))
            case ("call", "integrate" | "Integral", [f, ("tuple", [("name", x), a, b])]):
                low, high = value(a, names), value(b, names)
                if low.shape[1] > 1 or high.shape[1] > 1:
                    raise Unreadable("nested integral")
                at, weight = np.polynomial.legendre.leggauss(QUADRATURE)
                points = (high - low) / 2 * at + (high + low) / 2
                return (value(f, names | {x: points}) * weight).sum(1, keepdims=True) * (high - low) / 2
            case ("call", f, args) if f in CALLS or f in _TRUTH:
                try:
                    return (CALLS.get(f) or _TRUTH[f])(*(value(a, names) for a in args))
                except TypeError as e:
                    raise Unreadable(str(n)) from e
        raise Unreadable(str(n))

    with np.errstate(all="ignore"):
        out = value(tree, bound)
    out = np.broadcast_to(out, np.broadcast_shapes((len(numbers), 1), out.shape)).astype(float)
    return np.where(np.isfinite(out), out, np.nan)
