"""Verifier engines for claims written as expressions: each form is parsed once a batch, and all its rows are evaluated as arrays.

A verdict is true, false, or null where a claim can't be read or has no value where it is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.functions.expressions import Unreadable, evaluated, form_of, names, parsed
from lexmill.plans.registry import query, read

TOLERANCE = 1e-6
#: Points at which functions are compared, and steps that limits are approached by.
POINTS = np.array([[0.55, 0.93, 1.37, 1.81, 2.29]])
STEPS = 2.0 ** -np.arange(6, 16)
#: Highest degree of equations, and distance up to which two roots are one.
DEGREE, SAME = 6, 1e-5
MOST_NAMES = 12


class Rows:
    """The rows of one form of claim: trees of its texts, and their numbers as arrays."""

    def __init__(self, trees: list, numbers: list[np.ndarray]):
        self.trees, self.numbers = trees, numbers

    def at(self, k: int, **bound: np.ndarray) -> np.ndarray:
        return evaluated(self.trees[k], self.numbers[k], bound)

    def free(self, *which: int) -> list[str]:
        return sorted(set().union(*(names(self.trees[k]) for k in which)))

    def variable(self, *which: int) -> str:
        found = self.free(*which)
        if len(found) > 1:
            raise Unreadable(", ".join(found))
        return found[0] if found else "x"


def near(a: np.ndarray, b: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Row by row: 1 where all values agree, 0 where one doesn't, nan where one is missing."""
    off = np.abs(a - b) > tolerance * np.maximum(1, np.abs(a))
    return np.where(np.isnan(a - b).any(1), np.nan, ~off.any(1) * 1.0)


def assignments(found: list[str]) -> dict[str, np.ndarray]:
    if len(found) > MOST_NAMES:
        raise Unreadable("too many names")
    bits = np.arange(1 << len(found))[None, :]
    return {n: (bits >> k & 1).astype(float) for k, n in enumerate(found)}


def numeric_eval(r: Rows) -> np.ndarray:
    """Values are compared as they are, but for the rounding of large ones."""
    a, b = r.at(0), r.at(1)
    return np.where(np.isnan(a - b), np.nan, np.abs(a - b) <= TOLERANCE + 1e-12 * np.abs(a))[:, 0]


def logic_equivalence(r: Rows) -> np.ndarray:
    bound = assignments(r.free(0, 1))
    return near(r.at(0, **bound), r.at(1, **bound))


def logic_negation(r: Rows) -> np.ndarray:
    bound = assignments(r.free(0, 1))
    return near(1 - r.at(0, **bound), r.at(1, **bound))


def truth_table(r: Rows) -> np.ndarray:
    """The value of a under the assignment "1, 0, ..." of its names in order, which is c, against b."""
    found = r.free(0)
    given = r.numbers[2]
    if given.shape[1] != len(found):
        raise Unreadable("assignment")
    return near(r.at(0, **{n: given[:, k : k + 1] for k, n in enumerate(found)}), r.at(1))


def simplify_equiv(r: Rows) -> np.ndarray:
    x = r.variable(0, 1)
    return near(r.at(0, **{x: POINTS}), r.at(1, **{x: POINTS}))


def derivative(r: Rows) -> np.ndarray:
    """Richardson's extrapolation of central differences against the claimed derivative."""
    x, h = r.variable(0, 1), 2.0**-7
    slope = lambda h: (r.at(0, **{x: POINTS + h}) - r.at(0, **{x: POINTS - h})) / (2 * h)
    a, b, c = slope(h), slope(h / 2), slope(h / 4)
    return near((64 * c - 20 * b + a) / 45, r.at(1, **{x: POINTS}), 1e-5)


def integral(r: Rows) -> np.ndarray:
    """a is the integrand, b the claimed value, c the bounds "low, high"."""
    x, bounds = r.variable(0), r.trees[2]
    low, high = bounds[1] if bounds[0] == "tuple" else (None, None)
    if low is None:
        raise Unreadable("bounds")
    whole = ("call", "integrate", [r.trees[0], ("tuple", [("name", x), _moved(low, r.numbers[0].shape[1]), _moved(high, r.numbers[0].shape[1])])])
    return near(evaluated(whole, np.hstack([r.numbers[0], r.numbers[2]]), {}), r.at(1))


def _moved(tree: tuple, by: int) -> tuple:
    """A tree whose numbers are counted from by on."""
    if tree[0] == "number":
        return ("number", tree[1] + by)
    return tuple(_moved(t, by) if isinstance(t, tuple) else [_moved(x, by) for x in t] if isinstance(t, list) else t for t in tree)


def limit(r: Rows) -> np.ndarray:
    """The value that a nears where its variable nears c (oo: without bound), from both sides, against b."""
    x = r.variable(0)
    if r.trees[2] == ("name", "oo"):
        sides = [1 / STEPS[None, :] ** 2]
    else:
        at = evaluated(r.trees[2], r.numbers[2], {})
        sides = [at + STEPS, at - STEPS]
    ends = []
    for points in sides:
        v = r.at(0, **{x: points})
        ends.append(2 * v[:, -1:] - v[:, -2:-1] if len(sides) > 1 else v[:, -1:])
    both = near(ends[0], r.at(1), 1e-4)
    return both if len(ends) == 1 else both * near(ends[1], r.at(1), 1e-4)


def solve_equation(r: Rows) -> np.ndarray:
    """Whether b, a list of numbers, has all the distinct roots of the polynomial a and no other."""
    x = r.variable(0)
    points = np.cos(np.pi * (np.arange(2 * DEGREE) + 0.5) / (2 * DEGREE))[None, :] * 3
    value = np.broadcast_to(r.at(0, **{x: points}), (len(r.numbers[0]), points.shape[1]))
    powers = points[0][:, None] ** np.arange(DEGREE, -1, -1)
    # columns of the coefficients, highest first, by least squares over all rows at once
    good = np.isfinite(value).all(1)
    factor = np.linalg.lstsq(powers, np.where(good[:, None], value, 0).T, rcond=None)[0].T
    size = np.abs(value).max(1, initial=1)
    good &= np.abs(factor @ powers.T - value).max(1) <= 1e-8 * size
    factor[np.abs(factor) <= 1e-9 * size[:, None]] = 0
    degree = DEGREE - np.argmax(factor != 0, axis=1)
    claimed = _listed(r, 1)
    out = np.full(len(value), np.nan)
    for d in np.unique(degree[good]):
        rows = np.flatnonzero(good & (degree == d) & (factor != 0).any(1))
        if d == 0 or not len(rows):
            continue
        top = factor[rows, DEGREE - d :]
        companion = np.zeros((len(rows), d, d))
        companion[:, np.arange(1, d), np.arange(d - 1)] = 1
        companion[:, 0, :] = -top[:, 1:] / top[:, :1]
        roots = np.linalg.eigvals(companion)
        far = np.abs(roots[:, :, None] - claimed[rows][:, None, :]) > 1e3 * SAME
        own = np.abs(roots[:, :, None] - roots[:, None, :]) > 1e3 * SAME
        twice = np.abs(claimed[rows][:, :, None] - claimed[rows][:, None, :]) > SAME
        distinct = lambda apart: (apart | (np.arange(apart.shape[1])[:, None] <= np.arange(apart.shape[1])[None, :])).all(2).sum(1)
        out[rows] = (~far).any(2).all(1) & (~far).any(1).all(1) & (distinct(own) == distinct(twice))
    return out


def _listed(r: Rows, k: int) -> np.ndarray:
    """The values of a text that is one expression or several between commas."""
    tree = r.trees[k]
    parts = tree[1] if tree[0] == "tuple" else [tree]
    return np.hstack([np.broadcast_to(evaluated(p, r.numbers[k], {}), (len(r.numbers[k]), 1)) for p in parts])


def probability(r: Rows) -> np.ndarray:
    p = r.at(0)
    return np.where(((p < 0) | (p > 1))[:, 0], 0.0, near(p, r.at(1)))


ENGINES = {f.__name__: f for f in (numeric_eval, logic_equivalence, logic_negation, truth_table, simplify_equiv, derivative, integral, limit, solve_equation, probability)}
ENGINES |= {"trig_identity": simplify_equiv, "counting": numeric_eval}


def decided(kind: list[str], texts: list[list[str]]) -> list[bool | None]:
    """Verdicts of claims, given as columns: type and three texts, which are null where they aren't needed."""
    groups: dict[tuple, list[int]] = {}
    numbers: list[list[list[float]]] = []
    for i, (k, *own) in enumerate(zip(kind, *texts, strict=True)):
        forms = [form_of(t or "") for t in own]
        numbers.append([n for _, n in forms])
        groups.setdefault((k, *(f for f, _ in forms)), []).append(i)
    out: list[bool | None] = [None] * len(kind)
    for (k, *forms), rows in groups.items():
        try:
            engine = ENGINES[k]
            # a list in a claim is read as one in brackets; a text that is missing has no value
            trees = [parsed(f"({f})") if f else ("missing",) for f in forms]
            held = [np.array([numbers[i][j] for i in rows], float).reshape(len(rows), -1) if forms[j] else np.zeros((len(rows), 1)) for j in range(len(forms))]
            found = engine(Rows(trees, held))
        except (Unreadable, KeyError, IndexError, RecursionError):
            continue
        for i, v in zip(rows, np.broadcast_to(found, len(rows)).tolist(), strict=True):
            out[i] = None if v != v else bool(v)
    return out


def verdicts(claims: DataFrame) -> DataFrame:
    """(claim_id, type, verdict) of claims (claim_id, type, a, b, c); unknown types and unreadable claims are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = decided(batch.column("type").to_pylist(), [batch.column(c).to_pylist() for c in "abc"])
            yield pa.RecordBatch.from_arrays([batch.column("claim_id"), batch.column("type"), pa.array(found, pa.bool_())], ["claim_id", "type", "verdict"])

    return claims.select("claim_id", "type", "a", "b", "c").mapInArrow(run, "claim_id long, type string, verdict boolean")


#: Claims written from the columns k (a key), p and q (small numbers) and w (0 or 1; 1 makes a false claim): type, texts, and their verdict in SQL.
WRITTEN = [
    ("numeric_eval", "p || ' + 2*' || q || '^2 - sqrt(' || (p * p) || ')'", "(2 * q * q + w)", "''", "w = 0"),
    ("numeric_eval", "'integrate(' || p || '*x^2 + ' || q || ', (x, 0, ' || (3 * q) || '))'", "(9 * p * q * q * q + 3 * q * q + w)", "''", "w = 0"),
    ("integral", "p || '*t^3 - t'", "(4 * p - 2 + w)", "'0, 2'", "w = 0"),
    ("derivative", "p || '*x^3 - ' || q || '*x'", "(3 * p + w) || '*x^2 - ' || q", "''", "w = 0"),
    ("simplify_equiv", "'(x + ' || p || ')^2'", "'x^2 + ' || (2 * p) || '*x + ' || (p * p + w)", "''", "w = 0"),
    ("limit", "'(' || p || '*x^2 + x)/(x^2 + ' || q || ')'", "(p + w)", "'oo'", "w = 0"),
    ("limit", "'sin(' || p || '*x)/x'", "(p + w)", "'0'", "w = 0"),
    ("trig_identity", "'sin(' || p || '*x)^2 + cos(' || p || '*x)^2'", "(1 + w)", "''", "w = 0"),
    ("counting", "'C(' || (p + 3) || ',2) + P(' || (q + 2) || ',2) + 3!'", "((p + 3) * (p + 2) / 2 + (q + 2) * (q + 1) + 6 + w)", "''", "w = 0"),
    ("probability", "p || '/' || (p + q) || ' * 1/2'", "p || '/' || (2 * p + 2 * q + w)", "''", "w = 0"),
    ("probability", "(p + q + w) || '/' || (p + q)", "'1'", "''", "w = 0"),
    ("logic_equivalence", "'p -> q'", "CASE w WHEN 0 THEN '~p | q' ELSE 'p | ~q' END", "''", "w = 0"),
    ("logic_negation", "'a' || p || ' and b'", "CASE w WHEN 0 THEN 'not a' || p || ' or not b' ELSE 'not a' || p || ' and not b' END", "''", "w = 0"),
    ("truth_table", "'(p & q) | ~r'", "'1'", "(p % 2) || ', ' || (q % 2) || ', ' || w", "(p % 2) * (q % 2) = 1 OR w = 0"),
    ("solve_equation", "'x^2 - ' || (p + q) || '*x + ' || (p * q)", "p || ', ' || (q + w)", "''", "w = 0"),
    ("solve_equation", "'x^3 - ' || p || '*x^2'", "CASE w WHEN 0 THEN '0, ' || p ELSE '0' END", "''", "w = 0"),
    ("numeric_eval", "p || ' + ) ' || q", "'1'", "''", "NULL"),
]
_N = len(WRITTEN)
_pick = lambda j, cast: "CASE k % {} {} END".format(_N, " ".join(f"WHEN {i} THEN CAST({row[j]} AS {cast})" for i, row in enumerate(WRITTEN)))
_CLAIM_COLUMNS = ["o_orderkey AS k", "o_custkey % 40 + 1 AS p", "o_orderkey % 37 + 2 AS q", "o_custkey % 2 AS w"]


@query(
    f"""WITH c AS (SELECT {', '.join(_CLAIM_COLUMNS)} FROM orders)
SELECT k AS claim_id, CASE k % {_N} {' '.join(f"WHEN {i} THEN '{row[0]}'" for i, row in enumerate(WRITTEN))} END AS type, CASE k % {_N} {' '.join(f'WHEN {i} THEN {row[4]}' for i, row in enumerate(WRITTEN))} END::BOOLEAN AS verdict FROM c"""
)
def expression_claims(spark, sf_dir):
    """Claims of eleven types whose numbers come from columns, by the engines; the SQL knows which of them are false."""
    rows = read(spark, sf_dir, "orders").selectExpr(*_CLAIM_COLUMNS)
    kind = f"CASE k % {_N} " + " ".join(f"WHEN {i} THEN '{row[0]}'" for i, row in enumerate(WRITTEN)) + " END"
    texts = [_pick(j, "STRING").replace(" / 2 ", " div 2 ") for j in (1, 2, 3)]
    return verdicts(rows.select(F.col("k").alias("claim_id"), F.expr(kind).alias("type"), *(F.expr(t).alias(c) for t, c in zip(texts, "abc", strict=True))))
