"""Verifier engines: typed claims that are checked by built-in arithmetic, folds, graph aggregates or exact evaluators.

A verdict is true, false, or null where a claim can't be decided.
"""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Iterator
from fractions import Fraction
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.plans.registry import query, read

from .numbers import mod_pow


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a fold; each two steps halve the smaller number, so its bits tell how many are enough."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(F.least(F.abs(a), F.abs(b)), F.lit(1)).cast("double")) * 1.45).cast("int") + 3)
    out = F.aggregate(steps, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda s, _: F.struct(F.when(s.b == 0, s.a).otherwise(s.b).alias("a"), F.when(s.b == 0, F.lit(0).cast("long")).otherwise(s.a % F.when(s.b == 0, F.lit(1)).otherwise(s.b)).alias("b")))
    return F.abs(out.a)


@query(
    """SELECT o_orderkey AS claim_id, gcd(o_orderkey, o_custkey)::BIGINT AS g, (o_orderkey // gcd(o_orderkey, o_custkey) * o_custkey)::BIGINT AS l, (o_orderkey * o_orderkey % 97 * o_orderkey % 97)::BIGINT AS p,
 (o_orderkey * o_orderkey % 97 * o_orderkey % 97) = o_custkey % 97 AS verified FROM orders"""
)
def verify_modular(spark, sf_dir):
    """gcd, lcm and modular powers; the claim is that key**3 equals the customer's number modulo 97."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b")).withColumn("g", gcd(F.col("a"), F.col("b")))
    power = F.expr(mod_pow("a", "3L", "97L"))
    return rows.select(F.col("a").alias("claim_id"), "g", F.expr("a div g * b").alias("l"), power.alias("p"), (power == F.col("b") % 97).alias("verified"))


@query(
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, abs(3 * l_partkey + 4 * l_suppkey - 5)::BIGINT AS distance_times_5, abs(3 * l_partkey + 4 * l_suppkey - 5) = 5 * l_quantity::BIGINT AS verified,
 ((l_partkey - l_suppkey) * (l_partkey - l_suppkey) + l_linenumber * l_linenumber)::BIGINT AS squared FROM lineitem"""
)
def verify_analytic(spark, sf_dir):
    """Distance of a point to the line 3x + 4y = 5 against the claimed one, and a squared distance of two points."""
    x, y, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long")
    far = F.abs(3 * x + 4 * y - 5)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("l_linenumber"), far.alias("distance_times_5"), (far == 5 * F.col("l_quantity").cast("long")).alias("verified"), ((x - y) * (x - y) + n * n).alias("squared"))


@query(
    """WITH RECURSIVE r(id, n, k, a, b) AS (SELECT p_partkey, p_size::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT FROM part UNION ALL SELECT id, n, k + 1, b, (a + 2 * b) % 1000003 FROM r WHERE k < n)
SELECT id AS claim_id, n, a AS value, a % 2 = n % 2 AS verified FROM r WHERE k = n"""
)
def verify_recurrence(spark, sf_dir):
    """u(k) = u(k-2) + 2 u(k-1) modulo 1000003 by a fold; the claim is its parity."""
    n = F.col("p_size").cast("long")
    step = F.aggregate(F.sequence(F.lit(0).cast("long"), n), F.struct(F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b")), lambda s, k: F.when(k < n, F.struct(s.b.alias("a"), ((s.a + 2 * s.b) % 1000003).alias("b"))).otherwise(s), lambda s: s.a)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim_id"), n.alias("n"), step.alias("value"), (step % 2 == n % 2).alias("verified"))


@query("SELECT p_partkey AS claim_id, (p_size * (p_size - 1) // 2)::BIGINT AS pairs, (p_size * (p_size - 1) * (p_size - 2) // 6)::BIGINT AS triples, p_size * (p_size - 1) // 2 = p_partkey AS verified FROM part")
def verify_counting(spark, sf_dir):
    """Binomial coefficients against a claimed count."""
    n = F.col("p_size").cast("long")
    pairs = F.expr("CAST(p_size AS BIGINT) * (p_size - 1) div 2")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim_id"), pairs.alias("pairs"), F.expr("CAST(p_size AS BIGINT) * (p_size - 1) * (p_size - 2) div 6").alias("triples"), (pairs == F.col("p_partkey")).alias("verified"), (n * 0).alias("_")).drop("_")


@query(
    """WITH e AS (SELECT DISTINCT 'p' || l_partkey % 200 AS a, 's' || l_suppkey AS b FROM lineitem), d AS (SELECT v, count(*) AS deg FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) GROUP BY v)
SELECT count(*) AS vertices, (SELECT count(*) FROM e) AS edges, max(deg) AS max_degree, count(*) FILTER (WHERE deg % 2 = 1) AS odd, count(*) FILTER (WHERE deg % 2 = 1) = 0 AS even_everywhere, sum(deg)::BIGINT = 2 * (SELECT count(*) FROM e) AS handshake FROM d"""
)
def verify_graph(spark, sf_dir):
    """Degrees of the bipartite part-supplier graph: handshake sum, odd vertices, Euler's condition."""
    edges = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey") % 200).alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    degrees = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("deg"))
    out = degrees.agg(F.count("*").alias("vertices"), F.expr("sum(deg) div 2").alias("edges"), F.max("deg").alias("max_degree"), F.count_if(F.expr("deg % 2 = 1")).alias("odd"), F.sum("deg").alias("s"))
    return out.select("vertices", "edges", "max_degree", "odd", (F.col("odd") == 0).alias("even_everywhere"), (F.col("s") == 2 * F.col("edges")).alias("handshake"))


@query("SELECT p_partkey AS claim_id, (p_size - 1)::BIGINT AS edges, (power(2, p_size % 20 + 1) - 1)::BIGINT AS nodes_of_height, p_size - 1 = p_partkey % 50 AS verified FROM part")
def verify_tree(spark, sf_dir):
    """Closed forms of trees: edges of n vertices, nodes of a full binary tree of a height."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim_id"), (F.col("p_size") - 1).cast("long").alias("edges"), F.expr("shiftleft(1L, p_size % 20 + 1) - 1").alias("nodes_of_height"), (F.col("p_size") - 1 == F.col("p_partkey") % 50).alias("verified"))


def determinant(m: list[list[Fraction]]) -> Fraction:
    m, out = [row[:] for row in m], Fraction(1)
    for k in range(len(m)):
        pivot = next((r for r in range(k, len(m)) if m[r][k]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            m[k], m[pivot], out = m[pivot], m[k], -out
        out *= m[k][k]
        for r in range(k + 1, len(m)):
            f = m[r][k] / m[k][k]
            m[r] = [x - f * y for x, y in zip(m[r], m[k], strict=True)]
    return out


def rank(m: list[list[Fraction]]) -> int:
    m, out = [row[:] for row in m], 0
    for k in range(len(m[0]) if m else 0):
        pivot = next((r for r in range(out, len(m)) if m[r][k]), None)
        if pivot is None:
            continue
        m[out], m[pivot] = m[pivot], m[out]
        for r in range(out + 1, len(m)):
            f = m[r][k] / m[out][k]
            m[r] = [x - f * y for x, y in zip(m[r], m[out], strict=True)]
        out += 1
    return out


_M = ["o_orderkey % 7", "o_custkey % 5", "3", "o_custkey % 7", "o_orderkey % 5", "1", "2", "o_orderkey % 3", "o_custkey % 3"]


@query(
    "WITH m AS (SELECT o_orderkey AS claim_id, "
    + ", ".join(f"({x})::BIGINT AS m{i}" for i, x in enumerate(_M))
    + """ FROM orders), d AS (SELECT *, m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6) AS det FROM m)
SELECT claim_id, det, CASE WHEN det <> 0 THEN 3 WHEN m0 * m4 <> m1 * m3 OR m0 * m5 <> m2 * m3 OR m1 * m5 <> m2 * m4 OR m0 * m7 <> m1 * m6 OR m0 * m8 <> m2 * m6 OR m1 * m8 <> m2 * m7 OR m3 * m7 <> m4 * m6 OR m3 * m8 <> m5 * m6 OR m4 * m8 <> m5 * m7 THEN 2 ELSE 1 END::BIGINT AS rank FROM d"""
)
def verify_matrix(spark, sf_dir):
    """Determinant and rank of 3x3 integer matrices, by minors."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), *(F.expr(x).cast("long").alias(f"m{i}") for i, x in enumerate(_M)))
    minor = lambda r, s, i, j: f"m{3 * r + i} * m{3 * s + j} - m{3 * r + j} * m{3 * s + i}"
    det = F.expr(f"m0 * ({minor(1, 2, 1, 2)}) - m1 * ({minor(1, 2, 0, 2)}) + m2 * ({minor(1, 2, 0, 1)})")
    some = " or ".join(f"{minor(r, s, i, j)} <> 0" for r, s in ((0, 1), (0, 2), (1, 2)) for i, j in ((0, 1), (0, 2), (1, 2)))
    entry = " or ".join(f"m{i} <> 0" for i in range(9))
    return rows.select("claim_id", det.alias("det"), F.when(det != 0, 3).when(F.expr(some), 2).when(F.expr(entry), 1).otherwise(0).cast("long").alias("rank"))


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}
_CALLS = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "exp": math.exp, "log": math.log, "factorial": math.factorial, "binomial": math.comb, "abs": abs, "gcd": math.gcd}


def evaluate(text: str, names: dict | None = None):
    """The value of an arithmetic or logical expression of listed nodes only, or None; nothing of it is executed as code."""

    def value(n):
        match n:
            case ast.Constant(value=v) if isinstance(v, (int, float, bool)):
                return v
            case ast.Name(id=name) if name in (names or {}):
                return names[name]
            case ast.Name(id="pi"):
                return math.pi
            case ast.BinOp(left=a, op=ast.Pow(), right=b):
                x, y = value(a), value(b)
                if abs(y) > 64 or abs(x) > 1e6:
                    raise ValueError
                return x**y
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPS:
                return _OPS[type(op)](value(a), value(b))
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return not value(a)
            case ast.UnaryOp(op=op, operand=a) if type(op) in _OPS:
                return _OPS[type(op)](value(a))
            case ast.BoolOp(op=ast.And(), values=vs):
                return all(value(v) for v in vs)
            case ast.BoolOp(values=vs):
                return any(value(v) for v in vs)
            case ast.Call(func=ast.Name(id="implies"), args=[a, b]):
                return not value(a) or bool(value(b))
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]) if f in _CALLS:
                xs = [value(a) for a in args]
                if f in ("factorial", "binomial") and any(x > 500 for x in xs):
                    raise ValueError
                return _CALLS[f](*xs)
        raise ValueError

    try:
        return value(ast.parse(text.replace("^", "**"), mode="eval").body)
    except (ValueError, SyntaxError, TypeError, ZeroDivisionError, OverflowError, RecursionError, AttributeError):
        return None


def equivalent(a: str, b: str) -> bool | None:
    """Whether two logical expressions agree on all assignments of their up to twelve names."""
    try:
        names = sorted({n.id for text in (a, b) for n in ast.walk(ast.parse(text, mode="eval")) if isinstance(n, ast.Name) and n.id != "implies"})
    except SyntaxError:
        return None
    if len(names) > 12:
        return None
    for bits in product((False, True), repeat=len(names)):
        x, y = evaluate(a, dict(zip(names, bits, strict=True))), evaluate(b, dict(zip(names, bits, strict=True)))
        if x is None or y is None:
            return None
        if bool(x) != bool(y):
            return False
    return True


def same_function(a: str, b: str, name: str = "x") -> bool | None:
    """False if two expressions differ at one of five points, else true as far as points can tell; null if one has no value."""
    for k in range(5):
        x, y = evaluate(a, {name: 0.5 + 0.4 * k}), evaluate(b, {name: 0.5 + 0.4 * k})
        if x is None or y is None:
            return None
        if abs(x - y) > 1e-6 * max(1.0, abs(y)):
            return False
    return True


def derivative_is(function: str, claim: str, name: str = "x", h: float = 1e-4) -> bool | None:
    """Whether a five-point difference quotient agrees with the claimed derivative at five points."""
    for k in range(5):
        at = 0.5 + 0.4 * k
        f = [evaluate(function, {name: at + j * h}) for j in (-2, -1, 1, 2)]
        y = evaluate(claim, {name: at})
        if y is None or any(v is None for v in f):
            return None
        if abs((f[0] - 8 * f[1] + 8 * f[2] - f[3]) / (12 * h) - y) > 1e-5 * max(1.0, abs(y)):
            return False
    return True


def integral_is(function: str, low: float, high: float, claim: float, name: str = "x", n: int = 200) -> bool | None:
    """Composite Simpson's rule against a claimed definite integral."""
    points = [evaluate(function, {name: low + (high - low) * k / n}) for k in range(n + 1)]
    if any(v is None for v in points):
        return None
    total = (high - low) / n / 3 * (points[0] + points[-1] + 4 * sum(points[1:-1:2]) + 2 * sum(points[2:-1:2]))
    return abs(total - claim) <= 1e-6 * max(1.0, abs(claim))


def verdicts(rows: DataFrame) -> DataFrame:
    """(claim_id, type, verdict) of rows (claim_id, type, a, b, low, high): engines by type, null for unknown types."""
    engines = {
        "numeric_eval": lambda r: None if (v := evaluate(r.a)) is None else abs(v - float(r.b)) <= 1e-6 * max(1.0, abs(float(r.b))),
        "logic_equivalence": lambda r: equivalent(r.a, r.b),
        "logic_negation": lambda r: equivalent(f"not ({r.a})", r.b),
        "simplify_equiv": lambda r: same_function(r.a, r.b),
        "derivative": lambda r: derivative_is(r.a, r.b),
        "integral": lambda r: integral_is(r.a, r.low, r.high, float(r.b)),
        "probability": lambda r: None if (v := evaluate(r.a)) is None else 0 <= v <= 1 and abs(v - float(r.b)) <= 1e-6,
    }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [engines[r.type](r) if r.type in engines else None for r in pdf.itertuples()]
            yield pd.DataFrame({"claim_id": pdf["claim_id"], "type": pdf["type"], "verdict": pd.array(found, "boolean")})

    return rows.mapInPandas(run, "claim_id long, type string, verdict boolean")


@query("SELECT o_orderkey AS claim_id, CASE o_orderkey % 2 WHEN 0 THEN 'numeric_eval' ELSE 'unknown' END AS type, CASE o_orderkey % 2 WHEN 0 THEN (o_orderkey % 11 + 2 * (o_custkey % 13) = o_orderkey % 30) END AS verdict FROM orders")
def verify_expressions(spark, sf_dir):
    """Arithmetic claims written as text, by the expression evaluator; equal claims are decided once."""
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "numeric_eval").otherwise("unknown").alias("type"),
        F.format_string("%d + 2 * %d", F.col("o_orderkey") % 11, F.col("o_custkey") % 13).alias("a"),
        (F.col("o_orderkey") % 30).cast("string").alias("b"),
        F.lit(0.0).alias("low"),
        F.lit(0.0).alias("high"),
    )
    claim = ["type", "a", "b", "low", "high"]
    once = rows.groupBy(*claim).agg(F.min("claim_id").alias("claim_id"))
    told = verdicts(once).withColumnRenamed("claim_id", "first").drop("type")
    same = rows.join(once.withColumnRenamed("claim_id", "first"), claim).join(told, "first")
    return same.select("claim_id", "type", "verdict")
