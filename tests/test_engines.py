"""Expression, modular, recurrence and graph engines against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions.expressions import Unreadable, evaluated, form_of, parsed
from lexmill.operators import expressions, numbers


def value(text, **names):
    form, own = form_of(text)
    return evaluated(parsed(form), np.array([own]), {k: np.array([[v]]) for k, v in names.items()})[0, 0]


def test_values():
    for text, want in [("2^3^2", 512), ("-2^2", -4), ("2*-3", -6), ("1 - 2 - 3", -4), ("7 % 4 * 2", 6), ("(1 + 2)!", 6), ("C(5, 2) + P(4,2)", 22), ("gcd(12, 18)", 6), ("sqrt(2)*sin(pi/4)", 1), ("ln(E)", 1), ("x1*2", 10), ("integrate(x^2, (x, 0, 3))", 9), ("integrate(a*x, (x, 0, 2))", 6), ("true and not false", 1), ("p -> q -> p", 1)]:
        assert value(text, x1=5.0, a=3.0, p=1.0, q=0.0) == pytest.approx(want)
    assert math.isnan(value("log(0 - 1)")) and math.isnan(value("170.5!"))
    for text in ("", "1 +", "(1", "f(2)", "1 2", "__import__('os')", "sin()", "2 $ 3", "()"):
        with pytest.raises((Unreadable, TypeError, ValueError)):
            value(text)


CLAIMS = [
    ("numeric_eval", "2^10", "1024", None, True), ("numeric_eval", "2^10", "1025", None, False), ("numeric_eval", "1/0", "1", None, None), ("numeric_eval", "boom(", "1", None, None), ("unknown", "1", "1", None, None),
    ("logic_equivalence", "p -> q", "not p or q", "", True), ("logic_equivalence", "p & q", "p | q", "", False), ("logic_negation", "p and q", "not p or not q", None, True), ("logic_negation", "Implies(p, q)", "p & ~q", None, True),
    ("truth_table", "p & ~q", "1", "1, 0", True), ("truth_table", "p & ~q", "1", "1", None), ("simplify_equiv", "(x + 1)^2", "x^2 + 2*x + 1", None, True), ("simplify_equiv", "x", "x + y", None, None), ("derivative", "sin(x)*x", "sin(x) + x*cos(x)", None, True), ("derivative", "x^3", "2*x^2", None, False),
    ("integral", "3*x^2", "8", "0, 2", True), ("integral", "3*x^2", "7", "0, 2", False), ("integral", "x", "1", "5", None), ("limit", "sin(x)/x", "1", "0", True), ("limit", "1/x", "0", "oo", True), ("limit", "abs(x)/x", "1", "0", False), ("trig_identity", "sin(2*x)", "2*sin(x)*cos(x)", None, True),
    ("solve_equation", "x^2 - 5*x + 6", "2, 3", None, True), ("solve_equation", "x^2 - 5*x + 6", "2", None, False), ("solve_equation", "x^2 - 5*x + 6", "2, 3, 4", None, False), ("solve_equation", "(x - 1)^2", "1", None, True), ("solve_equation", "x^2 + 1", "1", None, False), ("solve_equation", "sin(x)", "0", None, None),
    ("probability", "C(3,1)/2^3", "3/8", None, True), ("probability", "3/2", "3/2", None, False), ("counting", "5!/(2!*3!)", "10", None, True), ("counting", None, "1", None, None),
]


def test_verdicts(spark):
    rows = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CLAIMS)], "claim_id long, type string, a string, b string, c string")
    got = {r["claim_id"]: r["verdict"] for r in expressions.verdicts(rows).collect()}
    assert [got[k] for k in range(len(CLAIMS))] == [c[4] for c in CLAIMS]


def test_forms_are_parsed_once(monkeypatch):
    seen = []
    real = expressions.parsed
    monkeypatch.setattr(expressions, "parsed", lambda f: seen.append(f) or real(f))
    rng = random.Random(1)
    own = [(rng.randrange(10**6), rng.randrange(10**6)) for _ in range(10_000)]
    told = expressions.decided(["numeric_eval"] * len(own), [[f"{a} + 2*{b}" for a, b in own], [str(a + 2 * b) for a, b in own], [None] * len(own)])
    assert all(told) and len(seen) == 2


def test_modular_powers(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-(2**62), 2**62), rng.choice([0, 1, 2, 2**22, rng.randrange(2**62), 2**62]), rng.choice([1, 2, 97, 2**31 - 1, 2**62 - 57, 2**63 - 25])) for _ in range(200)]
    got = spark.createDataFrame(rows, "a long, e long, m long").select("a", "e", "m", F.expr(numbers.mod_pow("a", "e", "m")).alias("p"), F.expr(numbers.gcd("a", "e")).alias("g")).collect()
    assert all(r["p"] == pow(r["a"], r["e"], r["m"]) and r["g"] == math.gcd(r["a"], r["e"]) for r in got)
    assert spark.sql(f"SELECT {numbers.mod_pow('3L', '4194304L', '97L')} AS p").first()["p"] == 61


def test_terms(spark):
    """Terms against steps one by one, of any order, with moduli of one to 63 bits; rows that have none are null."""
    rng = random.Random(5)
    for k in (1, 3, 4):
        rows = [tuple(rng.randint(-9, 9) for _ in range(2 * k)) + (rng.choice([0, 1, 2, 40, 70_000]), rng.choice([1, 2, 97, 1 << 30, 1_000_000_007, 2**31, 2**62, 2**63 - 25])) for _ in range(60)]
        rows += [(1,) * 2 * k + (-1, 7), (1,) * 2 * k + (5, 0), (None,) * 2 * k + (5, 7)]
        c, u = [f"c{i}" for i in range(k)], [f"u{i}" for i in range(k)]
        frame = spark.createDataFrame(rows, ", ".join(f"{x} long" for x in [*c, *u, "n", "m"]))
        for r in numbers.with_terms(frame, c, u, "n", "m", "v").collect():
            if r.n < 0 or not r.m or r.c0 is None:
                assert r.v is None
                continue
            held = [r[x] % r.m for x in u]
            for _ in range(r.n):
                held = [*held[1:], sum(r[x] * held[-1 - i] for i, x in enumerate(c)) % r.m]
            assert r.v == held[0]


def test_recurrences(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-5, 9), rng.randrange(-5, 9), rng.randrange(9), rng.randrange(9), rng.randrange(300), rng.choice([1, 97, 2**63 - 25])) for _ in range(60)]
    got = spark.createDataFrame(rows, "c0 long, c1 long, u0 long, u1 long, n long, m long").select("*", F.expr(numbers.recurrence(["c0", "c1"], ["u0", "u1"], "n", "m")).alias("v")).collect()
    for r in got:
        u = [r["u0"], r["u1"]]
        while len(u) <= r["n"]:
            u.append(r["c0"] * u[-1] + r["c1"] * u[-2])
        assert r["v"] == u[r["n"]] % r["m"]


def test_small_graphs_stay_in_tasks(spark, monkeypatch):
    """Graphs of few edges give the facts that vertex by vertex gives, without a table of all their edges; batches may end within one."""
    rng = random.Random(11)
    edges = [(g, rng.randrange(rng.choice([2, 5, 9])), rng.randrange(9)) for g in range(300) for _ in range(rng.randint(1, 12))]
    frame = spark.createDataFrame(edges, "graph long, u long, v long")
    want = numbers.spread_facts(frame.select("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), frame.filter("false").select("graph", "u"))
    want = {tuple(r) for r in want.collect()}
    spread = []
    monkeypatch.setattr(numbers, "labels", lambda edges: spread.append(edges) or pytest.fail("graphs of a few edges were spread"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r)[:8] for r in numbers.graph_facts(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and not spread
    monkeypatch.undo()
    monkeypatch.setattr(numbers, "SMALL", 6)
    assert {tuple(r)[:8] for r in numbers.graph_facts(frame).collect()} == want


def test_graphs(spark):
    path = [("path", k, k + 1) for k in range(300)]
    ring = [("even ring", k, (k + 1) % 50) for k in range(50)] + [("odd ring", k, (k + 1) % 51) for k in range(51)]
    some = [("two parts", 1, 2), ("two parts", 3, 4), ("loop", 1, 1), ("loop", 1, 2), ("twice", 1, 2), ("twice", 2, 1), ("star", 0, 1), ("star", 0, 2), ("star", 0, 3)]
    alone = spark.createDataFrame([("alone", 7), ("twice", 1), ("star", 9)], "graph string, u long")
    got = {r["graph"]: r.asDict() for r in numbers.graph_facts(spark.createDataFrame(path + ring + some, "graph string, u long, v long"), alone).collect()}
    facts = lambda g: tuple(got[g][c] for c in ("vertices", "edges", "max_degree", "odd", "connected", "bipartite", "eulerian", "eulerian_path", "tree"))
    assert facts("path") == (301, 300, 2, 2, True, True, False, True, True)
    assert facts("even ring") == (50, 50, 2, 0, True, True, True, True, False)
    assert facts("odd ring") == (51, 51, 2, 0, True, False, True, True, False)
    assert facts("two parts") == (4, 2, 1, 4, False, True, False, False, False)
    assert facts("loop") == (2, 2, 3, 2, True, False, False, True, False)
    assert facts("twice") == (2, 1, 1, 2, True, True, False, True, True)
    assert facts("star") == (5, 3, 3, 4, False, True, False, False, False)
    assert facts("alone") == (1, 0, 0, 0, True, True, True, True, True)
