"""Operators that SQL doesn't express, against plain Python."""

import re

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import matching, planning, units, verify

WS = " \t\n\x0b\f\r"


def chunks(text, target=1000, least=200, most=1800):
    out, buffer = [], []

    def flush():
        nonlocal buffer
        if buffer:
            joined = "\n\n".join(buffer)
            if len(joined) < least and out:
                out[-1] += "\n\n" + joined
            else:
                out.append(joined)
        buffer = []

    for p in re.split(r"\n[ \t]*\n|\n", text):
        p = p.strip(WS)
        if not p:
            continue
        head = len(p) <= 140 and re.match(r"(?:#{1,4} |[0-9]+(?:\.[0-9]+)*\.? [A-ZÀ-Ý])", p)
        if head and buffer or sum(map(len, buffer)) + len(p) > most:
            flush()
        buffer.append(p)
        if sum(map(len, buffer)) >= target:
            flush()
    flush()
    return out


def test_chunks(spark):
    text = ["# A\n" + "x" * 900 + "\n" + "y" * 950 + "\n# B\nshort", "", "one\n\ntwo", "z" * 2000 + "\ntail", "1. Head\n" + "\n".join(["w" * 300] * 9)]
    got = units.chunks_of(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).orderBy("doc_id", "chunk_no").collect()
    for i, t in enumerate(text):
        assert [r.context for r in got if r.doc_id == i] == chunks(t)


def test_joined_lines(spark):
    df = spark.createDataFrame([("a b\nc.\nd\n\n" + "e" * 130 + "\nf",)], "t string")
    assert df.select(units.joined_lines(F.col("t")).alias("x")).first().x == ["a b c.", "d " + "e" * 130, "f"]


def test_run_length(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "x", "b", "a", "b", "y"])], "m array<string>, o array<string>")
    assert df.select(T.run_length(F.col("m"), F.col("o")).alias("x")).first().x == 3


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.x for r in df.select(T.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] == 0.0


def test_greedy_keeps_what_one_shot_would_drop(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    assert sorted(r.id for r in matching.greedy_keep(ids, links, "id").collect()) == [1, 3, 5]


def test_apportioned(spark):
    totals = spark.createDataFrame([("a", 7), ("b", 0), ("c", 101)], "k string, total long")
    got = planning.apportioned(totals, "k").groupBy("k").agg(F.sum("count").alias("n")).collect()
    assert {r.k: r.n for r in got} == {"a": 7, "b": 0, "c": 101}


def test_attempts_go_on_beyond_99(spark):
    rows = spark.createDataFrame([(7, k, "error" if k % 2 else "view") for k in range(300)], "user_id long, event_id long, event_type string")
    got = {r.event_id: r.slot for r in planning.attempts(rows).collect()}
    assert got == {k: f"7_r{k // 2 + 1:02d}" for k in range(1, 300, 2)}


def test_copied_runs_of_all_units(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from .conftest import SMALL

    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]
    split = lambda rows: {r.k: list(r.t) for r in spark.createDataFrame(rows, "k long, x string").select("k", T.tokens(F.col("x")).alias("t")).collect()}
    items = [set(t) for t in split([(k, x) for k, (_, x) in enumerate(read("benchmark", "item_id"))]).values()]
    want = {}
    for doc, tokens in split(read("documents", "doc_id")).items():
        for members in items:
            run = 0
            for token in tokens:
                run = run + 1 if token in members else 0
                want[doc] = max(want.get(doc, 0), run)
    got = {r.doc_id: r.longest_run for r in matching.copied_runs(spark, SMALL).collect()}
    assert got == want and len(got) > 100
    docs, bench = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark"))
    assert {r.doc_id: r.longest_run for r in matching.longest_runs(docs, bench, limit=0).collect()} == want
    monkeypatch.setattr(matching, "HITS", 7)
    batch = pa.record_batch({"doc_id": [1, 2, 3], "order": [list("abxab"), list("bbb"), ["z"]]})
    pieces = matching._runs([batch, batch], ["a", "b"], np.array([0, 2, 5]), np.array([0, 1, 0, 1, 2]))
    assert [p.to_pydict() for p in pieces] == [{"doc_id": [1, 2, 3], "longest_run": [2, 3, 0]}] * 2


def test_evaluators():
    assert verify.evaluate("2 + 3 * 4^2") == 50
    assert verify.evaluate("binomial(10, 3)") == 120
    assert verify.evaluate("__import__('os').system('x')") is None
    assert verify.evaluate("9**9**9") is None and verify.evaluate("1/0") is None
    assert verify.equivalent("p and q", "not (not p or not q)") is True
    assert verify.equivalent("implies(p, q)", "not p or q") is True
    assert verify.equivalent("p or q", "p and q") is False
    assert verify.same_function("sin(x)^2 + cos(x)^2", "1") is True
    assert verify.derivative_is("x^3 + sin(x)", "3*x^2 + cos(x)") is True
    assert verify.derivative_is("x^3", "2*x^2") is False
    assert verify.integral_is("x^2", 0, 3, 9) is True


def test_matrices():
    from fractions import Fraction as Q

    m = [[Q(2), Q(0), Q(1)], [Q(1), Q(3), Q(2)], [Q(1), Q(1), Q(1)]]
    assert verify.determinant(m) == 0 and verify.rank(m) == 2
    assert verify.determinant([[Q(1), Q(2)], [Q(3), Q(4)]]) == -2


def test_verdicts(spark):
    rows = [(1, "logic_negation", "p and q", "not p or not q", 0.0, 0.0), (2, "nothing", "1", "1", 0.0, 0.0), (3, "probability", "1/6", "0.1666667", 0.0, 0.0), (4, "integral", "2*x", "4", 0.0, 2.0)]
    got = verify.verdicts(spark.createDataFrame(rows, "claim_id long, type string, a string, b string, low double, high double")).collect()
    assert {r.claim_id: r.verdict for r in got} == {1: True, 2: None, 3: True, 4: True}


def test_trimmed(spark):
    from lexmill.operators.rating import trimmed

    parts = ["plain words here", "the keyword stands here " * 3, "x" * 95, "keyword 1234 5678", "more keyword text"]
    df = spark.createDataFrame([(parts, ["keyword"])], "u array<string>, k array<string>")
    got = df.select(trimmed(F.col("u"), F.col("k"), 100).alias("x")).first().x
    assert got == "the keyword stands here " * 3 + "\n\n" + "keyword 1234 5678"


def test_diverse_items(spark):
    from lexmill.operators import rating

    texts = ["alpha beta gamma delta", "alpha beta gamma epsilon", "zeta eta theta iota", "epsilon gamma zeta eta"]
    rows = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    sets = [set(w for w in t.split() if len(w) >= 3) for t in texts]
    kept = []
    for i, s in enumerate(sets):
        if all(len(s & sets[k]) / len(s | sets[k]) < 0.2 for k in kept):
            kept.append(i)
    assert sorted(r.item_id for r in matching.greedy_keep(rows, rating.item_links(rows), "item_id").collect()) == kept


def test_ratios(spark):
    from difflib import SequenceMatcher

    from lexmill.operators.rating import ratios

    texts = ["the same words", "the same word", "nothing alike", "thing alike no"]
    pairs = [(a, b, texts[a], texts[b]) for a in range(4) for b in range(a + 1, 4)]
    want = {(a, b): int(SequenceMatcher(None, x, y).ratio() * 1000) for a, b, x, y in pairs if SequenceMatcher(None, x, y).ratio() >= 0.6}
    assert {(r.a, r.b): r.permille for r in ratios(spark.createDataFrame(pairs, "a long, b long, x string, y string"), 0.6).collect()} == want


def test_files(spark, tmp_path):
    from lexmill.sources import files

    (tmp_path / "set.json").write_text('{"metadata": {"n": 2}, "c1": {"topic": "t", "pages": [1], "context": "x", "clean_context": {"chunk_type": "exercise"}}, "c2": {"context": "y"}}')
    got = {r.chunk_id: (r.topic, r.context, r.chunk_type) for r in files.dataset_chunks(spark, str(tmp_path / "set.json")).collect()}
    assert got == {"c1": ("t", "x", "exercise"), "c2": (None, "y", "theory")}
    (tmp_path / "SKILL.md").write_text('---\nname: "a b"\nkind: c:d\n---\nbody: no')
    assert {r.key: r.value for r in files.front_matter(spark, str(tmp_path / "SKILL.md")).collect()} == {"name": "a b", "kind": "c:d"}
    (tmp_path / "r1.json").write_text('{"metadata": {"duration_seconds": 2.5, "cost": {"tokens": 7, "calls": 1}}, "questions": [{"a": "b"}], "rejected": []}')
    (tmp_path / "r2.json").write_text('{"metadata": ')
    got = files.results(spark, str(tmp_path / "r*.json")).collect()
    assert len(got) == 1 and got[0].metadata.cost.tokens == 7
    pages = spark.createDataFrame([("a\n---\n\n---\nb",), ("x\n## H\ny",)], "t string").select(files.markdown_pages(F.col("t")).alias("p")).collect()
    assert [[(p.page, p.text) for p in r.p] for r in pages] == [[(1, "a"), (3, "b")], [(1, "x"), (2, "## H\ny")]]
