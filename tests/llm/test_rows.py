"""Rows that repeat a doc_id, with the same text or another, in the duplicate operators and the pipeline's stages."""

import random
from collections import defaultdict

import pytest

from lexmill.llm import exact, jaccard
from lexmill.llm.text import with_places

from .test_pipeline import bare, shingles

A, B = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, text string")


def near_components(rows):
    """Per row: the smallest doc_id of its component, nulls last."""
    sets, top = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    least = {g: min(rows[i][0] for i in own if rows[i][0] is not None) if any(rows[i][0] is not None for i in own) else None for g, own in groups.items()}
    return [least[find(i)] for i in range(len(rows))], len(groups)


def test_a_link_of_one_of_two_texts(spark):
    rows = [(1, A), (5, A), (5, B), (7, B + " tail")]
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()) == [(1, 1), (5, 1), (5, 5), (7, 5)]


@pytest.fixture(scope="module")
def repeated():
    rng = random.Random(8)
    texts = [" ".join(rng.choices("a b c d e f g".split(), k=rng.randint(0, 9))) for _ in range(12)]
    for base in (A, B):
        for k in range(9):
            w = base.split(" ")
            w[rng.randrange(60)] = "x"
            texts.append(" ".join(w))
    rows = [(rng.choice([None, *range(25)]), rng.choice([*texts, None, " "])) for _ in range(150)]
    return rows + [(3, A)] * 400 + [(k % 4, B) for k in range(400)]


def test_components_of_rows(spark, repeated):
    want, n = near_components(repeated)
    got = jaccard.clustered(frame(spark, repeated)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((i, len(shingles(t)), c) for (i, t), c in zip(repeated, want, strict=True)), key=str)
    assert sum(r.kept for r in got) == n


def test_doc_ids_of_other_kinds(spark, repeated):
    rows = [(None if i is None else f"{i:03}", t) for i, t in repeated]
    want, _ = near_components(rows)
    got = jaccard.jaccard_components(frame(spark, rows, "string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, c) for (i, _), c in zip(rows, want, strict=True)), key=str)
    assert {r.keep_id for r in exact.exact_dedup(frame(spark, [("b", "x y"), ("a", "xy"), (None, "xy ")], "string")).collect()} == {"b"}
    small = spark.createDataFrame([(-(2**63), "x"), (5, "x")], "doc_id long, text string")
    assert {r.keep_id for r in exact.exact_dedup(small).collect()} == {-(2**63)}


def test_stages_drop_rows(spark, repeated, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for rows, want in (([(0, A), (1, A), (1, B)], [(0, A), (1, B)]), ([(1, A), (1, A)], [(1, A)])):
        for k in (1, 2):
            assert sorted(map(tuple, corpus_pipeline.STAGES[k][1](spark, frame(spark, rows), "").collect())) == want
    frame(spark, repeated).repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    exact_rows = corpus_pipeline.exact_stage(spark, docs, "")
    assert exact_rows.columns == docs.columns
    groups = defaultdict(list)
    for i, t in repeated:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0))
    assert sorted((-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in exact_rows.collect()) == sorted(min(g) for g in groups.values())
    want, n = near_components(repeated)
    near_rows = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert len(near_rows) == n and sorted((r.doc_id for r in near_rows), key=str) == sorted((c for c in {i: c for i, c in _firsts(repeated)}.values()), key=str)


def _firsts(rows):
    """(component, smallest doc_id) with components told by their first row."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                top[find(i)] = find(j)
    want, _ = near_components(rows)
    return [(find(i), want[i]) for i in range(len(rows))]


def test_places_tell_rows_apart(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS doc_id", "'x' AS text", "1 AS _file").repartition(4).write.parquet(f"{tmp_path}/p")
    df, names = with_places(spark.read.parquet(f"{tmp_path}/p"))
    assert names == ["__file", "_place"] and df.select(*names).distinct().count() == 1000
    df, names = with_places(frame(spark, [(1, "x"), (1, "x")]))
    assert df.select(*names).distinct().count() == 2
