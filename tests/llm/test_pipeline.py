"""The pipeline's stages keep what brute force keeps, whatever else the documents' table holds."""

import random
import re
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lexmill.llm import sentencepieces  # noqa: E402

SMALL = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
NAMES = "score held_out predicted ids uid key n t _giant n_tokens component_id"


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def exact_kept(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[bare(r.text)].append((-len(r.text or ""), r.doc_id))
    keep = {min(g)[1] for g in groups.values()}
    return {r.doc_id for r in rows if r.doc_id in keep}


def near_kept(rows):
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids, top = sorted(sets), {}
    find = lambda x: x if top.get(x, x) == x else find(top[x])
    where = defaultdict(list)
    for i in ids:
        for s in sets[i]:
            where[s].append(i)
    for i in ids:
        for j in {j for s in sets[i] for j in where[s] if j < i}:
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i for i in ids if find(i) == i}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    base = rows[0][1]
    rows += [(5001, None, "en", "a", 0), (5002, "", "en", None, 0), (5003, " \n", None, "a", 2), (5004, base, "en", "a", 1), (5005, base + " ", "en", "a", 1)]
    rows += [(5006, base + " more words", "en", "a", 1), (5007, "Before it. " + item.upper() + " After it.", "en", "a", 1), (5008, base, "en", "a", 1)]
    extra = [tuple(rng.choice([1.0, None]) for _ in NAMES.split()) for _ in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} double" for n in NAMES.split())
    return spark.createDataFrame([a + b for a, b in zip(rows, extra)], schema)


def test_stages_equal_brute_force(spark, docs):
    one = corpus_pipeline.quality_stage(spark, docs, SMALL).cache()
    assert one.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in one.collect()}
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) > 0.9 * len(labels) and {5001, 5002, 5003} <= kept
    every = docs.collect()
    two = corpus_pipeline.exact_stage(spark, docs, SMALL).cache()
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == exact_kept(every)
    three = corpus_pipeline.near_stage(spark, two, SMALL).cache()
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == near_kept(two.collect())
    four = corpus_pipeline.leak_stage(spark, docs, SMALL).cache()
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in every if not any(i in " ".join((r.text or "").lower().split()) for i in items)}
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == clean and 5007 not in clean
    last = corpus_pipeline.token_stage(spark, docs, SMALL)
    decoded = sentencepieces.decode(last).collect()
    assert sorted((r.doc_id, r.text) for r in decoded) == sorted((r.doc_id, r.text or "") for r in every)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, none, SMALL)
        assert none.columns == docs.columns and none.isEmpty()
    assert corpus_pipeline.token_stage(spark, none, SMALL).isEmpty()


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count() < 200
    assert len(corpus_pipeline.STAGES) == 5
