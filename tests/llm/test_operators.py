"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from html import unescape

import duckdb
import numpy as np
import pytest

from lexmill.llm import components, counts, decontaminate, exact, html, induced, jaccard, pitmanyor, quality, queries, seating, sentencepieces, spelling, substring, suffix
from lexmill.llm.induced import Sorter
from lexmill.llm.text import mix

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score double, key long, block string, n long, lang string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    syllables = "ka lo mi su ter an vo ri é ß 🙂x".split()
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
    passage, near = prose(120), prose(300)
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "One  TWO\n"), (6, "a" * 3000), (7, "ab " * 700), (None, prose(90)), (9, prose(5000))]
    out += [(10 + k, prose(rng.randint(0, 80)) + " " + passage + "\n" + prose(rng.randint(0, 80))) for k in range(5)]
    for k in range(8):
        w = near.split(" ")
        w[20 * k + 3] = "changed"
        out.append((30 + k, " ".join(w)))
    out += [(50, near), (51, near), (52, near + " "), (60, near[:700]), (61, "🙂▁ " * 200)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1.5, 3, "x", 7, "en") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {(r["doc_id"],): r for r in df.collect()}


def test_exact(docs, texts, empty):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in texts:
        groups.setdefault(bare(t), []).append((len(t or ""), i))
    got = exact.exact_dedup(docs).collect()
    assert len(got) == len(texts)
    want = []
    for i, t in texts:
        g = groups[bare(t)]
        keep = min(g, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[1]
        want.append((i, keep, len(g), i == keep, hashlib.sha256(bare(t).encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert exact.exact_dedup(empty).count() == 0


def test_exact_with_colliding_fingerprints(spark):
    rows = [(1, 1, "s1", [(7, b"a")]), (2, 1, "s2", [(7, b"b")]), (3, 1, "s1", [(7, b"a")]), (4, 0, "s3", [])]
    ids = exact.with_identifiers(spark.createDataFrame(rows, "doc_id long, n_chars int, text_sha256 string, chunks array<struct<fp:bigint,sha:binary>>"))
    found = {r.doc_id: r.ids for r in ids.collect()}
    assert found[1] == found[3] != found[2] and found[4] == []


def test_exact_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(exact.OP8_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = exact.op8_exact_dedup(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns].astype(str) == want.astype(str)).all(None)


def jaccard_brute(texts):
    sets = {}
    for i, t in texts:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(i for i in sets if i is not None), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard(docs, texts, empty):
    want = jaccard_brute(texts)
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(texts)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_bridges_and_strangers(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows, i = [], 0
    for step in range(12):  # a chain: each is near the next, the ends are far apart
        base = base[:]
        base[step * 15 : step * 15 + 9] = [f"n{step}_{k}" for k in range(9)]
        rows.append((i := i + 1, " ".join(base)))
    shared = [f"p{k}" for k in range(120)]  # strangers that share a passage
    for k in range(30):
        rows.append((i := i + 1, " ".join([f"s{k}_{j}" for j in range(rng.randrange(20, 150))] + shared)))
    want = jaccard_brute(rows)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    up = {n: n for e in edges for n in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in up}


def test_substring(docs, texts, empty):
    first, want = {}, {}
    for i, t in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = substring.substring_dedup(docs).collect()
    assert len(got) == len(texts)
    assert [r for r in got if (r.n_words, r.n_removed, r.kept_sha256) != want[r.doc_id]] == []
    assert substring.substring_dedup(empty).count() == 0


def test_substring_of_repeated_ids(spark):
    """Two rows of one doc_id with different texts are cleaned each for itself, and don't clean each other."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage, other, own = [" ".join(word() for _ in range(n)) for n in (80, 70, 60)]
    rows = [(1, passage), (5, f"{own} {passage}"), (5, f"{other} {own}"), (7, other), (7, other), (5, passage)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 80, 0), (5, 80, 80), (5, 130, 0), (5, 140, 80), (7, 70, 70), (7, 70, 70)]


def test_decontamination_of_repetitive_texts(spark):
    """A ruled line against an item with one: memory and time stay bounded, and occurrences are still told."""
    item = "the first part " + "=" * 60 + " and the last part of it"
    rows = [(1, "=" * 300_000), (2, "=" * 5000 + " " + item + " " + "=" * 5000), (3, ("x " * 3000) + item.replace("last", "lost"))]
    begin = time.perf_counter()
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(4, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got.collect()) == [(2, 4, 0), (3, 4, 1)] and time.perf_counter() - begin < 60


def test_exact_with_large_groups(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT", 2)
    rows = [(k, "a b" if k % 2 else f"text {k}") for k in range(20)] + [(50, None), (51, " ")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (1, 10) if k % 2 else (k, 1) for k in range(20)} | {50: (51, 2), 51: (51, 2)}


def test_cover_meets_all_pairs():
    cover = set(substring.COVER)
    for a, b in itertools.product(range(substring.PERIOD), repeat=2):
        assert any((a + d) % substring.PERIOD in cover and (b + d) % substring.PERIOD in cover for d in range(substring.PERIOD))


def test_suffix(docs, texts, empty):
    seen, want = Counter(), []
    raw = [(i, (t or "").encode()) for i, t in texts]
    for _, b in raw:
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        want.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    for most in (suffix.MOST, 1):  # the latter counts the strings of each key that has two pieces
        got = [tuple(r) for r in suffix.suffix_dedup(docs, most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert suffix.suffix_dedup(empty).count() == 0


def test_suffix_with_a_key_in_several_files(spark):
    """A key's pieces are sorted in one task, also where the join with its keys becomes a broadcast of which each file is read alone."""
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [prose(450) for _ in range(20)]
    texts = [prose(200) + passages[k % 20] + prose(200) for k in range(60)]
    seen = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    want = {}
    for i, t in enumerate(texts):
        want[i] = len({p for k in range(len(t) - 399) if seen[t[k : k + 400]] > 1 for p in range(k, k + 400)})
    # several files, and joins that are planned as sorts and become broadcasts when sizes are known
    conf = {"coalescePartitions.enabled": "false", "autoBroadcastJoinThreshold": "10m"}
    conf = {f"spark.sql.adaptive.{k}": v for k, v in conf.items()} | {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = suffix.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert {r.doc_id: r.n_removed for r in got} == want


def test_pieces_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(5)
    passage, fill = rng.integers(97, 101, 700), lambda: rng.integers(97, 123, 900)
    text = np.concatenate([fill(), passage, fill(), passage, fill(), np.full(900, 97), fill(), passage[:450]]).astype(np.uint8)
    monkeypatch.setattr(suffix, "SLICE_BYTES", 333)
    found = suffix.pieces(text)
    key = {s: k for k, lo, hi, _ in found for s in range(lo, hi)}
    assert sorted(key) == list(range(len(text) - 399)) and sum(f[2] - f[1] for f in found) == len(key)
    same = {}
    for s in key:
        assert same.setdefault(text[s : s + 400].tobytes(), key[s]) == key[s]
    assert suffix.pieces(text[:399]).shape == (0, 4)


@pytest.mark.parametrize("limits", [{}, {"SHORT": 2}, {"SHORT": 2, "WINDOW": 3, "RUN": 5, "BUFFER": 7, "IN_MEMORY": 16}])
def test_induced_sorting(limits, monkeypatch):
    """In memory, with recursion to the end, and with arrays, queues and orders of a few bytes in files."""
    for name, value in limits.items():
        monkeypatch.setattr(induced, name, value)
    rng = np.random.default_rng(len(limits))
    for _ in range(150 if len(limits) < 2 else 60):
        parts = [bytes(rng.integers(1, 1 + rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        parts += [parts[0] * 2]
        text, cap = np.frombuffer(b"\0".join([*parts, b""]), np.uint8), int(rng.integers(1, 12))
        raw, got = text.tobytes(), Sorter(text, cap).repeated()
        count = Counter(raw[k : k + cap] for k in range(len(raw) - cap + 1))
        for k in range(len(raw) - cap + 1):
            if b"\0" not in raw[k : k + cap]:
                assert got[k] == (count[raw[k : k + cap]] > 1)


def test_decontamination(spark, docs, empty):
    rng = random.Random(2)
    items = [(k, " ".join("".join(rng.choices(["ka", "lo", "mi", "su", "ter"], k=rng.randint(1, 4))) for _ in range(25))) for k in range(12)] + [(90, None), (91, ""), (92, "Tiny!")]
    rows = []
    for k, t in items[:12]:
        chars = list(t)
        for _ in range(k % 6):  # up to five edits
            p = rng.randrange(len(chars))
            chars[p] = rng.choice(["", "z", chars[p] + "y"])
        rows.append((k, "Zq wv " * 30 + "".join(chars).upper().replace(" ", "\n\t") + " end " * 20))
    rows += [(100, "nothing of it here " * 40), (101, None), (102, ""), (103, "so tiny! it"), (0, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    found = Counter((r.doc_id, r.item_id) for r in got.collect())
    assert found == Counter([(k, k) for k in range(12)] + [(0, 0), (103, 92)])
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_banded_alignment():
    def distance(a, t):
        row = [(0, j) for j in range(len(t) + 1)]
        for i in range(1, len(a) + 1):
            new = [(i, 0)]
            for j in range(1, len(t) + 1):
                new.append(min((row[j - 1][0] + (a[i - 1] != t[j - 1]), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
            row = new
        return min(c for c, _ in row)

    rng = random.Random(4)
    for _ in range(60):
        a = bytes(rng.choices(b"abc", k=rng.randint(5, 20)))
        t = list(a)
        for _ in range(rng.randint(0, 3)):
            t.insert(rng.randrange(len(t) + 1), rng.choice(b"abc"))
        t = bytes(rng.choices(b"xyz", k=6)) + bytes(t)
        got, best = decontaminate.align(a, t, 4, 8, 4), distance(a, t)
        assert got is None and best > 4 or got is not None and got[0] == best


def test_tokens_and_pieces(docs, texts, empty):
    p = counts.pieces(counts.VOCABULARY)
    want = {}
    for i, t in texts:
        raw = ((" " + t) if t else "").encode().replace(b" ", b"\xff")
        want[i] = p.segment(raw)
    for r in counts.token_counts(docs).collect():
        assert r.n_tokens == len(want[r.doc_id][1]) and math.isclose(r.score, want[r.doc_id][0])
    for giant, chunk in ((64 << 10, 8 << 10), (200, 64), (500, 300)):
        got = sentencepieces.encode(docs, giant=giant, chunk=chunk)
        rows = got.collect()
        assert len(rows) == len(texts) and all(list(r.ids) == want[r.doc_id][1] for r in rows)
    decoded = sorted((str(r.doc_id), r.text) for r in sentencepieces.decode(got).collect())
    assert decoded == sorted((str(i), t or "") for i, t in texts)
    assert counts.token_counts(empty).count() == 0 and sentencepieces.encode(empty).count() == 0


def test_long_units_and_scan_levels(spark, monkeypatch):
    rng = random.Random(8)
    p = counts.pieces(counts.VOCABULARY)
    unspaced = "".join(rng.choice("的一是不了人我在有他这中大来上国") for _ in range(700))
    joined = "".join(rng.choices(["tion", "the", "ing", "a", "aa", "é"], k=900))
    texts = [unspaced, joined, "a" * 2500, "=" * 1000 + unspaced[:90], " " * 300 + "x" * 300, "ab" * 800, f"{joined} {unspaced} {joined}"]
    rows = [(k, t, [1], "u", True) for k, t in enumerate(texts)] + [(9, None, [2], "v", None), (0, texts[0], [3], "w", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, uid string, _giant boolean")
    want = {k: p.segment(b"\xff" + t.encode().replace(b" ", b"\xff")) for k, t in enumerate(texts)} | {9: (0.0, [])}
    monkeypatch.setattr(sentencepieces, "FAN", 3)  # several levels of products
    for giant, chunk in ((1 << 20, 64), (100, 40), (100, 170)):
        got = sentencepieces.encode(docs, ("doc_id", "ids", "uid", "_giant"), giant=giant, chunk=chunk, check=True)
        assert got.columns == ["doc_id", "uid", "_giant", "ids", "round_trip"]
        rows = got.collect()
        assert len(rows) == 9 and all(list(r.ids) == want[r.doc_id][1] and r.round_trip for r in rows)
    assert {(r.doc_id, r.n_tokens, r.n_pretokens) for r in counts.token_counts(docs).collect()} == {
        (k, len(v[1]), len(re.findall(r" +[^ ]*|[^ ]+", " " + texts[k])) if k < 9 else 0) for k, v in want.items()
    }


def test_html(spark):
    page = """<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><div id="cookie-notice">We use cookies.</div><header><h2>Site</h2></header>
    <main><article><h1>Head &amp; more</h1><p><b>One two three
    four five.<br><p>Next   paragraph is here.</p><aside>Related stuff here</aside><ul><li>Point one of many.<li>Point two of many.</ul><form>Name <input></form>
    <section class="comments"><p>Great article, I liked it very much indeed.</p></section></article></main><div class="sidebar"><p>Popular posts and a long text of many words here.</p></div></body>"""
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, "v", None, "x"), (3, "w", "", "x"), (1, "u", page, "x"), (4, "z", "<p", "x")], "page_id long, url string, html string, text string")
    got = html.main_text(rows).collect()
    text = "Head & more\n\nOne two three four five.\n\nNext paragraph is here.\n\nPoint one of many.\n\nPoint two of many."
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, text, len(text)), (2, "", 0), (3, "", 0), (1, text, len(text)), (4, "", 0)]


def test_html_names_of_running_text_and_deep_pages():
    page = """<div class="article-header"><p>The lead of the article is a sentence.</p></div><article><p class="share-price">The share price fell by a tenth.</p>
    <p class="ad">Buy it now and here.</p><div class="share-links">Share this with all your friends.</div><p>It rose again after a while.</p></article>"""
    assert html.extract("<article>" + page + "</article>") == "The lead of the article is a sentence.\n\nThe share price fell by a tenth.\n\nIt rose again after a while."
    begin = time.perf_counter()
    deep = "<div>" * 30000 + "<b>" * 30000 + "<article><p>One sentence of six words.</p></article>" + "</i>" * 30000 + "<p>x</p>" * 30000
    assert "One sentence of six words." in [t for _, t in html.blocks(deep)] and time.perf_counter() - begin < 5


def test_html_of_all_articles(spark):
    """The made pages have one article of headings and paragraphs each: all of these and nothing else."""
    rows = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r.text for r in html.main_text(rows).collect()}
    for r in rows.collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1]).replace("<br>", " ")
        parts = (" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n\n".join(x for x in parts if x)


def test_html_weights_are_learnt(spark):
    rng = random.Random(6)
    page = lambda: "<nav>" + "".join(f"<li><a>{rng.choice('abc')}</a></li>" for _ in range(9)) + "</nav><article>" + "<p>One two three four five six seven eight.</p>" * rng.randint(2, 9) + "</article>"
    schema = "page_id long, url string, html string"
    learnt = html.learnt(spark.createDataFrame([(k, "u", page()) for k in range(200)], schema))
    plain = html.Block("p", 1, False, False, False)
    links = html.Block("p", 1, False, False, False)
    links.linked = 99
    assert html.log_odds(plain, "A sentence of some words without any mark.", learnt) > 0 > html.log_odds(links, "News", learnt)
    assert (html.learnt(spark.createDataFrame([], schema)) == html.PRIOR).all()


def test_html_with_tags_in_scripts():
    want = [text for _, text in html.blocks("<article><p>One two three.</p></article><p>Four.</p>")]
    for body in ("for(i=0;i<n;i++){a()}", "if(a<b)x='it", 'y="<!--";', "s='<p>'+\"</p>\"", ""):
        for tag, end in (("script", "</SCRIPT >"), ("style", "</style>"), ("Script", "</script/>")):
            page = f"<{tag} type=x>{body}{end}<article><p>One two three.</p></article><{tag}>{body}{end}<p>Four.</p>"
            assert [text for _, text in html.blocks(page)] == want
    assert html.blocks("<script>i<n</scripts>no end") == []


def test_minimum_cut():
    def cost(odds, edges, on):
        return sum(max(0, o) if not k else max(0, -o) for o, k in zip(odds, on)) + sum(w for (a, b), w in edges.items() if on[a] != on[b])

    for seed in range(80):
        rng = random.Random(seed)
        n = rng.randint(1, 8)
        odds = [rng.uniform(-3, 3) for _ in range(n)]
        edges = {(a, b): rng.random() * 1.5 for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        best = min(cost(odds, edges, on) for on in itertools.product((0, 1), repeat=n))
        assert abs(cost(odds, edges, html.minimum_cut(odds, edges)) - best) < 1e-6


def test_language_model(docs, texts, empty):
    got = pitmanyor.lm_scores(docs).collect()
    assert len(got) == len(texts)
    split = {i: words(lower(t)) + ["\n"] for i, t in texts}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    seen = Counter(w for i, t in texts if not held(i) for w in split[i])
    total, kinds = sum(seen.values()), len(seen)
    for r in got:
        w = split[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(seen[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((seen[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert pitmanyor.lm_scores(empty).count() == 0


def test_language_model_in_many_blocks(docs, monkeypatch):
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 3))
    whole = sorted(map(key, pitmanyor.lm_scores(docs).collect()))
    monkeypatch.setattr(pitmanyor, "SLICE_BYTES", 2000)
    assert sorted(map(key, pitmanyor.lm_scores(docs).collect())) == whole


def test_language_model_sees_the_order_of_words(spark):
    train = [(k, "red house green tree " * 5) for k in range(40)]
    docs = spark.createDataFrame([*train, (1000, "red house green tree red"), (1001, "tree red red green house")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitmanyor.lm_scores(docs).collect()}
    assert got[1000] > got[1001] + 2


def test_language_model_tasks_in_bounded_memory():
    """A slice's words are hashed and its pairs dealt a few at a time, with the same results."""
    rng = np.random.default_rng(4)
    names = " ".join(f"w{i:x}" * (1 + i % 5) for i in range(60_000)).encode() + b" \xff"
    flat = np.frombuffer(names, np.uint8)
    whole = pitmanyor.hashes(flat, len(flat))
    assert len(whole) == 60_001 and all(np.array_equal(whole, pitmanyor.hashes(flat, k)) for k in (7, 1 << 12))
    tokens = np.append(rng.integers(0, 60_000, 999_999), 60_000).astype(np.uint32)
    own = pitmanyor.Slice(pitmanyor.pack(flat), pitmanyor.pack(tokens, np.array([1_000_000], np.uint32), np.array([True])))
    tracemalloc.start()
    pitmanyor.hashes(flat)
    names_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    pairs = pitmanyor.Pairs(own, 9, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    pairs_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names_peak < 20e6 and pairs_peak < 42e6
    u, w = own.h[np.roll(own.at, 1)], own.h[own.at]
    assert np.array_equal(own.h[pairs.u][pairs.which], u) and np.array_equal(own.h[pairs.w][pairs.which], w)
    assert all((mix(own.h[us]) % np.uint64(9) == part).all() for part, _, us, _ in pairs.dealt())


def test_language_model_splits_hot_contexts(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join("the " + rng.choice("abcdefgh") * rng.randint(1, 40) for _ in range(60))) for k in range(60)], "doc_id long, text string")
    whole = {r.doc_id: r.score for r in pitmanyor.lm_scores(docs).collect()}
    monkeypatch.setattr(pitmanyor, "HOT", 300)
    monkeypatch.setattr(pitmanyor, "PART_TOKENS", 500)
    monkeypatch.setattr(pitmanyor, "SLICE_BYTES", 3000)
    got = {r.doc_id: r.score for r in pitmanyor.lm_scores(docs).collect()}
    off = max(abs(got[k] / whole[k] - 1) for k in got)
    assert got.keys() == whole.keys() and off < 0.01, off


def test_language_model_of_long_words_and_texts(spark):
    rows = spark.createDataFrame([(1, 3, 3, -2.0), (2, 0, 0, -5000.0)], "key long, n long, c long, lp double")
    got = {r.key: r.p for r in pitmanyor.unigrams(rows).collect()}
    fresh = (pitmanyor.STRENGTH + pitmanyor.DISCOUNT * 1) / (pitmanyor.STRENGTH + 3)
    assert math.isclose(got[2], -5000 + math.log10(fresh), rel_tol=1e-3) and math.isfinite(got[1])
    ids = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 5 == 1][:6]
    long = "".join(random.Random(1).choices("qxzjkv", k=3000))
    held = [long, f"{long} {long}", "zq", "zq zq", "zq " * 700, "zq " * 1400]
    train = [(2000 + k, "red house green tree") for k in range(20)]
    docs = spark.createDataFrame([*zip(ids, held), *train], "doc_id long, text string")
    score = {r.doc_id: r.score for r in pitmanyor.lm_scores(docs).collect()}
    one, two, few, more, many, most = (score[k] for k in ids)
    # no context of these words has been seen, so each further one adds the same
    assert math.isfinite(one) and two - one < -3000 and one < -3000
    assert math.isclose(many - few, 699 * (more - few), rel_tol=1e-6) and math.isclose(most - few, 1399 * (more - few), rel_tol=1e-6)


def test_table_counts_are_drawn_from_their_full_conditional():
    d, n = seating.DISCOUNT, 4000

    def exact(c, a, p):
        log_s = {(0, 0): 0.0}
        row = [0.0]
        for k in range(c):  # plain recurrence of the generalised Stirling numbers, in logarithms
            new = [-math.inf] * (k + 2)
            for t in range(1, k + 2):
                parts = [row[t - 1]] + ([row[t] + math.log(k - t * d)] if t <= k and k - t * d > 0 else [])
                top = max(parts)
                new[t] = top + math.log(sum(math.exp(x - top) for x in parts)) if top > -math.inf else top
            row = new
        w = [row[t] + sum(math.log(a + d * j) for j in range(t)) + t * math.log(p) for t in range(1, c + 1)]
        w = [math.exp(x - max(w)) for x in w]
        return [x / sum(w) for x in w]

    for c, a, p in ((2, 1.0, 0.3), (5, 7.0, 0.2), (40, 300.0, 0.02), (200, 50.0, 0.01), (200, 4000.0, 0.01), (200, 3000.0, 0.2), (300, 2.0, 1e-9)):
        want = exact(c, a, p)
        mean = sum((t + 1) * x for t, x in enumerate(want))
        spread = sum((t + 1 - mean) ** 2 * x for t, x in enumerate(want)) ** 0.5
        got = seating.draw(np.full(n, c), np.full(n, a), np.full(n, math.log(p)), np.arange(n, dtype=np.uint64), 3)
        assert got.min() >= 1 and got.max() <= c
        assert abs(got.mean() - mean) < 5 * spread / n**0.5 + (0.03 * mean if c > seating.EXACT else 1e-9), (c, a, p, got.mean(), mean)
        assert abs(got.std() - spread) < 0.1 * spread + 1e-3, (c, a, p, got.std(), spread)


def test_probabilities_of_all_texts_sum_to_one(spark):
    """All texts of up to six words of a small vocabulary hold nearly all probability; the rest is for others."""
    rng, vocabulary = random.Random(4), ["red", "house", "green"]
    train = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 3)))) for k in range(3000) if zlib.crc32(str(k).encode()) % 5 != 1]
    probes = [" ".join(x) for n in range(7) for x in itertools.product(vocabulary, repeat=n)]
    held = [k for k in range(3000, 20000) if zlib.crc32(str(k).encode()) % 5 == 1][: len(probes)]
    docs = spark.createDataFrame([*train, *zip(held, probes)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in pitmanyor.lm_scores(docs).collect()}
    total = sum(10 ** score[k] for k in held)
    assert 0.97 < total < 1, total


def test_scores_do_not_follow_the_partitioning(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(80)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    one, two = ({r.doc_id: r.score for r in pitmanyor.lm_scores(docs.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-6) for k in one)


def test_spelling_probabilities_sum_to_one():
    codes = np.unique([(ord(a) << 8 | c) for a in "ab" for c in range(256)])
    n = np.where(codes & 255 == ord("c"), 5, 0)
    p, _, _ = spelling.sweep_group(codes, n, np.full((256, 256), 1 / 256))
    for a in "ab":
        assert abs(p[codes >> 8 == ord(a)].sum() - 1) < 1e-9


def test_words_by_join_equal_words_by_broadcast(spark):
    own = spark.createDataFrame([("abc", 3), ("abd", 0), ("\n", 2), ("é", 1)], "word string, n long")
    scores = pitmanyor.gram_scores(own)
    a = {r.word: r.lp for r in pitmanyor.score_words(own, scores).collect()}
    b = {r.word: r.lp for r in pitmanyor.score_words(own, scores, limit=0).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)


def test_spelling_depends_on_five_bytes(spark):
    own = spark.createDataFrame([("1abcdX", 1), ("2abcdY", 1), ("1abcdY", 0), ("2abcdX", 0)], "word string, n long")
    lp = {r.word: r.lp for r in pitmanyor.score_words(own, pitmanyor.gram_scores(own)).collect()}
    assert lp["1abcdX"] > lp["1abcdY"] + 0.1 and lp["2abcdY"] > lp["2abcdX"] + 0.1


def test_quality_held_out(spark):
    got = quality.op1_quality_classifier(spark, "/root/testdata/sf0.01")
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in got.collect() if r.held_out and r.doc_id in labels]
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.95
    good, bad = ([r.score for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_edges(spark, docs, texts, empty):
    labels = spark.createDataFrame([(9, 1, 0), (10, 0, 0), (10, 1, 0), (30, None, 0), (31, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(texts)
    assert all(r.score == 0.5 and r.predicted == 1 for r in got if r.doc_id in (1, 2, 3))
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0


def test_leader_updates_equal_the_plain_rule():
    rng = random.Random(3)
    rows = [([rng.randrange(40) for _ in range(rng.randint(0, 12))], rng.randint(0, 1)) for _ in range(300)]
    model, z, n = quality.Ftrl(), defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for slots, label in rows:
        model.learn(np.array(slots, np.int64), label)
        x = {i: math.sqrt(c / len(slots)) for i, c in Counter(slots).items()}
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        for i, v in x.items():
            g, w = (p - label) * v, weight(i)
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w
            n[i] += g * g
    assert all(math.isclose(model.z[i], z[i], abs_tol=1e-9) and math.isclose(model.n[i], n[i], abs_tol=1e-9) for i in range(40))


def test_quality_by_plain_features_and_any_partitioning(spark):
    """Scores are the dot products of weights with n-gram shares counted in plain Python; they don't follow the partitioning."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    one, two = ({r.doc_id: r.score for r in quality.quality_scores(docs.repartition(n), labels).collect()} for n in (1, 5))
    assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], abs_tol=1e-9) for k in one)
    weights = np.random.default_rng(1).normal(size=2**quality.BITS).astype(np.float32)
    got = {r.doc_id: r.own for r in quality.score(docs, weights, ["doc_id", "lang"], "own").collect()}
    for r in docs.limit(20).collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        slots = Counter(quality.features(raw, np.array([0, len(raw)]))[0].tolist())
        total = sum(float(weights[i]) * math.sqrt(c / sum(slots.values())) for i, c in slots.items())
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-max(-30, min(30, total)))), rel_tol=1e-4)


def test_updates_reach_the_driver_in_blocks(spark):
    """A round's updates are the plain sum of the shares', in a few packed rows and not one for each slot."""
    rng = random.Random(11)
    rows = [(" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)), rng.randint(0, 1)) for _ in range(300)]
    shares = [rows[0::3], rows[1::3], rows[2::3]]
    state = np.abs(np.random.default_rng(2).normal(size=(2, 2**quality.BITS)))
    plain = np.zeros_like(state)
    for share in shares:
        model = quality.Ftrl(state)
        for text, label in share:
            model.learn(quality.features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0], label)
        plain += np.stack([model.z, model.n]) - state
    frame = spark.createDataFrame(spark.sparkContext.parallelize(shares, 3).flatMap(lambda x: x), "text string, label int")
    got = quality.updates(frame, spark.sparkContext.broadcast(state)).collect()
    assert len(got) == 2**quality.BITS // quality.BLOCK and np.count_nonzero(plain[1]) > 50_000
    summed = np.zeros_like(state)
    for r in got:
        summed[:, r.block * quality.BLOCK : (r.block + 1) * quality.BLOCK] = np.frombuffer(r.sums).reshape(2, -1)
    assert np.allclose(summed, plain, atol=1e-12)


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
