"""Importance resampling, secret scans and whitening against plain Python and numpy."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexmill.llm import queries, resampling, secrets, whitening

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score double, rank long, row long, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1.5, 3, 7, "en") for i, t in rows], SCHEMA)


# -- importance resampling --------------------------------------------------------------------------------------------


def features(text, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)], len(words)


def resampled(rows, target, order, buckets, share, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t, order)) for i, t in rows]
    s, t = Counter(bucket(f) for _, fs, _ in own for f in fs), Counter(bucket(f) for x in target for f in features(x, order)[0])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in s}
    out = []
    for i, fs, n in own:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    ranks = [r[:4] + [k + 1 if k < len(fit) * share[0] // share[1] else None] for k, r in enumerate(fit)]
    return sorted(map(tuple, ranks + [[*r[:4], None] for r in out if r[4] < least]), key=str)


@pytest.mark.parametrize(("order", "buckets", "share", "least"), [(1, 10_000, (10, 100), 20), (3, 50, (1, 2), 2), (2, 997, (100, 100), 0)])
def test_importance_resampling(spark, order, buckets, share, least):
    rng = random.Random(order)
    words = ["Alpha", "beta", "GAMMA", "δέλτα", "naïve", "x1", "Ünder", "漢字"]
    rows = [(i, rng.choice([" ", "--", "\n", "'"]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)]
    rows += [(None, "beta " * 30), (100, None), (101, ""), (102, "?! _-"), (103, "alpha beta " * 5000), (5, rows[5][1]), (5, rows[5][1]), (6, "other words " * 12)]
    target = ["beta beta naïve", None, "", "unseen Wörds x1"]
    got = resampling.importance_resample(frame(spark, rows), spark.createDataFrame([(1, t) for t in target], "item_id long, text string"), order, buckets, share, least)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(rows, target, order, buckets, share, least, 2024)


def test_importance_resampling_of_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b c d"), (2, None)])
    assert resampling.importance_resample(none, some).collect() == []
    got = resampling.importance_resample(some, none, share=(1, 1), least_words=1).collect()
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in got} == {(1, 4, 1), (2, 0, None)}


def test_importance_resampling_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = resampling.op13_importance_resampling(spark, SMALL)
    want = con.sql(queries.ORACLES["op13_importance_resampling"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


# -- secret scans -----------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_scans(spark):
    rng = random.Random(3)
    code = lambda n: base64.b64encode(rng.randbytes(n)).decode().rstrip("=")
    plain = "the configuration_of_connections and getUserNameFromSessionContext lives under /usr/local/lib/python/packages see 2024-01-15-12-30-45-00 or 98077 ".split(" ")
    parts = ["password=token: abcdefgh", "API_KEY = 'xyz'", 'secret:"a.b/c=+_-d" ', "apikey=" + code(20), "AKIA" + "Q7" * 8, "AKIAAKIA" + "Z" * 11, "AKIA" + "X" * 15, "deadbeef" * 3, "deadbeef" * 2 + "1234567", "é🙂 Token=ünicode", "token  =  \"" + "0af3" * 10 + '"', "ſecret=abcdefgh", "PASSWD : ABCDEFG"]
    rows = [(1, None), (2, ""), (3, "\n"), (None, "token=abcdefgh"), (4, "token=abcdefgh"), (4, "token=abcdefgh")]
    rows += [(10 + k, " ".join(rng.choice([rng.choice(parts), rng.choice(plain), "🙂"]) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    rows += [(90, " ".join(plain * 3000)), (91, "token=abcdefg " * 4000), (92, "Q" * 100_000), (93, " ".join(plain * 20) + f" note {code(30)} end"), (94, f"🙂 {code(24)}"), (95, "the " + rng.randbytes(16).hex().upper())]
    rows += [(96, "Q" * 30 + " " + "=" * 40), *((1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())]
    got = secrets.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in got:
        spans = [(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        want = base_spans(texts[r["doc_id"]])
        assert [s for s in spans if s[1] < 3] == want and spans == sorted(spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        added = [s for s in spans if s[1] == 3]
        assert r["n_random"] == len(added) and all(a >= d or b <= c for a, _, b in added for c, _, d in want)
        assert not added or r["doc_id"] is not None and r["doc_id"] < 1000 and r["doc_id"] not in (90, 91, 92, 96)
    told = {r["doc_id"]: r["n_random"] for r in got}
    assert [told[i] for i in (93, 94, 95)] == [1, 1, 1]


def test_secret_scans_of_few_rows(spark):
    assert secrets.scan(frame(spark, [])).collect() == []
    r = secrets.scan(frame(spark, [(1, None)])).first()
    assert tuple(r) == (1, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)


def test_chains_equal_plain_counts(spark):
    rng = random.Random(4)
    runs = ["".join(rng.choices(secrets.ALPHABET, k=rng.randint(1, 40))) for _ in range(300)]
    want = Counter(s[i : i + 2] for s in runs for i in range(len(s) - 1))
    assert secrets.pairs(spark.createDataFrame([(s, "x") for s in runs], "run string, label string")) == {"x": want}
    tables = secrets.ratios({"lower": want, "mixed": {"ab": 3}}, {"ab": 5, "ba": 1})
    at = secrets.ALPHABET.index
    rows = spark.createDataFrame([(s,) for s in runs], "run string").select("run", secrets.likelihood(secrets.F.col("run"), tables).alias("r")).collect()
    for s, r in rows:
        assert r == pytest.approx(max(sum(t[at(a) * 67 + at(b)] for a, b in zip(s, s[1:], strict=False)) for p, t in zip(secrets.WRITTEN.values(), tables, strict=True) if re.search(p, s)) - math.log(3), abs=1e-9)


def test_held_out_strings(spark):
    """Random strings that no pattern catches, and identifiers of corpus words that the models haven't seen."""
    rng = random.Random(11)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    words = [w for _, t in docs for w in re.findall("[a-z]{4,9}", t)]
    chars = secrets.ALPHABET[:62]
    planted, plain = {}, {}
    for i, _ in docs:
        if i % 2:
            planted[i] = rng.choice([base64.b64encode(rng.randbytes(24)).decode(), rng.randbytes(16).hex().upper(), "".join(rng.choices(chars, k=36)), rng.randbytes(11).hex()])
        else:
            own = rng.sample(words, 5)
            plain[i] = rng.choice(["_".join(own), own[0] + "".join(w.title() for w in own[1:]), "/".join(own), "".join(own)])
    rows = [(i, f"{t}\nSee {(planted | plain)[i]} there.") for i, t in docs]
    got = {r["doc_id"]: r for r in secrets.scan(frame(spark, rows)).collect()}
    text = dict(rows)
    found = sum(any(text[i][int(a) : int(b)] == s for k, a, b in (x.split(":") for x in got[i]["spans"].split(",") if x) if k == "random") for i, s in planted.items())
    assert found >= 0.95 * len(planted)
    assert sum(got[i]["n_random"] for i in plain) <= 0.02 * len(plain)


# -- whitening --------------------------------------------------------------------------------------------------------


def check_whitened(got, vectors, components=32):
    x = np.floor(64 * np.array([v for _, v in vectors], np.float64)) + 1_000_000
    n, d = x.shape
    y = x - x.mean(0)
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(components, int((value > value[0] * 1e-12).sum()))
    total = x.sum(0).astype(object)
    rows = {}
    for r in got:
        rows.setdefault(r["vec_id"], []).append(r)
    assert len(got) == n * k
    z = np.zeros((len(rows), k))
    signs = None
    for (i, _), own in zip(vectors, x.astype(np.int64).astype(object), strict=True):
        mine = sorted(rows[i], key=lambda r: r["component"])[:: len(rows[i]) // k]
        assert [r["component"] for r in mine] == list(range(1, k + 1))
        assert {r["deviation"] for r in rows[i]} == {sum((n * a - s) ** 2 for a, s in zip(own, map(int, total), strict=True))}
        z = np.array([r["whitened"] for r in mine])
        want = (own.astype(float) - total.astype(float) / n) @ vector[:, :k] / np.sqrt(value[:k])
        if signs is None:
            signs = np.sign(z * want)
        np.testing.assert_allclose(z, want * signs, atol=1e-8)
    one = got[0]
    assert one["n"] == n and one["identity_error"] < 1e-8
    for r in rows[vectors[0][0]]:
        assert r["explained"] == pytest.approx(value[r["component"] - 1] / np.trace(y.T @ y / n), rel=1e-9)


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, component string")


@pytest.mark.parametrize(("n", "d"), [(200, 64), (300, 130), (40, 5)])
def test_whitening(spark, n, d):
    rng = np.random.default_rng(d)
    good = [(i, [float(v) for v in (rng.standard_normal(d) * np.linspace(0.5, 3, d)).astype(np.float32)]) for i in range(n)]
    good[7] = (7, good[3][1])
    odd = [(1000, None), (1001, [None] * d), (1002, [float("nan")] + [0.0] * (d - 1)), (1003, [float("inf")] * d), (1004, []), (1005, [1.0] * (d + 1)), (1006, [0.5] * (d - 1) + [None])]
    check_whitened(whitening.whiten(vectors_frame(spark, good + odd)).collect(), good)


def test_whitening_of_low_rank_and_small_tables(spark):
    rng = np.random.default_rng(1)
    flat = [(i, [float(v), float(2 * v), 3.0]) for i, v in enumerate(rng.integers(-9, 9, 30))]
    check_whitened(whitening.whiten(vectors_frame(spark, flat)).collect(), flat)
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(vectors_frame(spark, rows)).collect() == []
    far = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in far} == {None}


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitened(whitening.op11_embedding_whitening(spark, SMALL).collect(), rows)


def test_eigenvectors_of_a_matrix():
    rng = np.random.default_rng(2)
    y = rng.standard_normal((900, 300)) * np.linspace(1, 4, 300)
    v = y.T @ y
    used = []
    value, vector = whitening.lobpcg(lambda b: used.append(b.shape) or v @ b, 300, 20)
    want = np.linalg.eigvalsh(v)[::-1][:20]
    np.testing.assert_allclose(value, want, rtol=1e-12)
    assert np.linalg.norm(v @ vector - vector * value, axis=0).max() < 1e-11 * want[0]
    assert max(w for _, w in used) <= 28 and len(used) > 5


def test_no_python_in_secret_scans():
    source = open(os.path.join(os.path.dirname(secrets.__file__), "secrets.py")).read()
    assert not re.search("pandas|udf|InArrow|InPandas|[.]rdd", source)
