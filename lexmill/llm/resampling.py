"""Importance resampling towards a target distribution, over hashed runs of words.

1. Each slice of texts gets a dictionary of its distinct words, and words become integer ids. A run of n words is a tuple
   of ids; the distinct tuples are numbered level by level. The bytes of each distinct tuple are put together from the
   dictionary and hashed once, and its bucket is joined back to all its places by number.
2. What is kept of a text is how often it has each bucket (``profiles``), so texts are read and hashed once.
3. Buckets are summed over all texts and over the target's, and a bucket's gain is the logarithm of its smoothed ratio.
4. A text's weight is the mean gain of its features; noise of Gumbel's distribution, drawn by hash from its id, is added,
   and the highest sums are a draw without repetition in proportion to the weights' exponentials.

Ranks come from ranges of the order, so no task or driver sees all drawn rows.
"""

from __future__ import annotations

import math
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as S

from .text import LOWER, cut, documents, lists, map_slices, numbered, stored

#: Longest runs, buckets, share to be drawn, and the words that a text needs to be drawn.
ORDER, BUCKETS, SHARE, LEAST_WORDS, SEED = 1, 10_000, (10, 100), 20, 2024
_WORD = np.ones(256, bool)
_WORD[:128] = [chr(c) in string.digits + string.ascii_lowercase for c in range(128)]


def dictionary(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The ids of all words of some texts in order, the distinct words, and where each text's words begin."""
    buf = LOWER[buf]
    solid = _WORD[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | edge[:-1]))
    end = np.flatnonzero(solid & (~np.append(solid[1:], False) | edge[1:])) + 1
    at = np.append(0, np.cumsum(end - start))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(buf[solid])]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist(), np.searchsorted(start, offsets)


def feature_buckets(buf: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each feature its text and its bucket, and how many words each text has."""
    ids, words, first = dictionary(buf, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    known, which = words, ids
    texts, found = [], []
    for n in range(1, order + 1):
        if n > 1:
            whole = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
            last = np.zeros(len(text), np.int64)
            last[: len(text) - n + 1] = ids[n - 1 :]
            code = which[whole] * len(words) + last[whole]
            tuples, number = numbered(code)
            known = [known[t // len(words)] + b" " + words[t % len(words)] for t in tuples.tolist()]
            which = np.zeros(len(text), np.int64)
            which[whole] = number
        else:
            whole = np.arange(len(text))
        hashed = np.fromiter((zlib.crc32(k) % buckets for k in known), np.int64, len(known))
        texts.append(text[whole])
        found.append(hashed[which[whole]] if len(whole) else np.zeros(0, np.int64))
    return np.concatenate(texts), np.concatenate(found), np.diff(first)


def profiles(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """One row per row: doc_id, n_words, n_features, the distinct buckets in order, and how often each occurs."""

    def run(rows, buf, offsets):
        text, bucket, n_words = feature_buckets(buf, offsets, order, buckets)
        code, times = np.unique(text * buckets + bucket, return_counts=True)
        ends = np.searchsorted(code, np.arange(1, rows.num_rows) * buckets)
        cols = {"doc_id": rows.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_features": pa.array(np.bincount(text, minlength=rows.num_rows), pa.int64())}
        return pa.RecordBatch.from_pydict(cols | {"buckets": lists(np.split(code % buckets, ends), pa.int32()), "times": lists(np.split(times, ends), pa.int32())})

    docs = docs.select("doc_id", "text")
    kind = S.StructType([docs.schema["doc_id"], *(S.StructField(c, S.LongType()) for c in ("n_words", "n_features")), *(S.StructField(c, S.ArrayType(S.IntegerType())) for c in ("buckets", "times"))])
    return docs.mapInArrow(map_slices(run, "text"), kind)


def bucket_sums(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all profiles: tasks sum first, so at most buckets rows a task are shuffled."""
    each = rows.select(F.explode(F.arrays_zip("buckets", "times")).alias("b")).groupBy("b.buckets").agg(F.sum("b.times").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in each.collect():
        out[r[0]] = r[1]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the source, in doubles."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + n) / ((float(x) + 1) * (t + n)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of the features' gains, of profiles."""
    given = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for batch in batches:
            bucket, times = batch.column("buckets"), batch.column("times")
            each = given.value[bucket.flatten().to_numpy()] * times.flatten().to_numpy()
            upto, at = np.append(0, np.cumsum(each)), bucket.offsets.to_numpy() - bucket.offsets[0].as_py()
            n = batch.column("n_features").to_numpy()
            weight = (upto[at[1:]] - upto[at[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    kind = S.StructType([*rows.schema.fields[:3], S.StructField("weight", S.LongType())])
    return rows.mapInArrow(run, kind)


def noise(seed: int) -> Column:
    """floor(1000 g) of a draw g from Gumbel's distribution, by hash of doc_id; a null doc_id counts as the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank, from 1 on, in an order: ranges of it are sorted, and ranges' sizes are added up."""
    sorted_rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    sizes = sorted_rows.groupBy(F.spark_partition_id().alias("part")).count().collect()
    before, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in sizes):
        before[part], total = total, total + n
    if not before:
        return sorted_rows.withColumn("rank", F.lit(None).cast("long"))
    # a number of a row begins with that of its range and ends with its place there
    starts = F.from_json(F.lit(str([before.get(p, 0) for p in range(max(before) + 1)])), "array<bigint>")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_rows.withColumn("rank", F.get(starts, F.spark_partition_id()) + place + 1)


def importance_resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, and rank of those drawn, else null.

    A null text has no words; a text without features weighs 0 and isn't drawn, nor is one of fewer words than
    least_words. Of equal scores the smaller doc_id is drawn first, a null doc_id last; rows that repeat a doc_id and its
    score take neighbouring ranks. Empty tables are fine on either side: no rows, or gains that tell of smoothing alone.
    Extra columns of docs and target are ignored.
    """
    rows = stored(profiles(docs, order, buckets))
    wanted = profiles(target.select(F.lit(0).alias("doc_id"), "text"), order, buckets)
    gain = gains(bucket_sums(rows, buckets), bucket_sums(wanted, buckets))
    scored = stored(weighted(rows, gain).withColumn("score", F.col("weight") + noise(seed)))

    # scores are whole numbers within some 150,000 of each other: they are counted to find the lowest one that is drawn
    fit = F.col("n_words") >= least_words
    levels = scored.filter(fit).groupBy("score").count().toArrow()
    score, n = levels.column("score").to_numpy(), levels.column("count").to_numpy()
    by = np.argsort(-score)
    upto = np.cumsum(n[by])
    drawn = int(upto[-1]) * share[0] // share[1] if len(upto) else 0
    empty = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*columns, empty)
    least = F.lit(int(score[by][np.searchsorted(upto, drawn)]))
    top = ranked(scored.filter(fit & (F.col("score") >= least)).select(*columns), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")])
    rest = scored.filter(~fit | (F.col("score") < least)).select(*columns, empty)
    return top.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(rest)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS steps),
d AS (SELECT doc_id, {_WORDS} AS words FROM documents), b AS (SELECT {_WORDS} AS words FROM benchmark),
o AS (SELECT doc_id, unnest(words) AS w FROM d), q AS (SELECT unnest(words) AS w FROM b),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM o UNION SELECT w FROM q)),
c AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c // 256, steps[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM v, k),
s AS (SELECT bucket, count(*) AS s FROM o JOIN c USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM q JOIN c USING (w) GROUP BY bucket),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS t_all),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), a),
f AS (SELECT doc_id, sum(gain)::BIGINT AS total FROM o JOIN c USING (w) JOIN g USING (bucket) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce((total - ((total % len(words)) + len(words)) % len(words)) // len(words), 0)::BIGINT AS weight FROM d LEFT JOIN f USING (doc_id)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM m),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)
"""
