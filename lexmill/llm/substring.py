"""Substring dedup with difference-cover anchors.

Every two places of two documents have a common offset below ``PERIOD`` that brings both to a cover place, so two equal
windows of 50 words share an aligned anchor: ANCHOR words hashed at places that are in the cover modulo the period.
Only those places are hashed and compared over the corpus. An anchor that two documents share is then extended: each
window of its documents that holds it is compared whole, by a 96-bit hash of its 50 words, and the smallest doc_id
that has it decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import Words, cut, documents, lists, map_slices, might_match, mix, range_hash, semi_join, stored, sums

WINDOW = 50
PERIOD = 31
#: A perfect difference set: each residue modulo 31 is the difference of two of its members.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
#: Windows that stand more often than OFTEN, and than a COMMON-th of all, are joined by broadcast: 24 bytes each.
OFTEN, COMMON = 500, 100_000

_cover = np.zeros(PERIOD, bool)
_cover[list(COVER)] = True


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places (as word numbers) of all anchors, and the first anchor of each text."""
    size = np.diff(words.first)
    within = np.arange(len(words)) - np.repeat(words.first[:-1], size)
    left = np.repeat(size, size) - within
    at = np.flatnonzero(_cover[within % PERIOD] & (left >= ANCHOR) & (np.repeat(size, size) >= WINDOW))
    return range_hash(sums(words.hash), at, at + ANCHOR), at, np.searchsorted(at, words.first)


def joined(words: Words, a: int, b: int, gone: np.ndarray | None = None) -> bytes:
    """The words a to b but those gone, joined by one space."""
    if gone is not None:
        raw = words.buf
        return b" ".join(raw[words.start[i] : words.end[i]].tobytes() for i in range(a, b) if not gone[i - a])
    return b" ".join(words.buf[words.start[a] : words.end[b - 1]].tobytes().split()) if b > a else b""


def profile(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    words = Words(buf, offsets)
    keys, _, first = anchors(words)
    n, a, b = np.diff(words.first), words.first[:-1], words.first[1:]
    k1, k2 = range_hash(sums(words.hash), a, b), range_hash(sums(mix(words.hash + np.uint64(99))), a, b)
    sha = [hashlib.sha256(joined(words, x, y)).hexdigest() for x, y in zip(a, b, strict=True)]
    own = [np.unique(keys[x:y]).view(np.int64) for x, y in zip(first[:-1], first[1:], strict=True)]
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sha), lists(own, pa.int64()), rows.column("t")], ["doc_id", "n_words", "k1", "k2", "sha", "anchors", "t"])


def windows(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
    """The windows that hold one of the anchors of the row's column shared."""
    words = Words(buf, offsets)
    keys, at, first = anchors(words)
    shared = rows.column("shared")
    flat, cuts = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64), shared.offsets.to_numpy() - shared.offsets[0].as_py()
    begin = np.zeros(len(words) + 1, np.int64)
    for i in range(rows.num_rows):
        x, y = first[i], first[i + 1]
        hit = at[x:y][np.isin(keys[x:y], flat[cuts[i] : cuts[i + 1]])]
        low = np.maximum(hit - (PERIOD - 1), words.first[i])
        high = np.minimum(hit, words.first[i + 1] - WINDOW) + 1
        fine = high > low
        np.add.at(begin, low[fine], 1)
        np.add.at(begin, high[fine], -1)
    start = np.flatnonzero(np.cumsum(begin)[:-1] > 0)
    if not len(start):
        return None
    row = np.searchsorted(words.first, start, "right") - 1
    w = range_hash(sums(words.hash), start, start + WINDOW)
    c = range_hash(sums(mix(words.hash + np.uint64(99))), start, start + WINDOW)
    return pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), pa.array((start - words.first[row]).astype(np.int32)), pa.array(w.view(np.int64)), pa.array((c >> np.uint64(32)).astype(np.uint32).view(np.int32)), rows.column("t").take(pa.array(row))], ["doc_id", "at", "w", "c", "t"])


def removed(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    words, out = Words(buf, offsets), []
    for i, at in enumerate(rows.column("at")):
        a, b = words.first[i], words.first[i + 1]
        mark = np.zeros(b - a + WINDOW + 1, np.int64)
        at = np.unique(at.values.to_numpy())
        at = at[at <= b - a - WINDOW]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + WINDOW, -1)
        gone = np.cumsum(mark)[: b - a] > 0
        out.append((int(gone.sum()), hashlib.sha256(joined(words, a, b, gone)).hexdigest()))
    n, sha = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("t"), pa.array(n, pa.int64()), pa.array(sha)], ["doc_id", "t", "n_removed", "kept"])


def with_texts(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """The rows of per_doc, a frame by doc_id and the text's hash that was cut(), with the texts."""
    return semi_join(docs, per_doc.select("doc_id").distinct(), "doc_id").dropDuplicates(["doc_id", "t"]).join(per_doc, ["doc_id", "t"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of 50 consecutive words over it also starts in a document with a smaller doc_id, judged on
    the input. A null or empty text has no words; texts under 50 words lose nothing; rows that repeat a doc_id, with one text
    or several, are one document and don't remove each other's words; rows without a doc_id lose nothing unless their whole text is a
    copy. Extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.hash(F.coalesce("text", F.lit(""))).alias("t"))
    kinds = "doc_id long, n_words long, k1 long, k2 long, sha string, anchors array<long>, t int"
    rows = stored(docs.mapInArrow(map_slices(profile, "text"), kinds))
    # a copy of a smaller document's whole text: all of it goes, and it tells others nothing new
    small = rows.select("doc_id", "n_words", "k1", "k2").filter(f"n_words >= {WINDOW}")
    firsts = small.groupBy("k1", "k2", "n_words").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    copies = cut(small.join(firsts, ["k1", "k2", "n_words"]).filter("smallest is not null and (doc_id is null or doc_id > smallest)").select("doc_id", "k1").distinct())

    keys = semi_join(rows.select("doc_id", "t", "k1", "anchors"), copies, ["doc_id", "k1"], "left_anti").select("doc_id", "t", F.explode("anchors").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("key"))
    per_doc = cut(might_match(keys, shared, "key").join(shared, "key").groupBy("doc_id", "t").agg(F.collect_list("key").alias("shared")))
    spots = stored(with_texts(docs, per_doc).mapInArrow(map_slices(windows, "text"), "doc_id long, at int, w long, c int, t int"))
    first = spots.groupBy("w", "c").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    first = first.filter("least < most").select("w", "c", "least", "n")
    # windows of a very common passage are told their smallest document by broadcast, COMMON at most
    often = max(OFTEN, spots.count() // COMMON)
    common = cut(first.filter(F.col("n") > often).drop("n"))
    told = spots.join(F.broadcast(common), ["w", "c"], "left")
    rare = first.filter(F.col("n") <= often).drop("n")
    rest = might_match(told.filter("least is null").drop("least"), rare, "w").join(rare, ["w", "c"])
    found = told.filter("least is not null").unionByName(rest).filter("doc_id > least")
    hits = cut(found.groupBy("doc_id", "t").agg(F.collect_list("at").alias("at")))
    cleaned = with_texts(docs, hits).mapInArrow(map_slices(removed, "text"), "doc_id long, t int, n_removed long, kept string")
    out = rows.select("doc_id", "t", "n_words", "sha", "k1").join(cleaned, ["doc_id", "t"], "left")
    marks = copies.select(F.col("doc_id").alias("_doc"), F.col("k1").alias("_k1"), F.lit(True).alias("copy"))
    out = out.join(marks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("k1") == F.col("_k1")), "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
