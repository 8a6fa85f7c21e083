"""Suffix-array dedup: bytes covered by a 400-byte string that also starts elsewhere.

The corpus is cut into shards that external induced suffix sorting (induced.py) takes one at a time. Each 400-byte string has
an anchor, the 24-byte string in it with the least hash (the leftmost of equals), and a place of it, so equal strings have
equal ones. Neighbouring strings with one anchor in one of four ranges of places form a piece; they all hold the same
``CORE`` bytes at a fixed distance from the anchor, and the hash of these is the piece's key. All places of equal strings so
meet in one key, and strings whose core occurs once are settled by a count. Equal pieces are one row with a count, so
large groups of copies are never moved. A key with more than ``MOST`` different pieces isn't sorted in one shard: its
strings are counted one by one by their 128-bit hashes, which spreads them over all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .induced import Sorter
from .text import byte_sums, cut, documents, lists, map_slices, might_match, mix, range_hash, semi_join, stored, tidy

LENGTH = 400
ANCHOR = 24
#: Places of an anchor that are taken together, and the bytes that their strings share.
RANGE = 95
CORE = LENGTH - RANGE + 1
#: Bytes of pieces that are sorted at a time, but for one key's, and different pieces of a key that are sorted.
SHARD, MOST = 2 << 20, 1 << 14
#: Bytes of texts that are read together, and starts that are looked at together.
SLICE_BYTES = 1 << 19
_WIDTH = LENGTH - ANCHOR + 1
_LOW = np.uint64((1 << 24) - 1)
PIECES = "key array<long>, lo array<int>, hi array<int>, place array<int>"


def pieces(text: np.ndarray) -> np.ndarray:
    """Rows (key, first start, end of starts, anchor's place in the first string) of all pieces of a text."""
    out = [np.zeros((0, 4), np.int64)]
    for begin in range(0, len(text) - LENGTH + 1, SLICE_BYTES):
        buf = text[begin : begin + SLICE_BYTES + LENGTH - 1]
        pre, at = byte_sums(buf), np.arange(len(buf) - ANCHOR + 1)
        least = range_hash(pre, at, at + ANCHOR) & ~_LOW | at.astype(np.uint64)
        width = 1
        while width * 2 <= _WIDTH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (_WIDTH - width)], least[_WIDTH - width :])
        start = np.arange(len(least))
        anchor = (least & _LOW).astype(np.int64)
        part = (anchor - start) // RANGE
        lo = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]))
        core = anchor[lo] - part[lo] * RANGE
        key = mix(range_hash(pre, core, core + CORE) + part[lo].astype(np.uint64))
        out.append(np.stack([key.view(np.int64), lo + begin, np.append(lo[1:], len(start)) + begin, (anchor - start)[lo]], 1))
    return np.concatenate(out)


def profile(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    texts = [buf[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sha = [hashlib.sha256(t.tobytes()).digest() for t in texts]
    u = np.frombuffer(b"".join(d[:16] for d in sha), ">i8").astype(np.int64).reshape(-1, 2)
    found = [pieces(t) for t in texts]
    cols = [rows.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array([d.hex() for d in sha]), pa.array(u[:, 0]), pa.array(u[:, 1])]
    cols += [lists([f[:, k] for f in found], pa.int32() if k else pa.int64()) for k in range(4)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "sha", "u1", "u2", "key", "lo", "hi", "place"])


def two_hashes(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(range_hash(byte_sums(flat ^ np.uint8(salt)), lo, hi).view(np.int64) for salt in (0, 0xA5))


def parts(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The bytes of the pieces that the column shared lists."""
    out, data = [], []
    for i, shared in enumerate(rows.column("shared").to_pylist()):
        for r in shared:
            data.append(buf[offsets[i] + r["lo"] : offsets[i] + r["hi"] - 1 + LENGTH].tobytes())
            out.append((rows.column("u1")[i].as_py(), rows.column("u2")[i].as_py(), r["key"], r["lo"]))
    ends = np.cumsum([0, *map(len, data)])
    h, h2 = two_hashes(np.frombuffer(b"".join(data), np.uint8), ends[:-1], ends[1:])
    cols = [*(pa.array(x, pa.int64()) for x in zip(*out, strict=True)), pa.array(h), pa.array(h2), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["u1", "u2", "key", "lo", "h", "h2", "part"])


def runs_of(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SPANS = "key long, h long, h2 long, begin array<int>, end array<int>"


def sort_shards(batches):
    """Per distinct piece, the runs of places that begin a repeated string; rows come sorted by key."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        key, h, h2, n, data = zip(*held, strict=True)
        # byte 255 is in no UTF-8 text: all bytes move up by one, and 0 ends a piece
        mark = Sorter(np.frombuffer(b"\xff".join([*data, b""]), np.uint8) + np.uint8(1), LENGTH).repeated()
        at, spans = 0, []
        for d, copies in zip(data, n, strict=True):
            spans.append(runs_of(np.ones(len(d) - LENGTH + 1, bool) if copies > 1 else mark[at : at + len(d) - LENGTH + 1]))
            at += len(d) + 1
        cols = [pa.array(x, pa.int64()) for x in (key, h, h2)]
        return pa.RecordBatch.from_arrays([*cols, *(lists([s[k].astype(np.int32) for s in spans], pa.int32()) for k in (0, 1))], [c.split()[0] for c in SPANS.split(", ")])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "h", "h2", "n", "part")), strict=True):
            if size >= SHARD and row[0] != held[-1][0]:
                yield settle(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield settle(held)
    tidy()


def strings(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The hashes of all 400-byte strings of pieces."""
    n = np.diff(offsets) - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    s1, s2 = two_hashes(buf, offsets[:-1][owner] + at, offsets[:-1][owner] + at + LENGTH)
    took = pa.array(owner)
    return pa.RecordBatch.from_arrays([*(rows.column(c).take(took) for c in ("key", "h", "h2", "n")), pa.array(at, pa.int32()), pa.array(s1), pa.array(s2)], ["key", "h", "h2", "n", "at", "s1", "s2"])


def counted(hot: DataFrame) -> DataFrame:
    """SPANS of distinct pieces by counting each of their strings; a string in many pieces is summed before it is shuffled."""
    every = stored(hot.mapInArrow(map_slices(strings, "part", SLICE_BYTES // 4), "key long, h long, h2 long, n long, at int, s1 long, s2 long"))
    often = every.groupBy("s1", "s2").agg(F.sum("n").alias("times")).filter("times > 1").select("s1", "s2")
    marks = every.join(often, ["s1", "s2"]).groupBy("key", "h", "h2").agg(F.sort_array(F.collect_list("at")).alias("begin"))
    return marks.select("key", "h", "h2", "begin", F.transform("begin", lambda x: x + 1).alias("end"))


def removed(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    out = []
    for i, spans in enumerate(rows.column("spans").to_pylist()):
        own = buf[offsets[i] : offsets[i + 1]]
        mark = np.zeros(len(own) + 1, np.int64)
        np.add.at(mark, [s["a"] for s in spans], 1)
        np.add.at(mark, [min(s["b"], len(own)) for s in spans], -1)
        gone = np.cumsum(mark)[:-1] > 0
        out.append((int(gone.sum()), len(runs_of(gone)[0]), hashlib.sha256(own[~gone].tobytes()).hexdigest()))
    n, k, sha = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([rows.column("u1"), rows.column("u2"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha)], ["u1", "u2", "n_removed", "n_spans", "kept"])


def with_texts(docs: DataFrame, per_text: DataFrame) -> DataFrame:
    """per_text, a frame by (u1, u2) that was cut(), with the texts of which these are the digest's first half."""
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    half = lambda k: F.conv(F.substring(sha, k, 16), 16, -10).cast("long")
    texts = docs.select(half(1).alias("u1"), half(17).alias("u2"), "text")
    return semi_join(texts, per_text.select("u1").distinct(), "u1").dropDuplicates(["u1", "u2"]).join(per_text, ["u1", "u2"])


def suffix_dedup(docs: DataFrame, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty; texts under 400 bytes lose nothing; a text that another row repeats (with whatever
    doc_id, null ones too) and that has 400 bytes goes whole. Extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(docs.mapInArrow(map_slices(profile, "text", SLICE_BYTES), f"doc_id long, n_bytes long, sha string, u1 long, u2 long, {PIECES}"))
    u = ["u1", "u2"]
    many = cut(rows.groupBy(*u).agg(F.count("*").alias("copies")).filter("copies > 1").select(*u))
    # of a text that repeats, one row goes on
    alone = rows.join(many, u, "left_anti")
    copies = rows.join(many, u, "left_semi").select(*u, *(c.split()[0] for c in PIECES.split(", "))).dropDuplicates(u)
    single = alone.select(*copies.columns).unionByName(copies)
    found = single.select(*u, F.explode(F.arrays_zip("key", "lo", "hi")).alias("r")).select(*u, "r.key", "r.lo", "r.hi")
    shared = cut(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    per_text = cut(might_match(found, shared, "key").join(shared, "key").groupBy(*u).agg(F.collect_list(F.struct("key", "lo", "hi")).alias("shared")))
    kept = stored(with_texts(docs, per_text).mapInArrow(map_slices(parts, "text", SLICE_BYTES), "u1 long, u2 long, key long, lo long, h long, h2 long, part binary"))
    distinct = stored(kept.groupBy("key", "h", "h2").agg(F.count("*").alias("n"), F.first("part").alias("part")))
    keys = cut(distinct.groupBy("key").agg(F.count("*").alias("pieces")))
    one, hot = keys.filter("pieces = 1").select("key"), cut(keys.filter(F.col("pieces") > most).select("key"))
    size = F.octet_length("part") - LENGTH + 1
    marks = distinct.join(one, "key", "left_semi").filter("n > 1").select("key", "h", "h2", F.array(F.lit(0)).alias("begin"), F.array(size).alias("end"))
    several = keys.filter(f"pieces between 2 and {most}").select("key")
    # by a hash: dealing by the join's own key is dropped, and adaptive execution may then read the join's rows file by file
    dealt = distinct.join(several, "key", "left_semi").repartition(F.xxhash64("key")).sortWithinPartitions("key")
    marks = marks.union(dealt.mapInArrow(sort_shards, SPANS))
    if not hot.isEmpty():
        marks = marks.union(counted(distinct.join(hot, "key", "left_semi").select("key", "h", "h2", "n", "part")))
    spans = cut(marks.filter(F.size("begin") > 0)).select("key", "h", "h2", F.explode(F.arrays_zip("begin", "end")).alias("s"))
    hits = kept.select(*u, "key", "lo", "h", "h2").join(spans, ["key", "h", "h2"])
    hits = hits.groupBy(*u).agg(F.collect_list(F.struct((F.col("lo") + F.col("s.begin")).alias("a"), (F.col("lo") + F.col("s.end") - 1 + LENGTH).alias("b"))).alias("spans"))
    cleaned = with_texts(docs, cut(hits)).mapInArrow(map_slices(removed, "text", SLICE_BYTES), "u1 long, u2 long, n_removed long, n_spans long, kept string")
    out = rows.select("doc_id", "n_bytes", "sha", *u).join(cleaned, u, "left").join(many.withColumn("many", F.lit(True)), u, "left")
    whole = F.coalesce(F.col("many"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
