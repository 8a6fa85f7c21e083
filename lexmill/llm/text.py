"""Arrow and numpy helpers that the operators use inside Spark tasks.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. A null text counts as an empty one. All functions work
on slices of an Arrow batch of at most ``SLICE`` bytes of text (one text at least), so that memory does not depend on
the batch size that the session is set to.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from lexmill.plans.registry import shared_folder

SLICE = 1 << 21
WORD_SPACE = "[\\x20\\x09-\\x0D]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for range_hash() of any range of a sequence of 64-bit values."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return total, down


def range_hash(pre: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [start, end) of the sequence given to sums()."""
    total, down = pre
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def byte_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums(_BYTE[buf])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in one array, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their texts' bytes and offsets: up to limit bytes, one row at least."""
    buf, offsets = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
        yield batch.slice(at, to - at), buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of some texts: byte ranges, hashes, and which words each text has.

    ``start`` and ``end`` are byte positions in ``buf``; text i has the words ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        n = len(buf)
        solid = ~_SEP[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = range_hash(byte_sums(self.buf), self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of the n words from each word on, across text ends too: the caller picks starts with a whole gram."""
        if len(self) < n:
            return np.zeros(0, np.uint64)
        at = np.arange(len(self) - n + 1)
        return range_hash(sums(self.hash), at, at + n)


def shingle_sets(words: Words, n: int = 5) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its n-word shingles; of fewer words, one hash of them all."""
    grams, pre = words.grams(n), None
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            pre = pre or sums(words.hash)
            yield range_hash(pre, np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, np.uint64)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def map_slices(f: Callable, column: str, limit: int = SLICE) -> Callable:
    """For mapInArrow: f(rows, buf, offsets) is called per slice and returns a RecordBatch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in slices(batch, column, limit):
                out = f(rows, buf, offsets)
                if out is not None and out.num_rows:
                    yield out
        tidy()

    return run


def tidy() -> None:
    """Gives freed memory back, so that a worker that waits for its next task holds little."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of some non-negative int64, and which of them each one is: np.unique in less memory.

    code is overwritten.
    """
    bits, top = max(1, len(code).bit_length()), int(code.max()).bit_length() if len(code) else 0
    if bits + top > 63:
        return np.unique(code, return_inverse=True)
    code <<= bits
    for a in range(0, len(code), SLICE):
        code[a : a + SLICE] |= np.arange(a, min(a + SLICE, len(code)))
    code.sort()
    which, before, made = np.empty(len(code), np.int32 if bits < 32 else np.int64), -1, 0
    for a in range(0, len(code), SLICE):
        part = code[a : a + SLICE]
        value = part >> bits
        new = np.append(value[:1] != before, value[1:] != value[:-1])
        which[part & ((1 << bits) - 1)] = made - 1 + np.cumsum(new)
        before, value = value[-1], value[new]
        # no more values than codes that were read
        code[made : made + len(value)] = value
        made += len(value)
    return code[:made], which


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, or name behind as many underscores as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ensure_checkpoints(df: DataFrame) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; a folder of our own is set only where it is unset, and the session local."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that lost executors don't repeat what led to them."""
    ensure_checkpoints(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed table in the shared checkpoint folder: for many rows, or rows read in part later."""
    import uuid

    ensure_checkpoints(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_places(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with two numbers that tell its rows apart and stay the same when it is read again: a file's hash, and the row's place in it.

    A frame that isn't read from files is written to the shared folder first.
    """
    names = [unused(df, "_file"), unused(df, "_place")]
    try:
        return df.select("*", F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names
    except AnalysisException:
        return with_places(stored(df))


#: Rows of ids that semi_join() may broadcast (16 bytes each, so 16 MB).
BROADCAST_IDS = 1_000_000


def semi_join(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi", limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of df whose key is in ids, a frame that was cut(), or with how="left_anti" the others.

    ids are broadcast only if they are counted to be few enough.
    """
    few = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if few else ids, key, how)


def training_rows(folds: int, out: int = 1):
    """crc32 of doc_id as text, modulo folds, is not out; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != out


#: Words of 64 bits of the bitmap that might_match() broadcasts: 2**19, 8 MB, whatever the input.
BITMAP_BITS = 19


def might_match(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of a join on a hash that can find a partner: those whose bit is set in a bitmap of fixed size.

    Only saves shuffling; with very many keys in wanted all bits are set, and all rows go on to the join.
    """
    word = F.shiftrightunsigned(key, 64 - BITMAP_BITS)
    bit = F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT))")
    bitmap = wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_mask"))
    found = rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word").filter(F.col("_mask").bitwiseAND(bit) != 0)
    return found.drop("_word", "_mask")
