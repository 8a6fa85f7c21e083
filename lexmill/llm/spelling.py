"""The spelling of words: bytes drawn from restaurants of the ``ORDER`` bytes before them in the word.

A restaurant's parent is that of one byte less, down to a restaurant without context over uniform bytes; each table is a
customer of the parent. Restaurants whose last two context bytes agree share all parents down to those two bytes, so
they are sampled in one task; the restaurants of one byte and of none, 2**16 numbers at most, are sampled between two passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .seating import BURN_IN, DISCOUNT, KEPT, STRENGTH, sweep
from .text import mix, stored, utf8

ORDER = 5
#: Grams that are sampled together; families of more are whole all the same.
GROUPED = 200_000
#: Gram scores (16 bytes each) that are broadcast; with more, words' grams are joined with them.
BROADCAST_GRAMS = 1_000_000
_SPACE = 32


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (ORDER context bytes, then the byte) of all bytes and ends of words, and where each word's begin."""
    size = np.diff(offsets)
    last = buf[np.maximum(offsets[1:] - 1, 0)] if len(buf) else np.zeros(len(size), np.uint8)
    ends = ~((size == 1) & (last == 10))
    flat = np.insert(buf, offsets[1:][ends], _SPACE).astype(np.int64)
    first = offsets + np.concatenate([[0], np.cumsum(ends)])
    within = np.arange(len(flat)) - np.repeat(first[:-1], np.diff(first))
    code = flat.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(len(flat), np.int64)
        before[k:] = flat[:-k]
        code |= np.where(within >= k, before, np.where(within == k - 1, _SPACE, 0)) << (8 * k)
    return code, first


class Level:
    """Dishes of the restaurants of one context length: codes, restaurants, and their customers and tables."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.key = codes, mix(codes.view(np.uint64))
        _, self.room = np.unique(codes >> 8, return_inverse=True)
        self.rooms = int(self.room.max()) + 1 if len(codes) else 0
        self.c = self.t = np.zeros(len(codes))

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.room, values, self.rooms)[self.room]

    def predict(self, parent: np.ndarray) -> np.ndarray:
        c, t = self.total(self.c), self.total(self.t)
        return (np.maximum(self.c - DISCOUNT * self.t, 0) + (STRENGTH + DISCOUNT * t) * parent) / (STRENGTH + c)

    def sit(self, c: np.ndarray) -> None:
        """The customers that children send now; dishes keep tables as far as they have customers."""
        self.c, self.t = c, np.clip(self.t, np.minimum(c, 1), c)

    def sample(self, parent: np.ndarray, salt: int) -> None:
        sweep(self.room, self.rooms, self.c, self.t, np.log(parent), self.key, salt)


def sweep_group(codes: np.ndarray, n: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples the restaurants of two context bytes and more; base (256, 256) is the one-byte restaurants' probability.

    Returns the averaged probability of each code, and (code of context byte and byte) with mean tables sent there.
    """
    levels, up = [Level(codes)], []
    for k in range(ORDER - 1, 1, -1):
        own, which = np.unique(levels[-1].codes & ((1 << (8 * k + 8)) - 1), return_inverse=True)
        up.append(which)
        levels.append(Level(own))
    low = levels[-1].codes & 0xFFFF
    ground = base[low >> 8, low & 255]
    levels[0].sit(n.astype(np.float64))
    total, sent = np.zeros(len(codes)), np.zeros(len(low))
    for step in range(BURN_IN + KEPT):
        for k, level in enumerate(levels[1:]):
            level.sit(np.bincount(up[k], levels[k].t, len(level.codes)))
        parents = [ground]
        for k in range(len(levels) - 1, 0, -1):
            parents.append(levels[k].predict(parents[-1])[up[k - 1]])
        for k, (level, parent) in enumerate(zip(levels, reversed(parents), strict=True)):
            if k:
                level.sit(np.bincount(up[k - 1], levels[k - 1].t, len(level.codes)))
            level.sample(parent, step * 10 + k)
        if step >= BURN_IN:
            p = ground
            for k in range(len(levels) - 1, -1, -1):
                p = levels[k].predict(p)
                p = p[up[k - 1]] if k else p
            total += p
            sent += levels[-1].t
    pairs, which = np.unique(low, return_inverse=True)
    return total / KEPT, pairs, np.bincount(which, sent / KEPT, len(pairs))


def sample_low(pairs: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Probabilities (context byte, byte) of the one-byte restaurants over the restaurant without context."""
    one = Level(pairs)
    bytes_, up = np.unique(pairs & 255, return_inverse=True)
    root, flat = Level(bytes_), np.full(len(bytes_), 1 / 256)
    one.sit(np.round(c))
    out = np.zeros((256, 256))
    for step in range(BURN_IN + KEPT):
        root.sit(np.bincount(up, one.t, len(bytes_)))
        root.sample(flat, step * 10 + 8)
        p0 = np.full(256, (STRENGTH + DISCOUNT * root.t.sum()) / (STRENGTH + root.c.sum()) / 256)
        p0[bytes_] = root.predict(flat)
        one.sample(p0[pairs & 255], step * 10 + 9)
        if step >= BURN_IN:
            rooms, tables = np.bincount(pairs >> 8, one.c, 256), np.bincount(pairs >> 8, one.t, 256)
            p = ((STRENGTH + DISCOUNT * tables) / (STRENGTH + rooms))[:, None] * p0[None]
            p[pairs >> 8, pairs & 255] += np.maximum(one.c - DISCOUNT * one.t, 0) / (STRENGTH + rooms[pairs >> 8])
            out += p / KEPT
    return out


def gram_scores(words: DataFrame) -> DataFrame:
    """(code, lp): averaged predictive log10 probability of each byte in its context, for all grams of words (word, n).

    The spelling is learnt from one table of the words' restaurant for each word that has customers.
    """

    def count(batches):
        for batch in batches:
            for part in (batch.slice(a, 4000) for a in range(0, batch.num_rows, 4000)):
                code, first = grams(*utf8(part.column("word")))
                codes, which = np.unique(code, return_inverse=True)
                n = np.bincount(which, np.repeat(np.minimum(part.column("n").to_numpy(), 1), np.diff(first)), len(codes))
                yield pa.record_batch({"code": pa.array(codes), "n": pa.array(n.astype(np.int64))})

    counts = words.select("word", "n").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    family = F.shiftright("code", 8).bitwiseAND(0xFFFF)
    counts = stored(counts.withColumn("family", family))

    def tasks(base: np.ndarray, scores: bool):
        given = words.sparkSession.sparkContext.broadcast(base)

        def settle(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(codes)
            p, pairs, sent = sweep_group(codes[order], n[order], given.value)
            return pa.record_batch({"code": pa.array(codes[order]), "x": np.log10(p)} if scores else {"code": pa.array(pairs), "x": sent})

        def run(batches):
            # whole families of codes, a few at a time
            codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for batch in batches:
                codes, n = np.append(codes, batch.column("code").to_numpy()), np.append(n, batch.column("n").to_numpy())
                family = codes >> 8 & 0xFFFF
                whole = int(np.argmax(family == family[-1])) if len(codes) else 0
                if whole > GROUPED:
                    yield settle(codes[:whole], n[:whole])
                    codes, n = codes[whole:], n[whole:]
            if len(codes):
                yield settle(codes, n)

        return counts.repartition("family").sortWithinPartitions("family", "code").select("code", "n").mapInArrow(run, "code long, x double")

    # the one-byte restaurants' customers: 2**16 rows at most
    low = tasks(np.full((256, 256), 1 / 256), False).groupBy("code").agg(F.sum("x").alias("x")).orderBy("code").toPandas()
    base = sample_low(low["code"].to_numpy(np.int64), low["x"].to_numpy(np.float64)) if len(low) else np.full((256, 256), 1 / 256)
    return stored(tasks(base, True).withColumnRenamed("x", "lp"))


def score_words(words: DataFrame, scores: DataFrame, limit: int = BROADCAST_GRAMS) -> DataFrame:
    """words with lp from gram scores that were stored(); these are broadcast only if they are counted to be few enough."""
    names, schema = words.columns, ", ".join(f"{c} {k}" for c, k in words.dtypes)

    def parts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                yield part, *grams(*utf8(part.column("word")))

    if scores.count() <= limit:
        table = scores.toArrow()
        codes, lp = table.column("code").to_numpy(), table.column("lp").to_numpy()
        order = np.argsort(codes)
        given = words.sparkSession.sparkContext.broadcast((codes[order], lp[order]))
        del table, codes, lp, order

        def run(batches):
            for part, code, first in parts(batches):
                codes, lp = given.value
                total = np.add.reduceat(lp[np.searchsorted(codes, code)], first[:-1]) if len(code) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total)], [*names, "lp"])

        return words.mapInArrow(run, schema + ", lp double")

    def spell(batches):
        for part, code, first in parts(batches):
            at = pa.array(np.repeat(np.arange(part.num_rows), np.diff(first)))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns), pa.array(code)], [*names, "code"])

    return words.mapInArrow(spell, schema + ", code long").join(scores, "code").groupBy(*names).agg(F.sum("lp").alias("lp"))
