"""Benchmark decontamination by the q-gram lemma.

An item of L bytes that occurs in a text with at most k edits shares at least ``L - q + 1 - k q`` of its q-grams with
it, on diagonals (place in the text less place in the item) at most k apart. Shared q-grams are counted in overlapping
bands of diagonals; bands that reach the bound are verified by a banded alignment of the whole item. Texts and items
are compared in lower case (A-Z) with runs of white space as one space.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import _SEP, LOWER, byte_sums, documents, map_slices, range_hash, stored

Q = 10
#: Edits that an occurrence may have, as a share of the item's bytes.
EDITS = 0.07
#: Bytes of benchmark items that are broadcast at a time; a larger benchmark is taken in blocks, a pass for each.
BLOCK_BYTES = 8 << 20
#: Pairs of equal q-grams that are held at a time, and diagonals that are aligned together.
PAIRS, WIDE = 1 << 19, 1 << 14
_BITS = 21


def normalise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The compared bytes of texts, their offsets, and each byte's place in buf."""
    sep = _SEP[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(sep[1:] & sep[:-1])
    keep[offsets[:-1][offsets[:-1] < len(buf)]] = True
    at = np.flatnonzero(keep)
    return np.where(sep, np.uint8(32), LOWER[buf])[at], np.searchsorted(at, offsets), at


class Items:
    """Benchmark items and an index of their q-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.texts = [], []
        for i, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            if own := normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip():
                self.ids.append(i)
                self.texts.append(own)
        size = np.array([len(t) for t in self.texts], np.int64)
        # the lemma's bound is one at least
        self.budget = np.minimum((EDITS * size).astype(np.int64), np.maximum(0, (size - Q) // Q))
        self.bound = np.maximum(1, size - Q + 1 - self.budget * Q)
        self.shift = np.ceil(np.log2(self.budget + 1)).astype(np.int64)
        buf = np.frombuffer(b"".join(self.texts), np.uint8)
        first = np.concatenate([[0], np.cumsum(size)])
        item = np.repeat(np.arange(len(size)), np.maximum(0, size - Q + 1))
        place = np.arange(len(item)) - np.repeat(np.cumsum(np.maximum(0, size - Q + 1)) - np.maximum(0, size - Q + 1), np.maximum(0, size - Q + 1))
        start = first[item] + place
        h = range_hash(byte_sums(buf), start, start + Q) if len(start) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], item[order], place[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hash & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        self.reach = int(size.max() + 4 * self.budget.max()) if len(size) else 0
        self.short = [j for j in range(len(size)) if size[j] < Q]

    def regions(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, lowest diagonal, highest) of bands that hold enough shared q-grams."""
        if len(buf) < Q or not len(self.hash):
            return []
        at = np.arange(len(buf) - Q + 1)
        h = range_hash(byte_sums(buf), at, at + Q)
        at = at[self.seen[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)]]
        h = h[at]
        low, high = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
        text = np.searchsorted(offsets, at, "right") - 1
        fine = (high > low) & (at + Q <= offsets[text + 1])
        at, low, n, text = at[fine], low[fine], (high - low)[fine], text[fine]
        # a repetitive text has many pairs: runs of at most PAIRS, each with what an occurrence reaches back
        total, begin, found = np.cumsum(n), 0, set()
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            back = int(np.searchsorted(at, at[begin] - self.reach))
            found.update(self._bands(at[back:end], low[back:end], n[back:end], text[back:end]))
            begin = end
        return merged(sorted(found))

    def _bands(self, at: np.ndarray, low: np.ndarray, n: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, text, item, place = np.repeat(at, n), np.repeat(text, n), self.item[k], self.place[k]
        diagonal = at - place + (1 << 40)
        band = diagonal >> self.shift[item]
        one = np.concatenate([np.stack([text, item, band - d, place, diagonal]) for d in (0, 1)], 1)
        one = one[:, np.lexsort((one[3], one[2], one[1], one[0]))]
        key = np.any(one[:3, 1:] != one[:3, :-1], 0)
        begin = np.flatnonzero(np.concatenate([[True], key])) if one.shape[1] else np.zeros(0, np.int64)
        fresh = np.concatenate([[True], key | (one[3, 1:] != one[3, :-1])]) if one.shape[1] else np.zeros(0, bool)
        if not len(begin):
            return []
        shared = np.add.reduceat(fresh.astype(np.int64), begin)
        ok = shared >= self.bound[one[1, begin]]
        lo, hi = np.minimum.reduceat(one[4], begin), np.maximum.reduceat(one[4], begin)
        return [(int(one[0, b]), int(one[1, b]), int(x) - (1 << 40), int(y) - (1 << 40)) for b, x, y in zip(begin[ok], lo[ok], hi[ok], strict=True)]


def merged(bands: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Bands of one text and item that touch, as one of up to WIDE diagonals: they are aligned together."""
    out: list[list[int]] = []
    for text, item, lo, hi in bands:
        if out and out[-1][:2] == [text, item] and lo <= out[-1][3] + 1 and hi - out[-1][2] < WIDE:
            out[-1][3] = max(out[-1][3], hi)
        else:
            out.append([text, item, lo, hi])
    return [tuple(x) for x in out]


def align(item: bytes, text: bytes, lo: int, hi: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence whose diagonals lie in [lo - budget, hi + budget], if within budget."""
    d = text.find(item, max(0, lo), max(0, hi + len(item)))
    if d >= 0:
        return 0, d, d + len(item)
    a, t = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    lo, hi = lo - budget, hi + budget
    width, far = hi - lo + 1, len(item) + len(text) + 1
    span = np.arange(width)
    # cell j of row i: the first i bytes of the item end at place i + lo + j of the text
    place = lo + span
    cost = np.where((place >= 0) & (place <= len(t)), 0, far)
    start = place.copy()
    for i in range(1, len(a) + 1):
        place = i + lo + span
        inside = (place >= 0) & (place <= len(t))
        sub = cost + (t[np.clip(place - 1, 0, len(t) - 1)] != a[i - 1])
        sub[place < 1] = far
        gap = np.append(cost[1:], far) + 1
        best = np.where(sub <= gap, sub, gap)
        begun = np.where(sub <= gap, start, np.append(start[1:], 0))
        best[~inside] = far
        run = np.minimum.accumulate(best - span)
        source = np.maximum.accumulate(np.where(best - span == run, span, 0))
        start, cost = begun[source], run + span
        cost[~inside] = far
        if cost.min() > budget:
            return None
    j = int(cost.argmin())
    return int(cost[j]), int(start[j]), len(a) + lo + j


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that occurs in it: doc_id, item_id, edits, start, end (bytes of text), n_regions.

    Of several occurrences the one with the fewest edits, then the first is told. Null or empty texts and items match
    nothing; items shorter than Q bytes are looked for verbatim; repeated rows of docs give repeated rows. Extra
    columns are ignored. Each task streams its texts past one block of items.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // BLOCK_BYTES))
    found = []
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().orderBy("item_id", "text").collect()
        given = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in own]))

        def run(rows, buf, offsets, given=given):
            index = given.value
            norm, first, origin = normalise(buf, offsets)
            hits: dict[tuple[int, int], list] = {}
            for text, item, lo, hi in index.regions(norm, first):
                own = norm[first[text] : first[text + 1]].tobytes()
                if hit := align(index.texts[item], own, lo - int(first[text]), hi - int(first[text]), int(index.budget[item])):
                    hits.setdefault((text, item), []).append(hit)
            for item in index.short:
                for text in range(rows.num_rows):
                    if (at := norm[first[text] : first[text + 1]].tobytes().find(index.texts[item])) >= 0:
                        hits.setdefault((text, item), []).append((0, at, at + len(index.texts[item])))
            out = []
            for (text, item), spans in sorted(hits.items()):
                edits, start, end = min(spans)
                start, last = origin[first[text] + start], origin[first[text] + max(start, end - 1)]
                out.append((text, index.ids[item], edits, int(start - offsets[text]), int(last + 1 - offsets[text]), len({s[1] for s in spans})))
            if not out:
                return None
            text, *rest = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(text)), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "edits", "start", "end", "n_regions"])

        part = docs.select("doc_id", "text").mapInArrow(map_slices(run, "text"), "doc_id long, item_id long, edits long, start long, end long, n_regions long")
        if blocks > 1:  # a block's items leave the driver before the next ones come
            part = stored(part)
            given.destroy()
        found.append(part)
    return reduce(DataFrame.union, found)


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
