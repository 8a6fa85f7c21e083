"""Language-model scoring with a hierarchical Pitman-Yor model of words in context and their spelling.

A text is its words and an end. Each word is drawn from the restaurant of the word before it (of the end at a text's
begin); every table there is a customer of the restaurant without context, whose tables are spelt (spelling.py): a word is
its bytes and an end; the end of a text is a word of one line feed. Tables are drawn by Gibbs sweeps (seating.py), and the
counts of the last sweeps are averaged.

Texts are cut into slices once: a row holds the slice's distinct words and its tokens as numbers of these. A slice sends
each bucket of words those of its words that are in it, with their counts, and each part its distinct pairs (word before,
word), by hash of the word before; contexts of more than ``HOT`` customers are dealt in pieces by the next word too. A
part adds the pairs up, sweeps over its contexts, whose parent gives words their share of all tokens meanwhile, and sends
each slice its pairs' customers and tables in the order in which they came. The tables sent to each word by all parts are
then the customers of the one restaurant without context, and that is sampled.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .seating import BURN_IN, DISCOUNT, KEPT, STRENGTH, draw, sweep
from .spelling import gram_scores, score_words
from .text import Words, documents, mix, numbered, slices, stored, tidy, training_rows

#: Bytes of texts in a slice.
SLICE_BYTES = 32 << 20
#: Bytes of names that are hashed together, and tokens that are added up together.
NAMES_BYTES, TOKENS = 1 << 19, 1 << 20
#: Customers of the contexts of a part, on average, and words that slices send to a bucket.
PART_TOKENS, BUCKET_WORDS = 3 << 20, 1 << 19
#: Customers from which a context is dealt in pieces: so many, or a hundred thousandth of all, so 100,000 words are hot at most.
HOT, HOT_WORDS = 1 << 20, 100_000
#: The end of a text as it is spelt, and among a slice's words: a byte that UTF-8 never uses.
END, MARK = "\n", b"\xff"
#: The most frequent words whose share of all tokens every part is told: 16 bytes each, a megabyte.
COMMON = 1 << 16
#: Bits of a word's hash that tell it from others in a context.
_TOLD = np.uint64(16)
LN10 = float(np.log(10))
_ZSTD = pa.Codec("zstd", compression_level=7)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers in one compressed block, byte by byte of their places."""
    head = np.array([len(a) for a in arrays], np.int64).view(np.uint8)
    raw, at = np.empty(len(head) + sum(a.nbytes for a in arrays), np.uint8), len(head)
    raw[:at] = head
    for a in arrays:
        raw[at : at + a.nbytes].reshape(a.itemsize, len(a))[:] = a.view(np.uint8).reshape(len(a), a.itemsize).T
        at += a.nbytes
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpack(block: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)), kinds, strict=True):
        size = np.dtype(kind).itemsize
        own = np.frombuffer(raw, np.uint8, int(n) * size, at).reshape(size, int(n)).T
        out.append(np.ascontiguousarray(own).view(kind)[:, 0] if n else np.zeros(0, kind))
        at += int(n) * size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """The differences of numbers in ascending order, from 0 on."""
    return np.diff(x, prepend=np.uint64(0))


SLICES = "slice long, doc_id array<long>, kinds long, words binary, tokens binary"


def sliced(docs: DataFrame) -> DataFrame:
    """Rows SLICES: each a run of texts of up to SLICE_BYTES, one text at least."""

    def made(held: list[tuple]) -> pa.RecordBatch:
        ids, keys, names, at, sizes, learn = map(list, zip(*held, strict=True))
        held.clear()
        start = np.cumsum([0, *map(len, keys)])
        distinct, rep, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        for k, x in enumerate(at):
            at[k] = np.append(which[start[k] : start[k + 1]], len(distinct)).astype(np.int32)[x]
        tokens = np.concatenate(at)
        at.clear()
        del keys, which
        # the distinct words by how often they stand here, then the end
        order = np.argsort(-np.bincount(tokens, minlength=len(distinct) + 1)[:-1], kind="stable")
        rank = np.empty(len(distinct) + 1, np.uint32)
        rank[order], rank[-1] = np.arange(len(distinct)), len(distinct)
        words = pa.concat_arrays(names).take(pa.array(rep[order]))
        names.clear()
        words = np.frombuffer(b" ".join([*words.to_pylist(), MARK]), np.uint8)
        tokens = rank[tokens]
        blob = pack(words), pack(tokens, np.concatenate(sizes).astype(np.uint32), np.concatenate(learn))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
        row = [uuid.uuid4().int >> 65, [i for x in ids for i in x], len(distinct) + 1, *blob]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SLICES.split(", ")])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text"):
                if held and size + len(buf) > SLICE_BYTES:
                    yield made(held)
                    size = 0
                found = Words(buf, offsets, lower=True)
                keys, rep, which = np.unique(found.hash, return_index=True, return_inverse=True)
                names = pa.array([found.buf[a:b].tobytes() for a, b in zip(found.start[rep], found.end[rep], strict=True)], pa.binary())
                at = np.insert(which.astype(np.int32), found.first[1:], len(keys))
                held.append((rows.column("doc_id").to_pylist(), keys, names, at, np.diff(found.first) + 1, rows.column("learn").to_numpy(zero_copy_only=False)))
                size += len(buf)
        if held:
            yield made(held)
        tidy()

    rows = docs.select("doc_id", "text", training_rows(5).alias("learn"))
    return rows.mapInArrow(run, SLICES)


def hashes(names: np.ndarray, step: int = NAMES_BYTES) -> np.ndarray:
    """Hashes of words with a space between each two; step bytes, to the end of a word, are looked at together."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(names):
        to = min(len(names), at + step)
        while to < len(names) and names[to] != 0x20:
            to += 1
        out.append(Words(names[at:to], np.array([0, to - at])).hash)
        at = to
    return np.concatenate(out)


class Slice:
    """A row SLICES: its words, their hashes in order, tokens as places in these, and each text's tokens."""

    def __init__(self, words: bytes, tokens: bytes):
        (self.names,) = unpack(words, np.uint8)
        h = hashes(self.names)
        self.order = np.argsort(h)
        self.h = h[self.order]
        place = np.empty(len(h), np.int32)
        place[self.order] = np.arange(len(h))
        at, self.sizes, learn = unpack(tokens, np.uint32, np.uint32, bool)
        self.at = place[at]
        self.taught = np.repeat(learn, self.sizes)

    def by_bucket(self, buckets: int):
        """(bucket, places of the words in it)."""
        bucket = self.h.view(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        found, first = np.unique(bucket[order], return_index=True)
        return zip(found.tolist(), np.split(order, first[1:]), strict=True)


class Pairs:
    """The distinct pairs (word before, word) of a slice, dealt to parts; ``which[t]`` is token t's pair."""

    def __init__(self, own: Slice, parts: int, hot: tuple[np.ndarray, np.ndarray]):
        n = len(own.h)
        # the end of a text stands before the next one, and the last one's before the first
        code = np.empty(len(own.at), np.int64)
        code[:1], code[1:] = own.at[-1:], own.at[:-1]
        code *= n
        code += own.at
        code, self.which = numbered(code)
        self.u, self.w, self.times = np.empty(len(code), np.int32), np.empty(len(code), np.int32), np.zeros(len(code), np.uint32)
        np.floor_divide(code, n, out=self.u, casting="unsafe")
        np.remainder(code, n, out=self.w, casting="unsafe")
        del code
        for a in range(0, len(self.which), TOKENS):
            np.add.at(self.times, self.which[a : a + TOKENS][own.taught[a : a + TOKENS]], np.uint32(1))
        part = (mix(own.h) % np.uint64(parts)).astype(np.int32)[self.u]
        keys, several = hot
        if len(keys):
            k = np.minimum(np.searchsorted(keys, own.h), len(keys) - 1)
            pieces = np.where(keys[k] == own.h, several[k], 1).astype(np.uint64)
            dealt, told = np.flatnonzero((pieces > 1)[self.u]), mix(own.h >> _TOLD << _TOLD)
            for a in range(0, len(dealt), TOKENS):
                some = dealt[a : a + TOKENS]
                piece = told[self.w[some]] % pieces[self.u[some]] * np.uint64(0x9E3779B97F4A7C15)
                part[some] = mix(own.h[self.u[some]] + piece) % np.uint64(parts)
        self.order = np.argsort(part, kind="stable").astype(np.int32)
        bounds = np.searchsorted(part[self.order], np.arange(parts + 1, dtype=np.int32))
        self.parts = np.flatnonzero(np.diff(bounds))
        self.bounds = np.append(bounds[self.parts], len(part))

    def dealt(self):
        """(part, the places of its pairs, its first words, and how many pairs each of these has)."""
        for k, part in enumerate(self.parts):
            own = self.order[self.bounds[k] : self.bounds[k + 1]]
            yield int(part), own, *np.unique(self.u[own], return_counts=True)


def each_slice(f):
    """For mapInArrow over rows SLICES: f(slice number, Slice) gives record batches."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from f(batch.column("slice")[k].as_py(), Slice(batch.column("words")[k].as_py(), batch.column("tokens")[k].as_py()))
                tidy()

    return run


def merged(group: pa.Table) -> pa.Table:
    """(key, word, n): the distinct words of a bucket, and how often training texts have them."""
    names, keys, n = [], [], []
    for block in group.column("sent").to_pylist():
        own, count = unpack(block, np.uint8, np.int64)
        names.append(pa.array(own.tobytes().split(), pa.binary()))
        keys.append(hashes(own))
        n.append(count)
    keys, rep, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    word = pa.concat_arrays(names).take(pa.array(rep))
    word = pc.if_else(pc.equal(word, MARK), END.encode(), word).cast(pa.string())
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, which, np.concatenate(n))
    return pa.table({"key": keys.view(np.int64), "word": word, "n": total})


def told(mail: pa.Table, words: pa.Table) -> pa.Table:
    """(slice, bucket, answer): how often each word that a slice sent is learnt from, and its log10 probability."""
    key, rows = words.column("key").to_numpy(), []
    order = np.argsort(key)
    key, n, p = key[order], words.column("n").to_numpy()[order], words.column("p").to_numpy()[order].astype(np.float32)
    for number, bucket, block in zip(mail.column("slice").to_pylist(), mail.column("bucket").to_pylist(), mail.column("sent").to_pylist(), strict=True):
        at = np.searchsorted(key, hashes(unpack(block, np.uint8, np.int64)[0]).view(np.int64))
        rows.append((number, bucket, pack(n[at], p[at])))
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], ["slice", "bucket", "answer"])


def seat_words(words: DataFrame, tables: float) -> DataFrame:
    """words (key, n, c, lp) with the mean tables t of each word's c customers, given all tables and its spelling's lp."""

    def run(batches):
        for batch in batches:
            c, lp, key = batch.column("c").to_numpy().astype(np.float64), batch.column("lp").to_numpy() * LN10, batch.column("key").to_numpy().view(np.uint64)
            mean, t, own = np.minimum(c, 1), np.minimum(c, 1), np.flatnonzero(c > 1)
            if len(own):
                mean[own] = 0
                for step in range(1 + KEPT):  # the first draw only tells how many tables are the word's own
                    t[own] = draw(c[own], STRENGTH + DISCOUNT * np.maximum(tables - t[own], 0), lp[own], key[own], 1000 + step)
                    mean[own] += t[own] / KEPT if step else 0
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("key", "n", "c", "lp")), pa.array(mean)], ["key", "n", "c", "lp", "t"])

    return words.select("key", "n", "c", "lp").mapInArrow(run, "key long, n long, c long, lp double, t double")


def unigrams(words: DataFrame) -> DataFrame:
    """(key, n, p): log10 probability p of each word in the restaurant without context, from words (key, n, c, lp).

    Words are seated given all tables, three times, the first time with one for each word that has customers.
    """
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    tables = float(total[1])
    for _ in range(2):
        tables = float(seat_words(words, tables).agg(F.coalesce(F.sum("t"), F.lit(0.0))).first()[0])
    seated = seat_words(words, tables)
    own = F.greatest(F.col("c") - DISCOUNT * F.col("t"), F.lit(0.0)) / (STRENGTH + total[0])
    fresh = (STRENGTH + DISCOUNT * tables) / (STRENGTH + total[0])
    # a long word's spelling is less than the least double, so words without customers stay in logarithms
    p = F.when(own > 0, F.log10(own + fresh * F.pow(F.lit(10.0), "lp"))).otherwise(F.col("lp") + float(np.log10(fresh)))
    return seated.select("key", "n", p.alias("p"))


def sample_contexts(room: np.ndarray, dish: np.ndarray, c: np.ndarray, key: np.ndarray, share: np.ndarray, weight: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tables of each (room, dish) with c customers, summed over the KEPT last sweeps.

    Until tables are known, the parent's probability of a dish is its share of all tokens: of the common words (hash,
    share) as given, of others as counted here, where a room stands for weight rooms. A room has share times the tables
    that are here.
    """
    p = (np.bincount(dish, c * weight[room]) + 0.5) / ((np.bincount(room, c, len(share)) * share * weight).sum() + 1)
    names = np.zeros(len(p), np.uint64)
    names[dish] = key[:, 1]
    if len(common[0]):
        k = np.minimum(np.searchsorted(common[0], names), len(common[0]) - 1)
        p = np.where(common[0][k] == names, common[1][k], p)
    lp, pair = np.log(np.minimum(p, 1.0))[dish], mix(key[:, 0] ^ mix(key[:, 1]))
    t, sent = np.minimum(c, 1.0), np.zeros(len(c))
    for step in range(BURN_IN + KEPT):
        sweep(room, len(share), c, t, lp, pair, 600 + step, share)
        if step >= BURN_IN:
            sent += t
    return sent


ASKED = "part long, slice long, asked binary"
ANSWERED = "part long, slice long, answer binary, sent binary, hot boolean"


def answer(group: pa.Table, parts: int, hot: tuple[np.ndarray, np.ndarray], common: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """Samples the restaurants of a part and answers all slices; then the tables sent to each word, and hot contexts' tables."""
    us, sizes, names, ws, times = zip(*(unpack(x, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32) for x in group.column("asked").to_pylist()), strict=True)
    us, names = [np.cumsum(u) for u in us], [np.cumsum(w) for w in names]
    keys, place = np.unique(np.concatenate(us), return_inverse=True)
    below, dish = np.unique(np.concatenate(names), return_inverse=True)
    first = np.cumsum([0, *map(len, names)])
    pair, which = numbered(np.repeat(place, np.concatenate(sizes)) * len(below) + np.concatenate([dish[a + w] for a, w in zip(first, ws, strict=False)]))
    del ws, dish, names
    room, dish = pair // len(below), pair % len(below)
    c = np.bincount(which, np.concatenate(times), len(pair))
    del pair, times
    share, known = np.ones(len(keys)), np.zeros(len(keys), bool)
    if len(hot[0]):
        k = np.minimum(np.searchsorted(hot[0], keys), len(hot[0]) - 1)
        known = hot[0][k] == keys
        pieces = np.where(known, hot[1][k], 1).astype(np.uint64)
        # the pieces that are dealt to this part
        most = int(pieces.max()) + 1
        here = np.unique(room * most + (mix(below[dish] << _TOLD) % pieces[room]).astype(np.int64)) // most if most > 2 else np.arange(len(keys))
        share = pieces / np.bincount(here, minlength=len(keys))
    sent = sample_contexts(room, dish, c, np.stack([keys[room], below[dish]], 1), share, np.where(known, 1 / parts, 1.0), common)
    tables = np.bincount(room, sent, len(keys))
    part, rows, a, b = group.column("part")[0].as_py(), [], 0, 0
    c, sent = c.astype(np.uint32), sent.astype(np.uint32)
    for number, u, size in zip(group.column("slice").to_pylist(), us, sizes, strict=True):
        own = which[a : a + int(size.sum())]
        rows.append((part, number, pack(c[own], sent[own], tables[place[b : b + len(u)]].astype(np.uint64)), None, None))
        a, b = a + len(own), b + len(u)
    for key, total, is_hot in ((below, np.bincount(dish, sent, len(below)), False), (keys[known], tables[known], True)):
        rows.append((part, None, None, pack(steps(key), total.astype(np.uint64)), is_hot))
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 2, pa.bool_()]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in ANSWERED.split(", ")])


def sent_tables(answers: DataFrame, hot: bool) -> DataFrame:
    """(key, t): the tables of the KEPT sweeps that words (by their told bits) have in all contexts, or that hot contexts have."""

    def run(batches):
        for batch in batches:
            for block in batch.column("sent").to_pylist():
                key, t = unpack(block, np.uint64, np.uint64)
                yield pa.record_batch({"key": np.cumsum(key).view(np.int64), "t": t.view(np.int64)})

    return answers.filter(F.col("hot") == hot).select("sent").mapInArrow(run, "key long, t long").groupBy("key").agg(F.sum("t").alias("t"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is one end; repeated rows are learnt from as often as they stand there; without training
    texts all words are new and N is 0. Extra columns are ignored; an empty table gives no rows.
    """
    table = stored(sliced(docs.select("doc_id", "text")))
    buckets = max(1, -(-int(table.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]) // BUCKET_WORDS))

    def write(number: int, own: Slice):
        names, n = own.names.tobytes().split(), np.bincount(own.at[own.taught], minlength=len(own.h))
        for bucket, at in own.by_bucket(buckets):
            block = pack(np.frombuffer(b" ".join([names[i] for i in own.order[at]]), np.uint8), n[at].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([bucket], pa.int64()), pa.array([block], pa.binary())], ["slice", "bucket", "sent"])

    mail = stored(table.mapInArrow(each_slice(write), "slice long, bucket long, sent binary"))
    words = stored(mail.groupBy("bucket").applyInArrow(merged, "key long, word string, n long"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    tokens, kinds = int(total[0]), int(total[1])
    spelt = score_words(words, gram_scores(words)).select("key", "n", "lp")
    parts, most = max(1, -(-tokens // PART_TOKENS)), max(HOT, tokens // HOT_WORDS)
    # at most HOT_WORDS rows
    often = words.filter(F.col("n") > most).orderBy("key").select("key", "n").toPandas()
    order = np.argsort(often["key"].to_numpy(np.int64).view(np.uint64))
    hot = often["key"].to_numpy(np.int64).view(np.uint64)[order], -(-often["n"].to_numpy(np.int64)[order] // most)
    given = docs.sparkSession.sparkContext.broadcast(hot)
    # COMMON rows at most
    known = words.filter("n > 1").orderBy(F.desc("n"), "key").limit(COMMON).select("key", "n").toPandas()
    names = known["key"].to_numpy(np.int64).view(np.uint64) >> _TOLD
    order = np.argsort(names)
    frequent = docs.sparkSession.sparkContext.broadcast((names[order], known["n"].to_numpy(np.float64)[order] / max(1, tokens)))

    def ask(number: int, own: Slice):
        pairs = Pairs(own, parts, given.value)
        for part, at, u, size in pairs.dealt():
            names, which = np.unique(pairs.w[at], return_inverse=True)
            block = pack(steps(own.h[u]), size.astype(np.uint32), steps(own.h[names] >> _TOLD), which.astype(np.uint32), pairs.times[at])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([block], pa.binary())], ["part", "slice", "asked"])

    answers = stored(table.mapInArrow(each_slice(ask), ASKED).groupBy("part").applyInArrow(lambda group: answer(group, parts, given.value, frequent.value), ANSWERED))
    tables = {r.key & (2**64 - 1): r.t / KEPT for r in sent_tables(answers, True).collect()} if len(hot[0]) else {}
    hot_tables = docs.sparkSession.sparkContext.broadcast(np.array([tables.get(int(k), 0.0) for k in hot[0]]))
    seats = spelt.withColumn("told", F.shiftrightunsigned("key", int(_TOLD))).join(sent_tables(answers, False).withColumnRenamed("key", "told"), "told", "left")
    last = unigrams(stored(seats.select("key", "n", F.round(F.coalesce("t", F.lit(0)) / KEPT).cast("long").alias("c"), "lp")))

    def rate(texts: pa.Table, known: pa.Table) -> pa.Table:
        own = Slice(texts.column("words")[0].as_py(), texts.column("tokens")[0].as_py())
        # answers are read one by one, when they are needed
        place = {k: i for i, k in enumerate(zip(known.column("part").to_pylist(), known.column("bucket").to_pylist(), strict=True))}
        block = lambda *k: known.column("answer")[place[k]].as_py()
        n, lp = np.zeros(len(own.h), np.int64), np.zeros(len(own.h))
        for bucket, at in own.by_bucket(buckets):
            n[at], lp[at] = unpack(block(None, bucket), np.int64, np.float32)
        lp *= LN10
        pairs, keys = Pairs(own, parts, given.value), given.value[0]
        score, back_of = np.zeros(len(pairs.u)), np.zeros(len(own.h))
        if len(keys):
            k = np.minimum(np.searchsorted(keys, own.h), len(keys) - 1)
            shared, told_tables = keys[k] == own.h, hot_tables.value[k]
        for part, at, u, _ in pairs.dealt():
            c, sent, tables = unpack(block(part, None), np.uint32, np.uint32, np.uint64)
            before = pairs.u[at]
            back_of[u] = tables / KEPT
            if len(keys):
                back_of[u] = np.where(shared[u], told_tables[u], back_of[u])
            room = STRENGTH + n[before]
            with np.errstate(divide="ignore"):
                held = np.log(np.maximum(c - DISCOUNT * sent / KEPT, 0) / room)
                back = np.log((STRENGTH + DISCOUNT * back_of[before]) / room) + lp[pairs.w[at]]
            score[at] = np.logaddexp(held, back) / LN10
        base = np.log10((n + 0.5) / (tokens + 0.5 * (kinds + 1)))
        which, first = pairs.which, np.cumsum(own.sizes.astype(np.int64)) - own.sizes
        del pairs, lp, back_of
        tidy()
        cols, seen = [own.sizes.astype(np.int64)], (n > 0).astype(np.int64)
        # a run of texts that begin in the same TOKENS tokens, or one longer text
        cuts = np.append(np.flatnonzero(np.diff(first // TOKENS, prepend=-1)), len(first))
        for value, of in ((seen, own.at), (base, own.at), (score, which)):
            total = np.empty(len(first), value.dtype)
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                a, b = first[i], first[j] if j < len(first) else len(of)
                total[i:j] = np.add.reduceat(value[of[a:b]], first[i:j] - a)
            cols.append(total)
        return pa.Table.from_arrays([texts.column("doc_id").combine_chunks().flatten(), *map(pa.array, cols)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    last = last.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    words_of = mail.groupBy("bucket").cogroup(last.groupBy("bucket")).applyInArrow(told, "slice long, bucket long, answer binary")
    known = answers.filter("slice is not null").select("slice", "part", "answer").unionByName(words_of, allowMissingColumns=True)
    rated = table.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(rate, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return rated.select("doc_id", (~training_rows(5)).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
