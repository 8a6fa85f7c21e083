"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

The features of a text are its distinct n-grams of one to three words, in two readings: the words themselves (lower
case, one and two words) and their shapes (letter case, digits, marks, length, whether a word repeats the one before),
each hashed into one of ``2**BITS`` slots. A score is the sparse dot product of the weights with the square roots of the
slots' shares of all n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from .text import Words, documents, map_slices, mix, slices, stored, training_rows, unused

BITS = 18
#: The documented bound of the sample of labelled rows that the classifier is fitted on: those with the smallest hashes.
TRAIN_ROWS = 12_000
SHARDS = 6
ROUNDS = 3
#: Slots whose updates are one row.
BLOCK = 1 << 12
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.01

_CLASS = np.full(256, 4, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[0x80:] = 1


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams, and per text where its slots begin."""
    words = Words(buf, offsets, lower=True)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kinds = _CLASS[buf]
    counts = [np.add.reduceat(kinds == k, words.start)[: len(words.start)] for k in (2, 3, 4)]
    # reduceat runs on to the next word's start: white space is class 4, so take it off
    gap = np.append(words.start[1:], len(buf)) - words.end
    upper, digit, mark = counts[0], counts[1], counts[2] - gap
    size = words.end - words.start
    last = kinds[words.end - 1]
    same = np.zeros(n, np.int64)
    same[1:] = words.hash[1:] == words.hash[:-1]
    same[words.first[words.first < n]] = 0
    shape = (np.minimum(size, 12) * 3 + np.minimum(upper, 2)) * 3 + np.minimum(digit, 2)
    shape = ((shape * 4 + np.minimum(mark, 3)) * 5 + last) * 2 + same
    rough = ((np.minimum(upper, 2) * 3 + np.minimum(digit, 2)) * 4 + np.minimum(mark, 3)) * 2 + same
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))

    def grams(values: np.ndarray, k: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        h = np.full(max(0, n - k + 1), salt, np.uint64)
        for j in range(k):
            h = mix(h * np.uint64(31) + values[j : n - k + 1 + j].astype(np.uint64))
        whole = row[: n - k + 1] == row[k - 1 :] if n >= k else np.zeros(0, bool)
        return h[whole], row[: len(h)][whole]

    parts = [grams(words.hash, 1, 1), grams(words.hash, 2, 2), grams(shape, 1, 3), grams(rough, 2, 4), grams(rough, 3, 5)]
    slot = np.concatenate([p[0] for p in parts]) & np.uint64(2**BITS - 1)
    owner = np.concatenate([p[1] for p in parts])
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(offsets)))
    return slot[order].astype(np.int64), first


class Ftrl:
    """State and updates of the per-coordinate follow-the-regularised-leader rule."""

    def __init__(self, state: np.ndarray | None = None):
        self.z, self.n = state.copy() if state is not None else np.zeros((2, 2**BITS))

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        i, c = np.unique(slots, return_counts=True)
        if not len(i):
            return
        x, w = np.sqrt(c / len(slots)), self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        s = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - s * w
        self.n[i] += g * g


def updates(shares: DataFrame, given: Broadcast) -> DataFrame:
    """(block, sums) of a round: the updates that all shares make to a broadcast state, as packed z and n of each BLOCK slots."""

    def learn(batches):
        model = Ftrl(given.value)
        for batch in batches:
            for part, buf, offsets in slices(batch, "text"):
                slots, first = features(buf, offsets)
                for i, label in enumerate(part.column("label").to_pylist()):
                    model.learn(slots[first[i] : first[i + 1]], label)
        moved = np.flatnonzero((model.z != given.value[0]) | (model.n != given.value[1]))
        block, first = np.unique(moved // BLOCK, return_index=True)
        share, sent = TaskContext.get().partitionId(), []
        for own in np.split(moved, first[1:]) if len(moved) else []:
            sent.append((own % BLOCK).tobytes() + (model.z[own] - given.value[0][own]).tobytes() + (model.n[own] - given.value[1][own]).tobytes())
        yield pa.record_batch({"block": pa.array(block, pa.int64()), "share": pa.array([share] * len(sent), pa.int64()), "sent": pa.array(sent, pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros((2, BLOCK))
        # in the shares' order, so that rounding doesn't follow that of arrival
        for _, sent in sorted(zip(group.column("share").to_pylist(), group.column("sent").to_pylist(), strict=True)):
            at, (z, n) = np.frombuffer(sent, np.int64, len(sent) // 24), np.frombuffer(sent, np.float64, offset=len(sent) // 3).reshape(2, -1)
            total[0][at] += z
            total[1][at] += n
        return pa.table({"block": group.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    return shares.mapInArrow(learn, "block long, share long, sent binary").groupBy("block").applyInArrow(added, "block long, sums binary")


def train(rows: DataFrame) -> np.ndarray:
    """Weights from rows (doc_id, text, label): SHARDS tasks learn from their share, the sum of their updates begins the next round.

    Shares and the order of rows in them are those of doc_id's and the text's hashes, so weights don't follow the partitioning.
    """
    spark, state = rows.sparkSession, np.zeros((2, 2**BITS))
    deal = F.xxhash64("doc_id")
    shares = stored(rows).repartition(SHARDS, deal).sortWithinPartitions(deal, "doc_id", F.xxhash64("text")).select("text", "label")
    for _ in range(ROUNDS):
        given = spark.sparkContext.broadcast(state)
        # 2**BITS / BLOCK rows at most, whatever the input
        step = updates(shares, given).collect()
        for r in step:
            state[:, r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["sums"]).reshape(2, -1)
        given.destroy()
    return Ftrl(state).weights(np.arange(2**BITS))


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_ROWS) -> DataFrame:
    """Up to limit labelled rows of the training folds, chosen by a hash of doc_id."""
    known = labels.select("doc_id", F.col(label).alias("label")).filter(F.col("label").isin(0, 1)).filter(training_rows(3))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], name: str) -> DataFrame:
    """The columns keep of docs, whatever their names, and the score of text as name."""
    given = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    own = [f"_keep{k}" for k in range(len(keep))]
    wanted = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True)), F.col("text").alias("text"))

    def run(rows, buf, offsets):
        slots, first = features(buf, offsets)
        w = given.value
        out = np.zeros(rows.num_rows)
        for i in range(rows.num_rows):
            own_slots = slots[first[i] : first[i + 1]]
            if len(own_slots):
                at, c = np.unique(own_slots, return_counts=True)
                out[i] = w[at] @ np.sqrt(c / len(own_slots))
        return pa.RecordBatch.from_arrays([*(rows.column(o) for o in own), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], [*own, "score"])

    kinds = dict(wanted.dtypes)
    found = wanted.mapInArrow(map_slices(run, "text"), ", ".join([*(f"{o} {kinds[o]}" for o in own), "score double"]))
    return found.select(*(F.col(o).alias(c) for c, o in zip(keep, own, strict=True)), F.col("score").alias(name))


def good_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of docs that are predicted to have label 1, with their columns, which may have any names."""
    name = unused(docs, "score")
    return score(docs, train(sample(docs, labels, label)), docs.columns, name).filter(F.col(name) >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    A null or empty text has no n-grams and scores 0.5. Labels that are null or neither 0 nor 1 are not learnt from; of
    repeated labels the smallest counts; without labels all score 0.5. Repeated rows score alike. Extra columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    out = score(docs, train(sample(docs, labels, label)), ["doc_id"], "score")
    return out.select("doc_id", (~training_rows(3)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
