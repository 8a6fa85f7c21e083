"""SentencePiece encoding and decoding as a unigram model, with a max-plus parallel scan of giant documents.

A document of more than ``GIANT`` bytes is split into chunks of ``CHUNK`` that are segmented in parallel. A state at a cut is how far
a token reaches over it. Each chunk yields the matrix of best scores from the states at its begin to those at its end;
neighbouring matrices are multiplied with each other, ``FAN`` at a time, level by level up to the document's, and the products
then carry the scores of the states at each cut down again. A chunk so knows, for each state it may be left in, where its best
path entered; these maps are combined from the end on, and each chunk is backtraced on its own. Other documents are a
chunk of their own with one state at either end; their distinct pre-tokens are segmented once each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .counts import VOCABULARY, pieces, shipped
from .lattice import NEVER, SPACE, Tokens, backtraces, compose, decode as decode_ids, stops, transfers
from .text import cut, documents, lists, map_slices

GIANT, CHUNK = 64 << 10, 8 << 10
#: Chunks that a task takes in step, and matrices that are multiplied at a time.
STACK, FAN = 32, 32
SLICE_BYTES = 2 << 20
#: Bytes beyond a chunk that its row carries, as many as the longest piece has at most.
AHEAD = 64
#: The most partitions that chunks are dealt to.
PARTS = 4096


def chunks(giants: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows (uid, at, of, part): the documents' bytes in chunks, with AHEAD bytes of the next; and the most of a document."""
    raw = F.col("text").cast("binary")
    rows = giants.select("uid", raw.alias("raw"), F.ceil(F.octet_length("text") / size).alias("of"))
    total, most = rows.agg(F.coalesce(F.sum("of"), F.lit(0)), F.coalesce(F.max("of"), F.lit(0))).first()
    rows = rows.select("uid", "of", "raw", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("at"))
    rows = rows.select("uid", "at", "of", F.substring("raw", (F.col("at") * size + 1).cast("int"), F.lit(size + AHEAD)).alias("part"))
    return rows.repartition(int(min(PARTS, max(1, -(-total // STACK)))), "uid", "at"), int(most)


def _chunk(row: dict, size: int) -> tuple[np.ndarray, int]:
    raw = np.frombuffer(row["part"], np.uint8)
    raw = np.where(raw == 32, np.uint8(SPACE), raw)
    end = len(raw) if row["at"] == row["of"] - 1 else size
    return (np.insert(raw, 0, SPACE), end + 1) if row["at"] == 0 else (raw, end)


def _stacks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, STACK):
            yield batch.slice(at, STACK).to_pylist()


def _rows(kinds: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in kinds.split(", ")]
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for (_, k), c in zip(fields, zip(*rows, strict=True), strict=True)], [n for n, _ in fields])


def multiplied(level: DataFrame, model: Broadcast) -> DataFrame:
    """(uid, at, matrix) of each FAN neighbours' product."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                width, product = pieces(model.value).longest, None
                for step in row["steps"]:
                    own = np.frombuffer(step["matrix"]).reshape(width, width)
                    product = own if product is None else compose(product, own)
                yield _rows("uid string, at long, matrix binary", [(row["uid"], row["at"], product.tobytes())])

    return _families(level).mapInArrow(run, "uid string, at long, matrix binary")


def _families(level: DataFrame) -> DataFrame:
    steps = F.sort_array(F.collect_list(F.struct("at", "matrix"))).alias("steps")
    return level.groupBy("uid", F.floor(F.col("at") / FAN).alias("up")).agg(steps).withColumnRenamed("up", "at")


def handed_down(above: DataFrame, level: DataFrame, model: Broadcast) -> DataFrame:
    """(uid, at, entry) of a level, the best scores of the states at each part's begin, from those of the level above."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                entry, out = np.frombuffer(row["entry"]), []
                for step in row["steps"]:
                    out.append((row["uid"], step["at"], entry.tobytes()))
                    entry = (entry[:, None] + np.frombuffer(step["matrix"]).reshape(len(entry), -1)).max(0)
                yield _rows("uid string, at long, entry binary", out)

    return _families(level).join(above, ["uid", "at"]).mapInArrow(run, "uid string, at long, entry binary")


def encode_giants(giants: DataFrame, model: Broadcast, size: int) -> DataFrame:
    """(uid, ids) of the distinct rows (uid, text)."""
    parts, most = chunks(giants, size)

    def matrices(batches):
        for rows in _stacks(batches):
            out = transfers(pieces(model.value), [_chunk(r, size) for r in rows])
            yield _rows("uid string, at long, matrix binary", [(r["uid"], r["at"], np.ascontiguousarray(m).tobytes()) for r, m in zip(rows, out, strict=True)])

    levels = [cut(parts.mapInArrow(matrices, "uid string, at long, matrix binary"))]
    while most > FAN:
        levels.append(cut(multiplied(levels[-1], model)))
        most = -(-most // FAN)
    width = pieces(model.value).longest
    begin = np.where(np.arange(width) == 0, 0.0, NEVER)
    entry = levels[-1].select("uid", F.lit(0).cast("long").alias("at"), F.lit(bytearray(begin.tobytes())).alias("entry")).distinct()
    for level in reversed(levels):
        entry = cut(handed_down(entry, level, model))

    def maps(batches):
        for rows in _stacks(batches):
            out = stops(pieces(model.value), [_chunk(r, size) for r in rows], [np.frombuffer(r["entry"]) for r in rows])
            yield _rows("uid string, at long, map binary", [(r["uid"], r["at"], m.tobytes()) for r, m in zip(rows, out, strict=True)])

    def leaves(batches):
        # 25 bytes a chunk: 7 MB for the longest text that a row can hold
        for batch in batches:
            for row in batch.to_pylist():
                state, out = 0, []
                for step in reversed(row["steps"]):
                    out.append((row["uid"], step["at"], state))
                    state = step["map"][state]
                yield _rows("uid string, at long, leave int", out)

    def traced(batches):
        for rows in _stacks(batches):
            out = backtraces(pieces(model.value), [_chunk(r, size) for r in rows], [np.frombuffer(r["entry"]) for r in rows], [r["leave"] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r["uid"] for r in rows]), pa.array([r["at"] for r in rows], pa.int64()), lists(out, pa.int32())], ["uid", "at", "ids"])

    known = parts.join(entry, ["uid", "at"])
    path = known.mapInArrow(maps, "uid string, at long, map binary").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "map"))).alias("steps"))
    path = cut(path.mapInArrow(leaves, "uid string, at long, leave int"))
    out = known.join(path, ["uid", "at"]).mapInArrow(traced, "uid string, at long, ids array<int>")
    return cut(out.groupBy("uid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda c: c.ids)).alias("ids")))


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, giant: int = GIANT, chunk: int = CHUNK, check: bool = False) -> DataFrame:
    """The columns keep of docs and ids array<int>; with check also round_trip, whether ids decode to the text.

    A null or empty text has no ids; repeated rows are encoded alike; equal best segmentations go to the longer last
    piece. Columns of docs may have any names; a kept one called ids (or round_trip, with check) gives way to the result.
    """
    keep = [c for c in dict.fromkeys(keep) if c != "ids" and not (check and c == "round_trip")]
    own = [f"_keep{k}" for k in range(len(keep))]
    model = shipped(docs.sparkSession, vocabulary)
    rows = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True)), F.col("text").alias("text"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{o} {kinds[o]}" for o in own), "ids array<int>", *(["round_trip boolean"] if check else [])])
    names = [*own, "ids", *(["round_trip"] if check else [])]

    def run(rows, buf, offsets):
        model_pieces = pieces(model.value)
        flat, first = Tokens(model_pieces, buf, offsets).ids()
        ids = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, pa.int32()))
        same = [pa.array(restored(model_pieces, flat, first, buf, offsets))] if check else []
        return pa.RecordBatch.from_arrays([*(rows.column(o) for o in own), ids, *same], names)

    is_giant = F.coalesce(F.octet_length("text") > giant, F.lit(False))
    normal = rows.filter(~is_giant).mapInArrow(map_slices(run, "text", SLICE_BYTES), schema)
    giants = rows.filter(is_giant).withColumn("uid", F.sha2(F.col("text").cast("binary"), 256))
    scanned = giants.join(encode_giants(giants.select("uid", "text").dropDuplicates(["uid"]), model, chunk), "uid")

    def rejoined(batches):
        for batch in (part for whole in batches for part in _few_ids(whole)):
            raw, offsets = decoded(model.value, batch.column("ids"))
            text = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            same = [raw[a:b].tobytes() == t for a, b, t in zip(offsets[:-1], offsets[1:], text, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*own, "ids"]), pa.array(same)], names)

    scanned = scanned.select(*own, "ids", "text").mapInArrow(rejoined, schema) if check else scanned.select(*own, "ids")
    out = normal.union(scanned)
    return out.select(*(F.col(o).alias(c) for c, o in zip(keep, own, strict=True)), *names[len(own) :])


def restored(model: object, flat: np.ndarray, first: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts their ids decode to."""
    raw, ends = decode_ids(model, flat, first)
    if len(raw) == len(buf) and np.array_equal(ends, offsets) and np.array_equal(raw, buf):
        return np.ones(len(offsets) - 1, bool)
    return np.array([np.array_equal(raw[a:b], buf[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)], bool)


def _few_ids(batch: pa.RecordBatch, limit: int = 1 << 18):
    """Runs of rows with up to limit ids, one row at least."""
    total = np.cumsum(pc.fill_null(batch.column("ids").value_lengths(), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def decoded(model: bytes, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of a column of ids."""
    n = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    return decode_ids(pieces(model), ids, np.concatenate([[0], np.cumsum(n)]))


def decode(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns keep of rows and the text of their ids; null ids are an empty text, a kept column text gives way."""
    keep = [c for c in dict.fromkeys(keep) if c != "text"]
    own, model = [f"_keep{k}" for k in range(len(keep))], shipped(rows.sparkSession, vocabulary)
    rows = rows.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(keep, own, strict=True)), F.col("ids").alias("ids"))
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in (part for whole in batches for part in _few_ids(whole)):
            raw, offsets = decoded(model.value, batch.column("ids"))
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
            yield pa.RecordBatch.from_arrays([*(batch.column(o) for o in own), text.cast(pa.binary()).cast(pa.string())], [*own, "text"])

    out = rows.mapInArrow(run, ", ".join([*(f"{o} {kinds[o]}" for o in own), "text string"]))
    return out.select(*(F.col(o).alias(c) for c, o in zip(keep, own, strict=True)), "text")


def op10_sentencepiece_encoding_decoding(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the text decoded from ids is the document's."""
    out = encode(documents(spark, sf_dir), check=True)
    return out.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip")
