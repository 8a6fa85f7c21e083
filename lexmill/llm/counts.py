"""Token counts by trie-shared dynamic programming.

Each task inserts the distinct pre-tokens of its texts in a trie and computes the unigram forward score of a shared
prefix once; terminal nodes store the token count that every occurrence then takes. Nothing is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .lattice import Pieces, Tokens
from .text import documents, map_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 2 << 20
_loaded: dict[bytes, Pieces] = {}


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file's bytes (half a megabyte), read on the driver and sent along: workers need no file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def pieces(model: str | bytes) -> Pieces:
    """The vocabulary of a file or of a file's bytes, made once in each Python worker."""
    if isinstance(model, str):
        with open(model, "rb") as f:
            model = f.read()
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Pieces(model)
    return _loaded[model]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens, score (log probability of the best segmentation).

    A null or empty text has no tokens and scores 0; equal best segmentations go to the longer last piece; repeated
    rows count alike, and extra columns are ignored.
    """

    model = shipped(docs.sparkSession, vocabulary)

    def run(rows, buf, offsets):
        t = Tokens(pieces(model.value), buf, offsets)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(t.n_pretokens, pa.int64()), pa.array(t.per_text(t.count), pa.int64()), pa.array(t.per_text(t.score), pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(map_slices(run, "text", slice_bytes), "doc_id long, n_pretokens long, n_tokens long, score double")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
