"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

Texts are equal when identical after white space is deleted. Each text is cut where its content says so, each chunk
gets an identifier, and texts are compared by their ordered identifier lists, so texts themselves are never shuffled.
An identifier is the chunk's 64-bit fingerprint, verified: the dictionary of (fingerprint, SHA-256) pairs is checked
for fingerprints that stand for two contents, and chunks of such a fingerprint take their SHA-256 into the identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .text import WORD_SPACE, cut, documents

#: A chunk ends after one of these letter pairs, but not before LEAST characters and not after MOST.
LEAST, MOST = 512, 8192
BOUNDARY = "[aeio][nrst][^a-z]|[0-9][,.;]"
#: Groups of more rows than HOT, and than a LARGE-th of all rows, are told their verdict by broadcast: LARGE groups at most.
HOT, LARGE = 300, 10_000
CHUNK = f"(?s).{{{LEAST},{MOST}}}?(?:{BOUNDARY})|.{{1,{MOST}}}"


def recipes(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Per row: doc_id, n_chars, text_sha256, the columns to carry, and the fingerprints and digests of its chunks in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = docs.select("doc_id", *carry, F.char_length(text).alias("n_chars"), F.regexp_replace(text, WORD_SPACE, "").alias("norm"))
    return norm.select(
        "doc_id",
        *carry,
        "n_chars",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.transform(
            F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)),
            lambda c: F.struct(F.xxhash64(c).alias("fp"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("sha")),
        ).alias("chunks"),
    )


def with_identifiers(rows: DataFrame) -> DataFrame:
    """Replaces chunks by ids, the ordered list of verified chunk identifiers."""
    seen = rows.select(F.explode("chunks").alias("c")).select("c.fp", "c.sha").groupBy("fp", "sha").count()
    clashes = seen.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp")
    plain = rows.withColumn("ids", F.transform("chunks", lambda c: F.struct(c.fp.alias("fp"), F.lit(None).cast("binary").alias("sha"))))
    if clashes.isEmpty():
        return plain.drop("chunks")
    # a fingerprint with two contents: the rows that hold it get their lists from the dictionary
    hit = rows.withColumn("row", F.monotonically_increasing_id())
    hit = cut(hit)
    parts = hit.select("row", F.posexplode("chunks").alias("at", "c")).select("row", "at", "c.fp", "c.sha")
    marked = parts.join(clashes.withColumn("clash", F.lit(True)), "fp", "left")
    ids = marked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "fp", F.when(F.col("clash"), F.col("sha")).alias("sha")))).alias("ids"))
    ids = ids.select("row", F.transform("ids", lambda c: F.struct(c.fp.alias("fp"), c.sha.alias("sha"))).alias("ids"))
    empty = F.array().cast("array<struct<fp:bigint,sha:binary>>")
    return hit.join(ids, "row", "left").withColumn("ids", F.coalesce("ids", empty)).drop("row", "chunks")


def exact_dedup(docs: DataFrame, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars, and the columns to carry.

    Of equal texts the row with the most code points stays, then the one with the smallest doc_id. A null text counts
    as empty, and empty texts are equal. Rows that repeat a doc_id with the same text share the verdict of that doc_id,
    unless columns to carry tell rows apart: then the first row by these stays. A null doc_id loses against any other.
    Extra columns of docs are ignored; an empty table gives no rows. Groups are summed before they are shuffled; the
    verdicts of the largest ones, LARGE at most, go to their rows by broadcast.
    """
    rows = cut(with_identifiers(cut(recipes(docs.select("doc_id", "text", *carry), carry))))
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("d"), *carry))
    groups = rows.groupBy("ids").agg(best.alias("best"), F.count("*").alias("group_size"))
    least = max(HOT, rows.count() // LARGE)
    large = cut(groups.filter(F.col("group_size") > least))
    told = rows.join(F.broadcast(large), "ids", "left")
    rest = told.filter("group_size is null").drop("best", "group_size").join(groups.filter(F.col("group_size") <= least), "ids")
    out = told.filter("group_size is not null").unionByName(rest)
    kept = F.col("doc_id").eqNullSafe(F.col("best.d"))
    for c in carry:
        kept = kept & F.col(c).eqNullSafe(F.col(f"best.{c}"))
    return out.select("doc_id", F.col("best.d").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "n_chars", *carry)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_chars")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
