"""N-gram Jaccard join: which documents share at least 80 % of their five-word shingles, and what they connect.

The join is a blocked sparse product of the document-by-shingle incidence matrix with its transpose.

1. Documents with equal sets are one row of the matrix, a node; the one with the smallest doc_id stands for them.
2. Only the columns that a row needs are multiplied: of two linked rows, the first ``n - ceil(0.8 n) + 1`` shingles of
   each, in any order that holds for all rows, share one. The order puts shingles known to be frequent last; that list
   has a fixed size and only saves work.
3. A column's rows (its bucket) are all multiplied with one pivot row, that of the smallest doc_id, but for pairs that sizes
   or 1024-bit parity sketches (whose Hamming distance never exceeds the symmetric difference) put below the bound.
   Overlap counts are accumulated over whole sets in blocks of at most ``BLOCK`` rows for a pivot. Jaccard distance is a metric, so most
   other pairs of a bucket are settled: rows of one component need no further link.
4. The pairs left are those of different components in one bucket, block by block of it: sizes in one band or the next.
   Their overlap is accumulated over the prefixes, and those that sizes, sketches, the distances to the pivot or this count put below the bound are discarded. The others
   are counted exactly.

Large groups of near copies thus cost one pair a member, not all pairs, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as S

from .components import components
from .text import Words, cut, documents, lists, map_slices, mix, range_hash, semi_join, shingle_sets, slices, stored, sums

NUM, DEN = 80, 100
BLOCK = 256
SKETCH = 16
#: Groups of equal sets of more rows than HOT_GROUP, and than a LARGE-th of all rows, are told by broadcast: LARGE groups at most.
HOT_GROUP, LARGE = 300, 10_000
SET = ["k1", "k2", "n"]
#: Frequent shingles that the order may put last: 2**20 of 8 bytes, 8 MB, whatever the input.
HOT = 1 << 20
#: Shingles that a task counts at a time to find frequent ones, and the count from which it reports one.
COUNTED, REPORTED = 4_000_000, 3


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Up to HOT shingles that occur most, as far as tasks notice; a hint for the order only."""

    def report(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        often = counts >= REPORTED
        return pa.record_batch({"key": pa.array(values[often].view(np.int64)), "n": pa.array(counts[often], pa.int64())})

    def run(batches):
        parts, size, seen = [], 0, set()
        for batch in batches:
            for _, buf, offsets in slices(batch, "text"):
                words = Words(buf, offsets, lower=True)
                text = range_hash(sums(words.hash), words.first[:-1], words.first[1:]).tolist()
                fresh = []  # copies would only fill the list with their own shingles
                for h in text:
                    fresh.append(h not in seen)
                    seen.add(h)
                at = np.arange(max(0, len(words) - 4))
                row = np.searchsorted(words.first, at, "right") - 1
                whole = (row == np.searchsorted(words.first, at + 4, "right") - 1) & np.array(fresh)[row]
                parts.append(words.grams(5)[whole])
                size += len(parts[-1])
                if size >= COUNTED:
                    yield report(parts)
                    parts, size, seen = [], 0, set()
        if parts:
            yield report(parts)

    counts = cut(docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n >= 8"))
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()
    least, total = None, 0
    for level in levels:
        total += level["count"]
        if total > HOT:
            break
        least = level["level"]
    if least is None:
        return np.zeros(0, np.uint64)
    found = counts.filter(F.floor(F.log2("n")) >= least).select("key").toPandas()["key"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def signatures(docs: DataFrame, hot: np.ndarray, carry: list[str]) -> DataFrame:
    """Per row: its columns but the text, n (set size), k1 and k2 (the set's 128-bit hash), the sketch's longs b0 ..., and the prefix."""
    given, kept = docs.sparkSession.sparkContext.broadcast(hot), ["doc_id", "t", *carry]

    def run(rows, buf, offsets):
        sets = list(shingle_sets(Words(buf, offsets, lower=True)))
        hot, n = given.value, np.array([len(s) for s in sets])
        prefixes, sketch, k1, k2 = [], np.zeros((len(sets), SKETCH), np.uint64), np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
        for i, s in enumerate(sets):
            if len(s):
                last = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
                size = len(s) - -(-NUM * len(s) // DEN) + 1
                prefixes.append(np.concatenate([s[~last][:size], s[last][: max(0, size - int((~last).sum()))]]))
                m = mix(s + np.uint64(0x1234567))
                k1[i], k2[i] = m.sum(), mix(m).sum()
                bits = np.bincount((m & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                sketch[i] = np.packbits(bits.astype(np.uint8)).view(np.uint64)
            else:
                prefixes.append(s)
        cols = {c: rows.column(c) for c in kept} | {"n": pa.array(n, pa.int64()), "k1": pa.array(k1.view(np.int64)), "k2": pa.array(k2.view(np.int64))}
        cols |= {f"b{j}": pa.array(np.ascontiguousarray(sketch[:, j]).view(np.int64)) for j in range(SKETCH)}
        return pa.RecordBatch.from_pydict(cols | {"prefix": lists([p.view(np.int64) for p in prefixes], pa.int64())})

    longs = [S.StructField(c, S.LongType()) for c in ("n", "k1", "k2", *(f"b{j}" for j in range(SKETCH)))]
    kind = S.StructType([*(docs.schema[c] for c in kept), *longs, S.StructField("prefix", S.ArrayType(S.LongType()))])
    return docs.select(*kept, "text").mapInArrow(map_slices(run, "text"), kind)


def overlaps(docs: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, both) for the distinct pairs (a, b) of nodes, by sets of whole texts; pairs is a frame that was cut().

    A node's text is that of its row, found by hashes of doc_id and text.
    """
    loads = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    members = pairs.join(loads, "a").select(F.col("b").alias("node"), F.struct("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.lit(1).alias("role")).alias("to"))
    pivots = loads.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "a")
    pivots = pivots.select("node", F.struct("a", "block", F.lit(0).alias("role")).alias("to"))
    attends = members.union(pivots).groupBy("node").agg(F.collect_list("to").alias("to"))
    attends = cut(attends.join(groups.select("node", F.xxhash64("doc_id").alias("d"), "t"), "node"))
    texts = docs.select(F.xxhash64("doc_id").alias("d"), "t", "text")
    texts = semi_join(texts, cut(attends.select("d", "t")), ["d", "t"]).dropDuplicates(["d", "t"]).join(attends, ["d", "t"])

    # whole texts are dealt out: compressed, they are a third of their sets
    dealt = texts.select("node", "text", F.explode("to").alias("to")).select("to.a", "to.block", "to.role", F.col("node").alias("b"), "text")
    dealt = dealt.repartition("a", "block").sortWithinPartitions("a", "block", "role")

    def multiply(batches):
        pivot, of = None, None
        for batch in batches:
            for rows, buf, offsets in slices(batch, "text"):
                a, role, b = (rows.column(c).to_pylist() for c in ("a", "role", "b"))
                out = []
                for i, own in enumerate(shingle_sets(Words(buf, offsets, lower=True))):
                    if role[i] == 0:
                        pivot, of = own, a[i]
                    elif of == a[i] and len(own) and len(pivot):
                        both = int((pivot[np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)] == own).sum())
                        out.append((of, b[i], len(pivot), len(own), both))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "n_a", "n_b", "both"])

    return dealt.mapInArrow(multiply, "a long, b long, n_a long, n_b long, both long")


#: Bounds from sizes: of the smaller set on the larger, and of the symmetric difference, which the sketches' distance
#: never exceeds.
POSSIBLE = (
    f"({DEN} * least(x.n, y.n) >= {NUM} * greatest(x.n, y.n) and {DEN - NUM} * (x.n + y.n) >= {DEN + NUM} * ("
    + " + ".join(f"bit_count(x.b{j} ^ y.b{j})" for j in range(SKETCH))
    + "))"
)
LINKED = f"{DEN} * both >= {NUM} * (n_a + n_b - both)"


def told(rows: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """rows of sets with their group's columns; those of the largest groups, LARGE at most, learn them by broadcast."""
    least = max(HOT_GROUP, rows.count() // LARGE)
    large = cut(groups.filter(F.col("copies") > least).select(*SET, *columns, F.lit(True).alias("_large")))
    rows = rows.join(F.broadcast(large), SET, "left")
    rest = rows.filter("_large is null").drop(*columns).join(groups.filter(F.col("copies") <= least).select(*SET, *columns), SET)
    return rows.filter("_large").unionByName(rest).drop("_large")


def clustered(docs: DataFrame, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per row of docs: doc_id, the columns to carry, n_shingles, component_id, and kept: true for one row of each component.

    The one that is kept has the smallest doc_id; a null doc_id comes last.
    """
    docs = docs.select("doc_id", *carry, "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    sig = stored(signatures(docs, frequent_shingles(docs), carry).withColumn("row", F.monotonically_increasing_id()))
    filled = sig.filter("n > 0")
    # a node is a distinct set; its first row stands for it
    groups = filled.groupBy(*SET).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "t")).alias("rep"), F.count("*").alias("copies"))
    groups = cut(groups.select(*SET, "copies", "rep.doc_id", F.col("rep.row").alias("node"), "rep.t"))
    copies = cut(told(filled.select("row", *SET), groups.filter("copies > 1"), ["node"]).filter("row != node").select("row"))
    alone = semi_join(filled, copies, "row", "left_anti").withColumnRenamed("row", "node")

    keys = alone.select(F.explode("prefix").alias("key"), "node", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node").alias("order"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("order").alias("pivot")).filter("size > 1").select("key", F.col("pivot.node").alias("pivot"))
    members = stored(keys.drop("order").join(buckets, "key").filter("node != pivot"))
    profiles = cut(alone.select("node", "n", *(f"b{j}" for j in range(SKETCH))))
    star = members.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = star.alias("p").join(profiles.alias("x"), F.expr("p.a = x.node")).join(profiles.alias("y"), F.expr("p.b = y.node")).filter(POSSIBLE).select("a", "b")
    star = cut(overlaps(docs, groups, cut(star)))
    links = star.filter(LINKED).select("a", "b")
    found = components(links)

    # buckets with rows of more than one component
    rows = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = rows.join(found.select(F.col("node").alias("pivot"), F.col("component").alias("home")), "pivot", "left").withColumn("home", F.coalesce("home", "pivot"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.sum((F.col("component") != F.col("home")).cast("long")).alias("strangers"))
    mixed = mixed.filter("least != most and strangers > 0").select("key")
    near = star.select(F.col("a").alias("pivot"), F.col("b").alias("node"), (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("far"))
    rows = cut(rows.join(mixed, "key", "left_semi").join(near, ["pivot", "node"], "left").join(profiles, "node"))
    # sets whose sizes are further apart than the bound are never paired: a bucket is joined band by band
    band = F.floor(F.log("n") / float(np.log(DEN / NUM)))
    left, right = rows.filter("component != home").withColumn("band", F.explode(F.array(band - 1, band, band + 1))), rows.withColumn("band", band)
    rest = left.alias("x").join(
        right.alias("y"),
        F.expr(
            f"x.key = y.key and x.band = y.band and x.component != y.component and (x.node < y.node or y.component = y.home)"
            f" and {POSSIBLE} and coalesce(abs(x.far - y.far) <= {1 - NUM / DEN + 1e-9}, true)"
        ),
    )
    # accumulated over the prefixes, the overlap is known but for what is behind the prefix that ends first
    rest = rest.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b"), F.expr("x.n + y.n").alias("n"), F.expr("greatest(x.n, y.n)").alias("longer"))
    rest = rest.groupBy("a", "b", "n", "longer").agg(F.count("*").alias("shared"))
    rest = rest.filter(f"{DEN + NUM} * (shared + ({NUM} * longer + {DEN - 1}) div {DEN} - 1) >= {NUM} * n")
    rest = cut(rest.select("a", "b"))
    if not rest.isEmpty():
        found = components(cut(links.union(overlaps(docs, groups, rest).filter(LINKED).select("a", "b"))))

    firsts = found.join(groups.select("node", "doc_id"), "node").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("first"))
    of = found.join(firsts, "component").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.node").alias("keep"), F.lit(True).alias("linked"))
    groups = groups.join(of, "node", "left")
    groups = cut(groups.select(*SET, "copies", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("keep", "node").alias("keep")))
    out = told(filled.select("doc_id", *carry, "row", *SET), groups, ["component_id", "keep"])
    out = out.select("doc_id", *carry, F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("row") == F.col("keep")).alias("kept"))
    # without words a text is its own component
    return out.unionByName(sig.filter("n = 0").select("doc_id", *carry, F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z). A text of one to four words has one shingle; a null text or one without words has none
    and is its own component, also if doc_id is null. Rows that repeat a doc_id are documents of their own, with the same
    text or another; a component's id is the smallest doc_id in it. Extra columns are ignored; an empty table gives no rows.
    """
    return clustered(docs).select("doc_id", "n_shingles", "component_id")


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
