"""Implicit joins and duplicate rules: neighbours, best topic, quotes, anti-copy, near duplicates, set algebra."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from lexmill.functions import text as T
from lexmill.functions.order import placed
from lexmill.functions.shared import cut, few_or_all
from lexmill.plans.registry import query, read

_FOLD = "strip_accents(translate(lower({}), 'ª²³µ¹ºđſẛ', 'a23μ1odss'))"
_TOKENS = "regexp_extract_all(" + _FOLD + ", '[a-z0-9]{{3,}}')"


def token_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, n): the distinct tokens of each row, and how many it has."""
    sets = df.select(key, T.token_set(F.col(text)).alias("s"))
    return sets.select(key, F.size("s").cast("long").alias("n"), F.explode("s").alias("token"))


def shared_tokens(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n_a, n_b, shared_n) of all pairs that share a token, through an inverted index."""
    x, y = token_rows(left, a).withColumnRenamed("n", "n_a"), token_rows(right, b).withColumnRenamed("n", "n_b")
    return x.join(y, "token").groupBy(a, b).agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.count("*").alias("shared_n"))


#: Looked-up tokens that covering_pairs() sends to all tasks.
BROADCAST_KEYS = 50_000


def covering_pairs(left: DataFrame, right: DataFrame, a: str, b: str, need: str) -> DataFrame:
    """(a, b, n_a, n_b, shared_n) of the pairs that share need tokens of right's n_b at least.

    Such a pair shares one of any n_b - need + 1 tokens of b. Only those that fewest of left's rows have are looked up, so
    common words never meet. If they are counted to be few, left's rows are told which of them they have and nothing of
    left is shuffled; else tokens are joined. The pairs found are counted over whole sets.
    """
    x = left.select(a, T.token_set(F.col("text")).alias("s")).filter(F.size("s") > 0)
    y = cut(right.select(b, T.token_set(F.col("text")).alias("t")).withColumn("n_b", F.size("t").cast("long")).filter("n_b > 0"))
    each = y.select(b, "n_b", F.explode("t").alias("token"))
    tokens = cut(each.select("token").distinct())
    df = x.select(F.explode("s").alias("token")).join(few_or_all(tokens), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy(b).orderBy(F.coalesce("df", F.lit(0)), "token"))
    keys = cut(each.join(df, "token", "left").withColumn("place", place).filter(F.col("place") <= F.col("n_b") - F.expr(need) + 1).select(b, "token"))
    some = keys.select("token").distinct().limit(BROADCAST_KEYS + 1).collect()
    if len(some) <= BROADCAST_KEYS:
        # tokens are letters and digits only
        known = F.split(F.lit(" ".join(sorted(r[0] for r in some))), " ")
        hits = x.withColumn("token", F.explode(F.array_intersect("s", known)))
        found = hits.join(few_or_all(keys), "token").join(few_or_all(y), b).select(a, b, F.size("s").cast("long").alias("n_a"), "n_b", T.overlap(F.col("s"), F.col("t")).alias("shared_n"))
        return found.filter(f"shared_n >= {need}").distinct()
    found = x.select(a, F.explode("s").alias("token")).join(keys, "token").select(a, b).distinct()
    return found.join(x, a).join(y, b).select(a, b, F.size("s").cast("long").alias("n_a"), "n_b", T.overlap(F.col("s"), F.col("t")).alias("shared_n")).filter(f"shared_n >= {need}")


_PAIRS = f"""WITH x AS (SELECT doc_id, list_distinct({_TOKENS.format("text")}) AS s FROM documents), y AS (SELECT item_id, list_distinct({_TOKENS.format("text")}) AS t FROM benchmark),
xs AS (SELECT doc_id, len(s) AS n_a, unnest(s) AS token FROM x), ys AS (SELECT item_id, len(t) AS n_b, unnest(t) AS token FROM y),
p AS (SELECT doc_id, item_id, any_value(n_a) AS n_a, any_value(n_b) AS n_b, count(*) AS shared_n FROM xs JOIN ys USING (token) GROUP BY doc_id, item_id)"""


@query(_PAIRS + " SELECT item_id, doc_id, shared_n, n_b FROM p WHERE shared_n * 20 >= n_b QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared_n DESC, doc_id) = 1")
def topic_overlap_best(spark, sf_dir):
    """For each topic the unit with the largest share of its words, from 5 % on; the first wins ties."""
    pairs = shared_tokens(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    best = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("shared_n"), "doc_id"))
    return pairs.filter("shared_n * 20 >= n_b").withColumn("k", best).filter("k = 1").select("item_id", "doc_id", "shared_n", "n_b")


@query(
    _PAIRS
    + rf""", c AS (SELECT p.*, d.text AS t, b.text AS q FROM p JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE shared_n * 100 >= 48 * (n_a + n_b - shared_n) OR shared_n * 10 >= 7 * n_b)
SELECT doc_id, item_id, shared_n, n_a, n_b FROM c"""
)
def anti_copy_guard(spark, sf_dir):
    """Units that copy an item: Jaccard from 0.48 on, or 0.7 of the item's words."""
    pairs = covering_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id", "(n_b * 48 + 99) div 100")
    return pairs.filter("shared_n * 100 >= 48 * (n_a + n_b - shared_n) or shared_n * 10 >= 7 * n_b").select("doc_id", "item_id", "shared_n", "n_a", "n_b")


#: Words of items (with each item's share of them) that longest_runs() may broadcast, and places of items looked at at once.
BROADCAST_WORDS, HITS = 1_000_000, 1 << 20


def longest_runs(docs: DataFrame, items: DataFrame, limit: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, longest_run) of all units with words: units' places meet items at equal words; runs are gapless places.

    Items' words are broadcast only if they are counted to be few enough.
    """
    order = docs.select("doc_id", T.tokens(F.col("text")).alias("order")).filter(F.size("order") > 0)
    words = token_rows(items, "item_id").select("item_id", "token")
    if words.limit(limit + 1).count() <= limit:
        rows = words.toPandas().sort_values("token")
        token, first = np.unique(rows["token"].to_numpy(str), return_index=True)
        # items from 0 on, and where each word's items begin
        owner = pd.factorize(rows["item_id"])[0]
        given = docs.sparkSession.sparkContext.broadcast((token.tolist(), np.append(first, len(rows)), owner))
        return order.mapInArrow(lambda batches: _runs(batches, *given.value), "doc_id long, longest_run long")
    places = order.select("doc_id", F.posexplode("order").alias("pos", "token"))
    island = F.col("pos") - F.row_number().over(W.partitionBy("doc_id", "item_id").orderBy("pos"))
    runs = places.join(words, "token").select("doc_id", "item_id", island.alias("island")).groupBy("doc_id", "item_id", "island").count()
    best = runs.groupBy("doc_id").agg(F.max("count").alias("n"))
    return order.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("longest_run"))


def _runs(batches, token: list, first: np.ndarray, owner: np.ndarray):
    known, items = pa.array(token, pa.string()), int(owner.max()) + 1 if len(owner) else 0
    for batch in batches:
        flat, size = batch.column("order").flatten(), pc.list_value_length(batch.column("order")).to_numpy()
        doc = np.repeat(np.arange(len(size)), size)
        found = pc.fill_null(pc.index_in(flat, known), -1).to_numpy()
        at = np.flatnonzero(found >= 0)
        n = first[found[at] + 1] - first[found[at]]
        top = np.zeros(len(size), np.int64)
        # runs that the last piece of the batch left open: each item's last place and its run there
        last, run = np.full(items, -2), np.zeros(items, np.int64)
        below = np.concatenate([[0], np.cumsum(n)])
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(below, below[a] + HITS, "right")) - 1)
            place, m = np.repeat(at[a:b], n[a:b]), n[a:b]
            within = np.arange(len(place)) - np.repeat(below[a:b] - below[a], m)
            item = owner[np.repeat(first[found[at[a:b]]], m) + within]
            by = np.lexsort((place, item))
            place, item = place[by], item[by]
            # the same item one place before, in the same unit
            new = np.ones(len(place), bool)
            new[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (doc[place[1:]] != doc[place[:-1]])
            start = np.flatnonzero(new)
            goes_on = (last[item[start]] == place[start] - 1) & (doc[place[start]] == doc[np.maximum(place[start] - 1, 0)])
            long = np.diff(np.append(start, len(place))) + np.where(goes_on, run[item[start]], 0)
            np.maximum.at(top, doc[place[start]], long)
            end = np.append(start[1:], len(place)) - 1
            # places ascend within an item, so the last run of each item stays
            last[item[end]], run[item[end]] = place[end], long
            a = b
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(top)], ["doc_id", "longest_run"])


@query(
    f"""WITH p AS (SELECT item_id, text AS q, list_distinct({_TOKENS.format("text")}) AS members FROM benchmark), d AS (SELECT doc_id, text AS t FROM documents),
o AS (SELECT doc_id, item_id, members, unnest(range(len({_TOKENS.format("t")}))) AS pos, unnest({_TOKENS.format("t")}) AS token FROM d, p),
m AS (SELECT doc_id, item_id, pos, list_contains(members, token) AS hit, sum(CASE WHEN list_contains(members, token) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS island FROM o),
r AS (SELECT doc_id, item_id, island, count(*) FILTER (WHERE hit) AS n FROM m GROUP BY ALL)
SELECT doc_id, max(n)::BIGINT AS longest_run FROM r GROUP BY doc_id"""
)
def copied_runs(spark, sf_dir):
    """For each unit, the longest run of its words that are words of one item."""
    return longest_runs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(
    _PAIRS
    + rf""", e AS (SELECT item_id, doc_id, CASE WHEN contains(d.text, b.text) THEN 3 WHEN contains(trim(regexp_replace(lower(d.text), '[ \t\n\x0b\f\r]+', ' ', 'g')), trim(regexp_replace(lower(b.text), '[ \t\n\x0b\f\r]+', ' ', 'g'))) THEN 2
  WHEN shared_n * 100 >= 55 * n_b AND n_b >= 4 THEN 1 ELSE 0 END AS tier, shared_n FROM p JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))
SELECT item_id, doc_id, tier::BIGINT AS tier FROM e WHERE tier > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY tier DESC, shared_n DESC, doc_id) = 1"""
)
def quote_match(spark, sf_dir):
    """The unit that supports a quote best: verbatim (3), in normal form (2), by 55 % of its words (1)."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    pairs = covering_pairs(docs, items, "doc_id", "item_id", "case when n_b < 4 then 1 else (n_b * 55 + 99) div 100 end")
    rows = pairs.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("quote")), "item_id")
    normal = F.contains(T.squeeze(F.lower("text")), T.squeeze(F.lower("quote")))
    rows = rows.withColumn("tier", F.when(F.contains("text", "quote"), 3).when(normal, 2).when(F.expr("shared_n * 100 >= 55 * n_b and n_b >= 4"), 1).otherwise(0).cast("long"))
    best = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("tier"), F.desc("shared_n"), "doc_id"))
    return rows.filter("tier > 0").withColumn("k", best).filter("k = 1").select("item_id", "doc_id", "tier")


@query(
    """WITH o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents)
SELECT a.doc_id, b.doc_id AS neighbour, (b.pos - a.pos)::BIGINT AS off FROM o a JOIN o b ON a.source = b.source AND b.pos - a.pos BETWEEN -2 AND 2 AND a.pos <> b.pos"""
)
def neighbours(spark, sf_dir):
    """Units up to two places before and behind in their document: places are joined with the places next to them."""
    rows = placed(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")
    near = rows.select("doc_id", "source", F.explode(F.array(*(F.lit(k).cast("long") for k in (-1, 1, -2, 2)))).alias("off"), "place")
    near = near.select("doc_id", "source", "off", (F.col("place") + F.col("off")).alias("place"))
    return near.join(rows.select("source", "place", F.col("doc_id").alias("neighbour")), ["source", "place"]).select("doc_id", "neighbour", "off")


@query("SELECT d.doc_id, l.quality::BIGINT AS quality, 'matched' AS status FROM documents d JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, NULL, 'chunk_missing' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def slot_units(spark, sf_dir):
    """Slots with their unit, and the slots without one as rejects."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    found = docs.join(labels, "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), F.lit("matched").alias("status"))
    return found.union(docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("long"), F.lit("chunk_missing")))


# Topics with the words that they are told by.
TOPICS = [("colour", "RED"), ("colour", "BLUE"), ("size", "SMALL"), ("size", "LARGE"), ("shape", "RING"), ("shape", "BOLT"), ("offer", "PROMO"), ("offer", "ECONOMY")]
_TOPIC_VALUES = ", ".join(f"('{t}', '{w}')" for t, w in TOPICS)


@query(
    f"""WITH k(topic, word) AS (VALUES {_TOPIC_VALUES}), m AS (SELECT p_partkey, topic, count(*) AS score FROM part JOIN k ON contains(upper(p_type || ' ' || p_name), word) GROUP BY ALL)
SELECT p_partkey, topic, score FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, topic) = 1"""
)
def misconception_match(spark, sf_dir):
    """The topic whose words a text has most of; the word list is a fixed table."""
    words = spark.createDataFrame(TOPICS, "topic string, word string")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.upper(F.concat_ws(" ", "p_type", "p_name")).alias("t"))
    rows = parts.join(F.broadcast(words), F.contains("t", "word")).groupBy("p_partkey", "topic").agg(F.count("*").alias("score"))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("p_partkey").orderBy(F.desc("score"), "topic"))).filter("k = 1").drop("k")


@query(
    """WITH r AS (SELECT conv_id, turn, conv_id || '_r' || turn AS raw, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
s AS (SELECT doc_id AS slot, row_number() OVER (ORDER BY doc_id) AS pos FROM documents)
SELECT r.conv_id, r.turn, coalesce(a.slot, b.slot) AS slot, CASE WHEN a.slot IS NOT NULL THEN 'base' WHEN b.slot IS NOT NULL THEN 'position' ELSE 'none' END AS via
FROM r LEFT JOIN s a ON a.slot = regexp_replace(r.raw, '_r[0-9]+$', '')::BIGINT * 3 LEFT JOIN s b ON b.pos = r.pos"""
)
def batch_response_slots(spark, sf_dir):
    """Responses find their slot by base id (the retry suffix stripped), else by position."""
    rows = placed(read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("conv_id", F.lit("_r"), "turn").alias("raw")), "conv_id", "turn").withColumnRenamed("place", "pos")
    slots = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("slot"))
    order = placed(slots.withColumn("all", F.lit(0)), "all", "slot").select(F.col("place").alias("pos"), F.col("slot").alias("b"))
    base = rows.withColumn("want", F.regexp_replace("raw", "_r[0-9]+$", "").cast("long") * 3)
    out = base.join(slots.select(F.col("slot").alias("want"), F.col("slot").alias("a")), "want", "left").join(order, "pos", "left")
    return out.select("conv_id", "turn", F.coalesce("a", "b").alias("slot"), F.when(F.col("a").isNotNull(), "base").when(F.col("b").isNotNull(), "position").otherwise("none").alias("via"))


_KEY = r"trim(regexp_replace(lower(text), '[ \t\n\x0b\f\r]+', ' ', 'g'))"


@query(f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) = 1")
def keep_first(spark, sf_dir):
    """The first of texts that are equal without case and spacing; grouped by hash and length, not by moving texts."""
    key = T.squeeze(F.lower("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2(key.cast("binary"), 256).alias("k"))
    return rows.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


# Words of labels, which tell nothing of a unit.
LABELS = ["summary", "context", "topic", "chunk", "type"]
_WORDS = f"list_filter({_TOKENS.format('text')}, lambda t: t NOT IN ({', '.join(repr(x) for x in LABELS)}))"
_SIG = f"CASE WHEN len({_WORDS}) >= 8 THEN array_to_string({_WORDS}, ' ') ELSE 'unique ' || doc_id END"


def signature(text: Column, key: Column, words: int | None = None) -> Column:
    """A unit's words, all of them or the first ones of a chunk, without labels; its key where they are under eight."""
    own = F.filter(T.tokens(text), lambda t: ~t.isin(LABELS))
    return F.when(F.size(own) >= 8, F.array_join(F.slice(own, 1, words) if words else own, " ")).otherwise(F.concat(F.lit("unique "), key))


@query(f"WITH s AS (SELECT doc_id, {_SIG} AS sig FROM documents) SELECT min(doc_id) AS doc_id, count(*) AS copies FROM s GROUP BY sig")
def signature_dedup(spark, sf_dir):
    """One unit for each signature of all its words; under eight words a unit is no duplicate."""
    sig = signature(F.col("text"), F.col("doc_id"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(sig.cast("binary"), 256).alias("sig")).groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("sig")


#: Fixed value: the cosine from which two questions are one. The given vectors have few pairs as close, so queries take less.
SIMILAR, QUERY_SIMILAR = 0.8, 0.35


def embedding_links(rows: DataFrame, limit: float = SIMILAR, size: int = 2048) -> DataFrame:
    """Pairs (a, b), a < b, with a cosine of limit or more: blocks of unit vectors are multiplied block by block.

    Blocks hold size vectors on average. Every vector goes to the tasks of its block's row and column, so a task holds two
    blocks whatever the table's size.
    """
    blocks = max(1, -(-rows.count() // size))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    units = rows.select("vec_id", "embedding", block.alias("block"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))))
    dealt = units.withColumn("cell", cells).select("vec_id", "embedding", "block", "cell.i", "cell.j")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["embedding"]).astype(np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        ids, b = pdf["vec_id"].to_numpy(), pdf["block"].to_numpy()
        left = b == pdf["i"].iloc[0]
        right = b == pdf["j"].iloc[0]
        x, y = np.nonzero(m[left] @ m[right].T >= limit)
        a, c = ids[left][x], ids[right][y]
        keep = a < c if pdf["i"].iloc[0] == pdf["j"].iloc[0] else a != c
        return pd.DataFrame({"a": np.minimum(a, c)[keep], "b": np.maximum(a, c)[keep]})

    return dealt.groupBy("i", "j").applyInPandas(product, "a long, b long")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= {QUERY_SIMILAR}")
def embedding_pairs(spark, sf_dir):
    return embedding_links(read(spark, sf_dir, "embeddings"), QUERY_SIMILAR)


def greedy_keep(ids: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Keeps a row iff it has no link to a row kept before it, in order of key.

    Each round settles the rows without an earlier undecided neighbour: kept if no neighbour is kept, else dropped.
    """
    state = ids.select(F.col(key).alias("id"), F.lit(None).cast("boolean").alias("kept"))
    while True:
        earlier = links.select(F.col("a").alias("other"), F.col("b").alias("id")).join(state.select(F.col("id").alias("other"), F.col("kept").alias("was")), "other")
        view = earlier.groupBy("id").agg(F.bool_or(F.coalesce("was", F.lit(False))).alias("hit"), F.bool_or(F.col("was").isNull()).alias("waits"))
        step = state.join(view, "id", "left")
        kept = F.coalesce(F.col("kept"), F.when(F.col("hit"), False).when(~F.coalesce("waits", F.lit(False)), True))
        state = cut(step.select("id", kept.alias("kept")))
        if state.filter("kept is null").isEmpty():
            return state.filter("kept").select(F.col("id").alias(key))


_GREEDY = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings),
k(pos, ids) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT k.pos + 1, CASE WHEN EXISTS (SELECT 1 FROM v w WHERE list_contains(k.ids, w.vec_id) AND list_cosine_similarity(w.embedding, v.embedding) >= {QUERY_SIMILAR}) THEN k.ids ELSE list_append(k.ids, v.vec_id) END
 FROM k JOIN v ON v.pos = k.pos + 1)
SELECT unnest(ids) AS vec_id FROM (SELECT ids FROM k ORDER BY pos DESC LIMIT 1)"""


@query(_GREEDY)
def embedding_dedup(spark, sf_dir):
    """Greedy: a vector stays iff it is unlike all that stayed before it."""
    rows = read(spark, sf_dir, "embeddings")
    return greedy_keep(rows, cut(embedding_links(rows, QUERY_SIMILAR)), "vec_id")


@query(f"WITH s AS (SELECT doc_id, list_distinct({_TOKENS.format('text')}) AS s FROM documents), b AS (SELECT list_distinct(flatten(list({_TOKENS.format('text')}))) AS t FROM benchmark) SELECT doc_id, len(list_intersect(s, t))::BIGINT AS shared, (len(s) - len(list_intersect(s, t)))::BIGINT AS own FROM s, b")
def token_set_algebra(spark, sf_dir):
    """Intersection and difference of token sets with the words of all items, by a semi-join on words."""
    words = token_rows(read(spark, sf_dir, "benchmark"), "item_id").select("token").distinct().withColumn("hit", F.lit(1))
    rows = token_rows(read(spark, sf_dir, "documents"), "doc_id").join(words, "token", "left").groupBy("doc_id").agg(F.count("hit").alias("shared"), F.count_if(F.expr("hit is null")).alias("own"))
    zero = F.lit(0).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.coalesce("shared", zero).alias("shared"), F.coalesce("own", zero).alias("own"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def unused_slots(spark, sf_dir):
    used = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id").join(used, "doc_id", "left_anti")
