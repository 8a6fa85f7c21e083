"""Contexts cut to the units that matter most for a slot, within a number of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import text as T
from lexmill.functions.shared import cut, few_or_all
from lexmill.plans.registry import query, read

from .quotes import UNITS_SQL, units_of

# Words that mark relevance and words that say nothing, folded; the limit, and shares of it in percent.
MARKERS = ["dinh nghia", "duoc goi la", "ky hieu", "cong thuc", "vi du", "loi giai", "nguyen ly", "quy tac", "dinh ly", "he qua", "formula", "definition", "example"]
STOP = ["mot", "cac", "nhung", "duoc", "khong", "cho", "voi", "khi", "thi", "la", "cua", "trong", "neu", "theo", "hoi", "hay", "tinh", "so", "bai", "toan", "pattern", "conceptual", "computation", "reasoning", "application"]
LIMIT, ENOUGH, SPARSE = 1500, 85, 45
OPERATORS, NAMED = "[=<>^]", "(^|[^A-Za-z0-9_])(C *[(]|n!|mod($|[^A-Za-z0-9_]))"


def content_words(c: Column) -> Column:
    return F.array_except(T.token_set(c), F.array(*map(F.lit, STOP)))


def relevance(unit: Column, words: Column) -> Column:
    """Quarter points of a unit: 20 a shared word, 12 a marker, 4 an operator up to 16, one a digit up to 8, 2 for a good length."""
    folded, size = T.fold(unit), F.char_length(unit)
    marks = sum((F.contains(folded, F.lit(m)).cast("int") for m in MARKERS[1:]), F.contains(folded, F.lit(MARKERS[0])).cast("int"))
    count = lambda p: F.regexp_count(unit, F.lit(p))
    points = 20 * F.size(F.array_intersect(content_words(unit), words)) + 12 * marks + F.least(F.lit(16), 4 * (count(OPERATORS) + count(NAMED))) + F.least(F.lit(8), count("[0-9]"))
    return (points + F.when(size.between(60, 420), 2).otherwise(0)).cast("int")


def taken(order: Column, start: Column, limit: int, wanted) -> Column:
    """used and kept after each unit (i, n, s) of order is taken that is wanted and fits, until the limit is nearly used up."""

    def step(state: Column, u: Column) -> Column:
        extra = u.n + F.when(F.size(state.kept) > 0, 2).otherwise(0)
        fits = (state.used * 100 < limit * ENOUGH) & (state.used + extra <= limit) & ~F.array_contains(state.kept, u.i) & wanted(state, u)
        return F.when(fits, F.struct((state.used + extra).alias("used"), F.array_append(state.kept, u.i).alias("kept"))).otherwise(state)

    return F.aggregate(order, start, step)


def trimmed_texts(docs: DataFrame, words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, text) of docs (doc_id, topic, text) and words (topic, words): texts of at most limit characters, as they are.

    A longer text is cut into units, which are taken by relevance, then by place, as long as they fit; a misfit is passed
    over, and so is a unit of no relevance once there is another. If that uses little, units are added from the beginning.
    Units stand in the order of the text. Only places, lengths and points are folded, so the fold is short.
    """
    docs = docs.select("doc_id", "topic", F.regexp_replace(F.coalesce("text", F.lit("")), "^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "").alias("text"))
    long = docs.filter(F.char_length("text") > limit)
    units = units_of(long).join(long.select("doc_id", "topic"), "doc_id").join(few_or_all(cut(words)), "topic", "left")
    units = cut(units.select("doc_id", F.col("unit").cast("int").alias("i"), F.char_length("text").alias("n"), relevance(F.col("text"), F.coalesce("words", F.array().cast("array<string>"))).alias("s"), "text"))
    every = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "i", "n"))).alias("ranked"))
    none = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    first = every.withColumn("got", taken(F.col("ranked"), none, limit, lambda state, u: (u.s < 0) | (F.size(state.kept) == 0)))
    by_place = F.array_sort(F.transform("ranked", lambda u: F.struct(u.i.alias("i"), u.n.alias("n"), u.s.alias("s"))))
    more = F.when(F.col("got.used") * 100 < limit * SPARSE, taken(by_place, F.col("got"), limit, lambda state, u: F.lit(True))).otherwise(F.col("got"))
    kept = first.select("doc_id", F.explode(more["kept"]).alias("i"))
    joined = units.join(kept, ["doc_id", "i"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("u"))
    cut_down = long.select("doc_id", F.rtrim(F.substring("text", 1, limit)).alias("head")).join(joined.select("doc_id", F.array_join(F.transform("u", lambda u: u.text), "\n\n").alias("t")), "doc_id", "left")
    return docs.filter(F.char_length("text") <= limit).select("doc_id", "text").unionByName(cut_down.select("doc_id", F.coalesce("t", "head").alias("text")))


_FOLD = "strip_accents(translate(lower({}), 'ª²³µ¹ºđſẛ', 'a23μ1odss'))"
_WORDS = "list_filter(list_distinct(regexp_extract_all(" + _FOLD + ", '[a-z0-9]{{3,}}')), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in STOP) + "))"
_count = lambda p: f"len(regexp_extract_all(body, '{p}'))"
_STEP = f"used * 100 < {LIMIT * ENOUGH} AND used + n + CASE WHEN len(kept) > 0 THEN 2 ELSE 0 END <= {LIMIT} AND NOT list_contains(kept, unit)"
_NEXT = f"used + CASE WHEN takes THEN n + CASE WHEN len(kept) > 0 THEN 2 ELSE 0 END ELSE 0 END, CASE WHEN takes THEN list_append(kept, unit) ELSE kept END"


@query(
    f"""WITH RECURSIVE {UNITS_SQL}, d AS (SELECT doc_id, doc_id % 40 AS topic, regexp_replace(coalesce(text, ''), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS t FROM documents),
w AS MATERIALIZED (SELECT item_id AS topic, {_WORDS.format('text')} AS words FROM benchmark),
s AS MATERIALIZED (SELECT u.doc_id, u.unit, length(body) AS n, body, 20 * len(list_intersect({_WORDS.format('body')}, coalesce(words, []))) + 12 * ({' + '.join(f"contains({_FOLD.format('body')}, '{m}')::INT" for m in MARKERS)})
 + least(16, 4 * ({_count(OPERATORS)} + {_count(NAMED)})) + least(8, {_count('[0-9]')}) + CASE WHEN length(body) BETWEEN 60 AND 420 THEN 2 ELSE 0 END AS s FROM u JOIN d ON d.doc_id = u.doc_id AND length(d.t) > {LIMIT} LEFT JOIN w USING (topic)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, unit) AS pos FROM s),
r(doc_id, pos, used, kept) AS (SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM o
 UNION ALL SELECT doc_id, pos, {_NEXT} FROM (SELECT o.*, r.used, r.kept, {_STEP.replace('n +', 'o.n +')} AND (s > 0 OR len(kept) = 0) AS takes FROM r JOIN o ON o.doc_id = r.doc_id AND o.pos = r.pos + 1)),
f AS MATERIALIZED (SELECT doc_id, max_by(used, pos) AS used, max_by(kept, pos) AS kept FROM r GROUP BY doc_id),
q(doc_id, pos, used, kept) AS (SELECT doc_id, 0::BIGINT, used, kept FROM f WHERE used * 100 < {LIMIT * SPARSE}
 UNION ALL SELECT doc_id, pos, {_NEXT} FROM (SELECT s.doc_id, s.unit, s.n, q.pos + 1 AS pos, q.used, q.kept, {_STEP.replace('n +', 's.n +')} AS takes FROM q JOIN s ON s.doc_id = q.doc_id AND s.unit = q.pos)),
g AS (SELECT doc_id, max_by(kept, pos) AS kept FROM q GROUP BY doc_id),
k AS (SELECT f.doc_id, coalesce(g.kept, f.kept) AS kept FROM f LEFT JOIN g USING (doc_id)),
j AS (SELECT s.doc_id, string_agg(body, chr(10) || chr(10) ORDER BY unit) AS t FROM s JOIN k ON k.doc_id = s.doc_id AND list_contains(k.kept, s.unit) GROUP BY s.doc_id),
e AS (SELECT d.doc_id, CASE WHEN length(d.t) <= {LIMIT} THEN d.t ELSE coalesce(j.t, rtrim(substr(d.t, 1, {LIMIT}))) END AS t FROM d LEFT JOIN j USING (doc_id))
SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM e"""
)
def trimmed_contexts(spark, sf_dir):
    """Whole documents cut to what matters for a topic's words, 1500 characters at most."""
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).alias("topic"), "text")
    words = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), content_words(F.col("text")).alias("words"))
    return trimmed_texts(docs, words).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))
