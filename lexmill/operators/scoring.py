"""Scalar rules: headings, normal forms, answer letters, time, grounding and rubric scores, exercise stripping, topic tiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, Window as W

from lexmill.functions import text as T
from lexmill.functions.order import placed
from lexmill.functions.shared import cut
from lexmill.plans.registry import query, read

_STRIP = r"regexp_replace({}, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')"

# What a heading looks like, in the order in which it is tried.
HEADINGS = [
    ("chapter", r"^(?:chương|chapter|section) +[0-9]+ *[:.]? *.{0,120}$"),
    ("lesson", r"^(?:bài|mục) +[0-9]+ *[:.]? *.{0,120}$"),
    ("numbered", r"^[0-9]+(?:\.[0-9]+){1,5}\.? +[^\n]{2,120}$"),
    ("title", r"^[0-9]+\. +[a-zđ][^\n]{2,120}$"),
]


def heading_kind(line: Column) -> Column:
    """The kind of heading that a line is, without its markup, or null."""
    bare = F.lower(T.strip(F.regexp_replace(line, r"^ {0,3}#{1,6} *|^[*_]{1,2}|[*_]{1,2}$", "")))
    out = F.when((bare == "") | (F.char_length(bare) > 140), F.lit(None))
    for kind, pattern in HEADINGS:
        out = out.when(bare.rlike(pattern), kind)
    return out


@query(
    rf"""WITH s AS (SELECT doc_id, '## Chapter ' || doc_id || ': ' || source || chr(10) || doc_id || '.' || doc_id % 7 || ' ' || lang || ' part' || chr(10) || coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM s), b AS (SELECT doc_id, lower({_STRIP.format("regexp_replace(line, '^ {0,3}#{1,6} *|^[*_]{1,2}|[*_]{1,2}$', '', 'g')")}) AS b FROM l),
k AS (SELECT doc_id, CASE WHEN b = '' OR length(b) > 140 THEN NULL """
    + " ".join(f"WHEN regexp_matches(b, '{p}') THEN '{k}'" for k, p in HEADINGS)
    + " END AS kind FROM b) SELECT doc_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL"
)
def heading_kinds(spark, sf_dir):
    """How many lines of each kind of heading a unit has, under a chapter and a part title of its own."""
    title = F.concat(F.lit("## Chapter "), "doc_id", F.lit(": "), "source", F.lit("\n"), "doc_id", F.lit("."), F.col("doc_id") % 7, F.lit(" "), "lang", F.lit(" part\n"), F.coalesce("text", F.lit("")))
    kinds = F.array_compact(F.transform(T.lines(title), heading_kind))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(kinds).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


# Symbols and what they are compared as, in order.
MATHS = [("²", "^2"), ("³", "^3"), ("×", "*"), ("·", "*"), ("÷", "/"), ("−", "-"), ("≤", "<="), ("≥", ">="), ("√", "sqrt"), ("π", "pi"), ("∞", "inf")]


def maths_form(c: Column) -> Column:
    """Symbols spelt out, no spaces around operators, lower case."""
    for old, new in MATHS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.lower(T.squeeze(F.regexp_replace(c, r"[ \t\n\x0b\f\r]*([+\-*/^=<>])[ \t\n\x0b\f\r]*", "$1")))


def _maths_sql(c: str) -> str:
    for old, new in MATHS:
        c = f"replace({c}, '{old}', '{new}')"
    return rf"lower(trim(regexp_replace(regexp_replace({c}, '[ \t\n\x0b\f\r]*([+\-*/^=<>])[ \t\n\x0b\f\r]*', '\1', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')))"


@query(f"SELECT p_partkey, {_maths_sql('p_name || chr(32) || p_size || chr(178) || chr(32) || chr(8804) || chr(32) || chr(960)')} AS form FROM part")
def maths_forms(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", maths_form(F.concat("p_name", F.lit(" "), "p_size", F.lit("² ≤ π"))).alias("form"))


def quote_form(c: Column) -> Column:
    """A quote without quotation marks, emphasis, heading and code marks, with tight punctuation."""
    c = F.regexp_replace(c, "[\"“”„«»`*_]|^#+ *", "")
    return T.squeeze(F.regexp_replace(c, " +([,.;:!?])", "$1"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\"“”„«»`*_]|^#+ *', '', 'g'), ' +([,.;:!?])', '\\1', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS form FROM benchmark")
def quote_forms(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", quote_form(F.col("text")).alias("form"))


@query("SELECT item_id, regexp_replace(regexp_replace('Choose answer ' || chr((65 + item_id % 4)::INT) || ', **' || chr((65 + item_id % 4)::INT) || '** is right', '[*]{2} *([A-D]) *[*]{2}', '\\1', 'g'), '(?i)(answer +)[A-D]', '\\1B', 'g') AS t FROM benchmark")
def answer_letters(spark, sf_dir):
    """Letters of the answer in a text follow the shuffled key."""
    letter = F.chr(F.lit(65) + F.col("item_id") % 4)
    text = F.concat(F.lit("Choose answer "), letter, F.lit(", **"), letter, F.lit("** is right"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.regexp_replace(text, r"[*]{2} *([A-D]) *[*]{2}", "$1"), "(?i)(answer +)[A-D]", "$1B").alias("t"))


def seconds(difficulty: Column, level: Column) -> Column:
    """Seconds for a difficulty in hundredths; the top level takes 15 % more and the lowest 10 % less, cut to whole ones."""
    base = F.when(difficulty < 35, 45).when(difficulty < 55, 75).when(difficulty < 75, 130).when(difficulty < 85, 200).otherwise(280)
    factor = F.when(level == 3, 115).when(level == 0, 90).otherwise(100)
    return F.floor(base * factor / 100).cast("long")


@query(
    """WITH p AS (SELECT p_partkey, (p_size * 2) % 100 AS d, p_partkey % 4 AS l FROM part)
SELECT p_partkey, (CASE WHEN d < 35 THEN 45 WHEN d < 55 THEN 75 WHEN d < 75 THEN 130 WHEN d < 85 THEN 200 ELSE 280 END * CASE l WHEN 3 THEN 115 WHEN 0 THEN 90 ELSE 100 END // 100)::BIGINT AS seconds FROM p"""
)
def time_estimate(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", seconds(F.col("p_size") * 2 % 100, F.col("p_partkey") % 4).alias("seconds"))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_partkey % 101)::BIGINT AS base, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 101 END AS topic, (l_quantity::BIGINT * 2) % 101 AS formula, l_orderkey % 101 AS consistency, CASE WHEN l_linenumber > 4 THEN NULL ELSE (l_linenumber * 20)::BIGINT END AS quote,
 CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 100 ELSE 300 END AS penalty FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(0, least(2000, base * 10 + (40 * coalesce(topic, base) + 30 * consistency + 15 * formula + 15 * coalesce(quote, base)) // 10 - penalty))::BIGINT AS score FROM s"""
)
def grounding_scores(spark, sf_dir):
    """Half-thousandths: mean of the base and of 40/30/15/15 weighted parts, a missing part being the base, less a penalty."""
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        (F.col("l_partkey") % 101).alias("base"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 101).alias("topic"),
        (F.col("l_quantity").cast("long") * 2 % 101).alias("formula"),
        (F.col("l_orderkey") % 101).alias("consistency"),
        F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber").cast("long") * 20).alias("quote"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 100).otherwise(300).alias("penalty"),
    )
    score = F.expr("base * 10 + (40 * coalesce(topic, base) + 30 * consistency + 15 * formula + 15 * coalesce(quote, base)) div 10 - penalty")
    return rows.select("l_orderkey", "l_linenumber", F.greatest(F.lit(0), F.least(F.lit(2000), score)).cast("long").alias("score"))


@query(
    """WITH t AS (SELECT s_suppkey, [s_suppkey % 13 * 10, NULL, s_nationkey * 10, -5, 70] AS scores FROM supplier)
SELECT s_suppkey, list_sum(list_transform(scores, lambda x: greatest(0, least(100, coalesce(x, 50)))))::BIGINT AS total FROM t"""
)
def rubric_totals(spark, sf_dir):
    """The sum of five traits in hundredths, missing ones as 50, each held between 0 and 100."""
    traits = F.array((F.col("s_suppkey") % 13 * 10).cast("long"), F.lit(None).cast("long"), (F.col("s_nationkey") * 10).cast("long"), F.lit(-5).cast("long"), F.lit(70).cast("long"))
    total = F.aggregate(traits, F.lit(0).cast("long"), lambda s, x: s + F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(x, F.lit(50)))))
    return read(spark, sf_dir, "supplier").select("s_suppkey", total.alias("total"))


MARKER = "(?i)license|@|[0-9]{3}"


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, {_STRIP.format("unnest(string_split(text, chr(10)))")} AS line FROM documents),
m AS (SELECT *, regexp_matches(line, '{MARKER}') AS marked, sum(CASE WHEN line = '' OR regexp_matches(line, '{MARKER}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM l),
b AS (SELECT *, bool_or(marked) OVER (PARTITION BY doc_id, island) AS skip FROM m)
SELECT doc_id, count(*) FILTER (WHERE NOT skip AND line <> '') AS kept, count(*) FILTER (WHERE skip) AS dropped FROM b GROUP BY doc_id"""
)
def exercise_stripping(spark, sf_dir):
    """A marked line opens a block that is dropped up to the next blank or marked line: gaps and islands."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "raw")).withColumn("line", T.strip(F.col("raw")))
    marked = F.col("line").rlike(MARKER)
    island = F.sum(F.when((F.col("line") == "") | marked, 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("marked", marked).withColumn("island", island).withColumn("skip", F.bool_or("marked").over(W.partitionBy("doc_id", "island")))
    return rows.groupBy("doc_id").agg(F.count_if(~F.col("skip") & (F.col("line") != "")).alias("kept"), F.count_if("skip").alias("dropped"))


#: Topics that a plan may name.
MOST_TOPICS = 10_000


@query(
    """WITH w AS (SELECT c_custkey, lower(CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN substr(c_mktsegment, 1, 4) ELSE 'nothing like it' END) AS want FROM customer), t AS (SELECT DISTINCT lower(c_mktsegment) AS topic FROM customer)
SELECT c_custkey, coalesce((SELECT topic FROM t WHERE topic = want), (SELECT min(topic) FROM t WHERE contains(topic, want) OR contains(want, topic)), (SELECT min(topic) FROM t)) AS topic FROM w"""
)
def topic_tiers(spark, sf_dir):
    """A wanted topic finds the same, else one that holds it or that it holds, else the first."""
    rows = read(spark, sf_dir, "customer")
    want = F.lower(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.substring("c_mktsegment", 1, 4)).otherwise("nothing like it"))
    rows_ = rows.select("c_custkey", want.alias("want"))
    # topics are counted to be few; each distinct want meets them once, and rows look their want up by equality
    topics = cut(rows.select(F.lower("c_mktsegment").alias("topic")).distinct())
    if topics.limit(MOST_TOPICS + 1).count() > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics")
    near = rows_.select("want").distinct().crossJoin(F.broadcast(topics))
    best = near.groupBy("want").agg(F.max(F.when(F.col("topic") == F.col("want"), F.col("topic"))).alias("same"), F.min(F.when(F.contains("topic", "want") | F.contains("want", "topic"), F.col("topic"))).alias("part"), F.min("topic").alias("first"))
    return rows_.join(best, "want").select("c_custkey", F.coalesce("same", "part", "first").alias("topic"))


@query(
    """WITH p AS (SELECT source, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY source), n AS (SELECT source, ids, len(ids) AS n, source[4:]::BIGINT AS i FROM p)
SELECT source, array_to_string(list_transform(range(5), lambda k: ids[((2 * i + k) % n + 1)::BIGINT]), ',') AS five FROM n WHERE n > 5"""
)
def rotated_lists(spark, sf_dir):
    """Five of more than five entries, begun at twice the list's number; entries are looked up by place, no list is made whole."""
    rows = placed(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")
    sizes = rows.groupBy("source").agg(F.count("*").alias("n")).filter("n > 5")
    first = F.substring("source", 4, 10).cast("long") * 2
    wanted = sizes.select("source", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(k.alias("k"), ((first + k) % F.col("n") + 1).alias("place")))).alias("w"))
    found = wanted.select("source", "w.k", "w.place").join(rows, ["source", "place"])
    five = F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda x: x.doc_id.cast("string"))
    return found.groupBy("source").agg(F.array_join(five, ",").alias("five"))
