"""The contexts that a slot is given, wider with each attempt: its own unit, neighbours as far as the attempt reaches, a topic's best unit.

Neighbours are joined by place, with as many offsets as the attempt allows. A topic's best units are ranked once for all
slots of it, and a few more of them are kept than a slot can have used already, so that one is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from lexmill.functions import text as T
from lexmill.functions.order import placed
from lexmill.functions.shared import cut, few_or_all
from lexmill.plans.registry import query, read

# What a kind of text costs a slot, in hundredths: an example that isn't preferred, an exercise, others.
EXAMPLE, EXERCISE, OTHER, LEAST = 8, 35, 15, 5
OFFSETS = {1: [0], 2: [0, -1, 1], 3: [0, -1, 1, -2, 2]}
ACTIONS = {1: "primary_context", 2: "expand_neighbors_radius_1", 3: "expand_neighbors_radius_2_plus_topic_match"}
#: A topic's best units that are kept: one more than a slot can have without them.
BEST = len(OFFSETS[3]) + 1


def preferred(kind: str, applied: str) -> str:
    return f"({kind} = 'theory' or {kind} = 'example' and {applied})"


def topic_best(units: DataFrame, topics: DataFrame) -> DataFrame:
    """(source, topic, applied, at, doc_id, kind): the best units of each source for a topic, in order from 1 on.

    The score is the share of the topic's words that a unit has, less what its kind costs; 5 hundredths at least.
    """
    words = cut(topics.select("topic", F.size("words").alias("n"), F.explode("words").alias("word")))
    held = units.select("source", "doc_id", "kind", F.explode(T.token_set(F.col("text"))).alias("word")).join(few_or_all(words), "word")
    shared = held.groupBy("topic", "source", "doc_id", "kind").agg(F.first("n").alias("n"), F.count("*").alias("shared"))
    both = shared.withColumn("applied", F.explode(F.array(F.lit(False), F.lit(True))))
    cost = F.expr(f"CASE WHEN {preferred('kind', 'applied')} THEN 0 WHEN kind = 'example' THEN {EXAMPLE} WHEN kind = 'exercise' THEN {EXERCISE} ELSE {OTHER} END")
    scored = both.withColumn("score", 100 * F.col("shared") - cost * F.col("n")).filter(F.col("score") >= LEAST * F.col("n"))
    at = F.row_number().over(W.partitionBy("source", "topic", "applied").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("at", at).filter(F.col("at") <= BEST).select("source", "topic", "applied", "at", "doc_id", "kind")


def contexts_of(slots: DataFrame, units: DataFrame, topics: DataFrame) -> DataFrame:
    """One row a slot: slot_id, action, and the doc_ids of its units in order.

    slots have slot_id, source, doc_id (its unit), attempt, topic and applied (whether examples suit it); units have source,
    doc_id (a number that a source has once), kind, reason (why a unit is unusable, or an empty text) and text; topics have
    topic and words. A first attempt at an exercise takes the topic's best unit in its place. Later ones take neighbours,
    from the third on the topic's best other unit too. Only units of preferred kinds stay if there are any; exercises only
    if there is nothing else. Without a usable unit the action says why the slot's own isn't, and all its units are given.
    """
    places = placed(units.select("source", "doc_id", "kind", "reason"), "source", "doc_id")
    best = cut(topic_best(units, topics))
    reach = F.least(F.greatest(F.col("attempt"), F.lit(1)), F.lit(3))
    offsets = F.when(reach == 1, F.array(*map(F.lit, OFFSETS[1]))).when(reach == 2, F.array(*map(F.lit, OFFSETS[2]))).otherwise(F.array(*map(F.lit, OFFSETS[3])))
    own = slots.join(places.select("source", "doc_id", "place", F.col("kind").alias("own_kind"), F.col("reason").alias("own_reason")), ["source", "doc_id"], "left").withColumn("reach", reach)
    own = cut(own)
    near = own.select("slot_id", "source", "applied", F.posexplode(offsets).alias("at", "off"), (F.col("place")).alias("from"))
    near = near.withColumn("place", F.col("from") + F.col("off")).join(places, ["source", "place"]).select("slot_id", F.col("at").cast("long").alias("at"), "doc_id", "kind", "reason")
    used = cut(near)
    # what a slot doesn't have yet of its topic's best
    wide = own.filter("reach = 3 or reach = 1 and own_kind = 'exercise'").select("slot_id", "source", "topic", "applied")
    left = wide.join(best, ["source", "topic", "applied"]).join(used.select("slot_id", "doc_id"), ["slot_id", "doc_id"], "left_anti")
    more = left.groupBy("slot_id").agg(F.min_by(F.struct("doc_id", "kind"), "at").alias("b")).select("slot_id", "b.doc_id", "b.kind")
    more = more.join(places.select("doc_id", "reason", "source"), "doc_id").join(own.select("slot_id", "source", "reach"), ["slot_id", "source"])
    swapped = more.filter("reach = 1 and kind <> 'exercise'").select("slot_id", F.lit(0).cast("long").alias("at"), "doc_id", "kind", "reason")
    added = more.filter("reach = 3").select("slot_id", F.lit(99).cast("long").alias("at"), "doc_id", "kind", "reason")
    every = used.join(swapped.select("slot_id"), "slot_id", "left_anti").unionByName(swapped).unionByName(added)
    rows = every.join(own.select("slot_id", "applied", "reach"), "slot_id").withColumn("fits", F.expr(preferred("kind", "applied")))
    item = F.struct("at", "doc_id", (F.col("reason") == "").alias("usable"), "fits", (F.col("kind") == "exercise").alias("exercise"))
    got = rows.groupBy("slot_id").agg(F.array_sort(F.collect_list(item)).alias("every"))
    got = own.select("slot_id", "reach", "own_reason").join(got, "slot_id", "left").withColumn("every", F.coalesce("every", F.array().cast(got.schema["every"].dataType)))
    got = got.withColumn("usable", F.filter("every", lambda x: x.usable))
    got = got.withColumn("fit", F.filter("usable", lambda x: x.fits)).withColumn("plain", F.filter("usable", lambda x: ~x.exercise))
    # a first attempt takes its unit whatever its kind
    chosen = F.when((F.col("reach") == 1) | (F.size("fit") == 0) & (F.size("plain") == 0), F.col("usable")).when(F.size("fit") > 0, F.col("fit")).otherwise(F.col("plain"))
    got = got.withColumn("chosen", chosen)
    action = F.when(F.size("chosen") > 0, F.get(F.array(*map(F.lit, ACTIONS.values())), F.col("reach") - 1)).when(F.col("own_reason") != "", F.col("own_reason")).otherwise("context_missing")
    ids = F.transform(F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(F.col("every")), lambda x: x.doc_id)
    return got.select("slot_id", action.alias("action"), ids.alias("doc_ids"))


_UNITS = """SELECT source, doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'exercise' WHEN 1 THEN 'example' WHEN 2 THEN 'summary' ELSE 'theory' END AS kind,
 CASE WHEN trim(coalesce(text, '')) = '' THEN 'context_missing' WHEN n_chars < 300 THEN 'context_too_noisy' ELSE '' END AS reason FROM documents"""
_SLOTS = "SELECT l.doc_id AS slot_id, d.source, l.doc_id, CAST(1 + l.doc_id % 4 AS INT) AS attempt, l.doc_id % 40 AS topic, l.quality = 1 AS applied FROM labels l JOIN documents d USING (doc_id)"
_TOKENS = "list_distinct(regexp_extract_all(strip_accents(translate(lower(text), 'ª²³µ¹ºđſẛ', 'a23μ1odss')), '[a-z0-9]{3,}'))"


@query(
    f"""WITH u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, {_TOKENS} AS tokens FROM ({_UNITS})),
t AS MATERIALIZED (SELECT item_id AS topic, {_TOKENS} AS words FROM benchmark),
s AS MATERIALIZED (SELECT s.*, least(greatest(attempt, 1), 3) AS reach, u.place, u.kind AS own_kind, u.reason AS own_reason FROM ({_SLOTS}) s LEFT JOIN u ON u.source = s.source AND u.doc_id = s.doc_id),
n AS MATERIALIZED (SELECT s.slot_id, CASE u.place - s.place WHEN 0 THEN 0 WHEN -1 THEN 1 WHEN 1 THEN 2 WHEN -2 THEN 3 ELSE 4 END AS at_, u.doc_id, u.kind, u.reason FROM s JOIN u ON u.source = s.source AND abs(u.place - s.place) < s.reach),
p AS MATERIALIZED (SELECT source, topic, applied, doc_id, kind, reason, 100 * len(list_intersect(tokens, words)) - len(words) * CASE WHEN {preferred('kind', 'applied')} THEN 0 WHEN kind = 'example' THEN {EXAMPLE} WHEN kind = 'exercise' THEN {EXERCISE} ELSE {OTHER} END AS score, len(words) AS k
 FROM u, t, (VALUES (true), (false)) AS v(applied)),
m AS (SELECT s.slot_id, s.reach, p.doc_id, p.kind, p.reason FROM s JOIN p ON p.source = s.source AND p.topic = s.topic AND p.applied = s.applied AND p.score >= {LEAST} * p.k AND p.score > 0
 WHERE (s.reach = 3 OR s.reach = 1 AND s.own_kind = 'exercise') AND NOT EXISTS (SELECT 1 FROM n WHERE n.slot_id = s.slot_id AND n.doc_id = p.doc_id) QUALIFY row_number() OVER (PARTITION BY s.slot_id ORDER BY p.score DESC, p.doc_id) = 1),
w AS (SELECT slot_id, 0 AS at_, doc_id, kind, reason FROM m WHERE reach = 1 AND kind <> 'exercise'),
e AS (SELECT * FROM n WHERE slot_id NOT IN (SELECT slot_id FROM w) UNION ALL SELECT * FROM w UNION ALL SELECT slot_id, 99, doc_id, kind, reason FROM m WHERE reach = 3),
f AS (SELECT e.*, s.reach, s.own_reason, {preferred('e.kind', 's.applied')} AS fits FROM e JOIN s USING (slot_id)),
g AS (SELECT *, reason = '' AS usable, count(*) FILTER (WHERE reason = '' AND fits) OVER (PARTITION BY slot_id) AS n_fit, count(*) FILTER (WHERE reason = '' AND kind <> 'exercise') OVER (PARTITION BY slot_id) AS n_plain, count(*) FILTER (WHERE reason = '') OVER (PARTITION BY slot_id) AS n_usable FROM f),
h AS (SELECT *, usable AND (reach = 1 OR n_fit = 0 AND n_plain = 0 OR n_fit > 0 AND fits OR n_fit = 0 AND kind <> 'exercise') AS chosen FROM g)
SELECT slot_id, CASE WHEN n_usable > 0 THEN CASE reach WHEN 1 THEN '{ACTIONS[1]}' WHEN 2 THEN '{ACTIONS[2]}' ELSE '{ACTIONS[3]}' END WHEN own_reason <> '' THEN own_reason ELSE 'context_missing' END AS action,
 string_agg(doc_id, ',' ORDER BY at_) FILTER (WHERE chosen OR n_usable = 0) AS doc_ids FROM h GROUP BY slot_id, n_usable, reach, own_reason"""
)
def slot_contexts(spark, sf_dir):
    """The units that each labelled document's slot is given at its attempt."""
    docs = read(spark, sf_dir, "documents")
    units = docs.selectExpr("source", "doc_id", "text", _UNITS[_UNITS.index("CASE doc_id") : _UNITS.index(",\n")], _UNITS[_UNITS.index("CASE WHEN trim") : _UNITS.index(" FROM documents")])
    slots = read(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id").selectExpr("doc_id AS slot_id", "source", "doc_id", "CAST(1 + doc_id % 4 AS INT) AS attempt", "doc_id % 40 AS topic", "quality = 1 AS applied")
    topics = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic"), T.token_set(F.col("text")).alias("words"))
    got = contexts_of(slots, units, topics)
    return got.select("slot_id", "action", F.array_join("doc_ids", ",").alias("doc_ids"))
