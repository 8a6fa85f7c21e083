"""Slot planning: apportionment, round robin, level pools, top-k, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from lexmill.functions.order import placed, running
from lexmill.plans.registry import query, read

# Levels with their target in hundredths and share in hundredths.
LEVELS = [("Nhận biết", 30, 25), ("Thông hiểu", 50, 35), ("Vận dụng", 70, 30), ("Vận dụng cao", 85, 10)]
_LEVEL_VALUES = ", ".join(f"({k}, '{n}', {t}, {f})" for k, (n, t, f) in enumerate(LEVELS))


def apportioned(totals: DataFrame, key: str) -> DataFrame:
    """(key, level, count): total slots over levels by share, rounded half-even, then evened out from the largest share on."""
    levels = totals.sparkSession.createDataFrame([(k, n, t, f) for k, (n, t, f) in enumerate(LEVELS)], "pos long, level string, target long, share long")
    rows = totals.crossJoin(F.broadcast(levels))
    exact = F.col("total") * F.col("share")
    low = F.expr("total * share div 100")
    up = (exact % 100 > 50) | ((exact % 100 == 50) & (low % 2 == 1))
    rows = rows.withColumn("n", low + up.cast("long"))
    rows = rows.withColumn("delta", F.col("total") - F.sum("n").over(W.partitionBy(key))).withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("share"), "pos")))
    fixed = F.col("n") + F.when(F.col("_rank") <= F.abs("delta"), F.signum("delta").cast("long")).otherwise(0)
    return rows.select(key, "level", "target", fixed.cast("long").alias("count"))


_APPORTION = f"""WITH l(pos, level, target, share) AS (VALUES {_LEVEL_VALUES}), t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
r AS (SELECT source, level, target::BIGINT AS target, share, pos, total, total * share // 100 AS low, total * share % 100 AS rest FROM t, l),
n AS (SELECT *, low + (rest > 50 OR (rest = 50 AND low % 2 = 1))::BIGINT AS n FROM r),
d AS (SELECT *, total - sum(n) OVER (PARTITION BY source) AS delta, row_number() OVER (PARTITION BY source ORDER BY share DESC, pos) AS k FROM n),
c AS (SELECT source, level, target, (n + CASE WHEN k <= abs(delta) THEN sign(delta) ELSE 0 END)::BIGINT AS count FROM d)"""


@query(_APPORTION + " SELECT * FROM c")
def apportion_levels(spark, sf_dir):
    return apportioned(read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total")), "source")


@query(_APPORTION + " SELECT source, level, k AS slot FROM (SELECT source, level, unnest(range(1, count + 1)) AS k FROM c)")
def level_pool(spark, sf_dir):
    """One row for each slot of a level."""
    rows = apportioned(read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total")), "source")
    return rows.filter("count > 0").select("source", "level", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("slot"))


@query("SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4)::BIGINT AS pattern FROM documents")
def round_robin_slots(spark, sf_dir):
    rows = placed(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")
    return rows.select("doc_id", "source", ((F.col("place") - 1) % 4).cast("long").alias("pattern"))


@query(
    r"""WITH s AS (SELECT doc_id, source, (5 * len(regexp_extract_all(lower(text), 'license|email|phone')) + least(4, len(regexp_extract_all(text, '[=+|]'))) + least(2, len(regexp_extract_all(text, '[0-9]')) // 4))::BIGINT AS score FROM documents),
k AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 40) SELECT doc_id, source, score FROM k ORDER BY doc_id"""
)
def topk_units(spark, sf_dir):
    """The 40 most relevant units, put back in their order; the report's length is the feature."""
    count = lambda p, c="text": F.regexp_count(c, F.lit(p)).cast("long")
    score = 5 * count("license|email|phone", F.lower("text")) + F.least(F.lit(4), count("[=+|]")) + F.least(F.lit(2), F.floor(count("[0-9]") / 4))
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", score.cast("long").alias("score"))
    return rows.orderBy(F.desc("score"), "doc_id").limit(40).orderBy("doc_id")


@query("WITH t AS (SELECT lang || '/' || source AS topic, min(doc_id) AS first FROM documents GROUP BY 1) SELECT topic, first FROM t ORDER BY first LIMIT 12")
def section_suggestions(spark, sf_dir):
    """The first twelve topics in order of appearance; the report's length is the feature."""
    rows = read(spark, sf_dir, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("topic")).agg(F.min("doc_id").alias("first"))
    return rows.orderBy("first").limit(12)


def attempts(events: DataFrame) -> DataFrame:
    """(user_id, event_id, slot) of all error events."""
    rows = placed(events.filter("event_type = 'error'").select("user_id", "event_id"), "user_id", "event_id")
    return rows.select("user_id", "event_id", F.concat("user_id", F.lit("_r"), F.format_string("%02d", "place")).alias("slot"))


@query(
    """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events WHERE event_type = 'error')
SELECT user_id, event_id, user_id || '_r' || lpad(attempt::VARCHAR, greatest(2, length(attempt::VARCHAR))::INT, '0') AS slot FROM a"""
)
def attempt_numbers(spark, sf_dir):
    """Retries get their slot's name with a running number of two digits or more."""
    return attempts(read(spark, sf_dir, "events"))


@query(
    """WITH p AS (SELECT source, doc_id, quality, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS accepted FROM documents JOIN labels USING (doc_id))
SELECT source, doc_id, least(940, 20 + 920 * accepted // 20)::BIGINT AS permille FROM p"""
)
def progress_ratio(spark, sf_dir):
    """Progress of accepted items to a target of 20, between 2 and 94 %, in thousandths."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    return running(rows, "source", "doc_id", (F.col("quality") == 1).cast("long"), "accepted").select("source", "doc_id", F.expr("least(940, 20 + 920 * accepted div 20)").cast("long").alias("permille"))
