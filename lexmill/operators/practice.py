"""Adaptive practice over an answer log: statistics, streaks, the next item."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.functions.order import lagged, running
from lexmill.plans.registry import query, read


def answers(events: DataFrame) -> DataFrame:
    """(user, at, topic, correct) from events: an error is a wrong answer."""
    return events.select(F.col("user_id").alias("user"), F.col("event_id").alias("pos"), F.col("event_type").alias("topic"), (F.col("event_type") != "error").alias("correct"))


_ISLANDS = """WITH a AS (SELECT user_id AS usr, event_id AS pos, event_type AS topic, event_type <> 'error' AS correct FROM events),
i AS (SELECT *, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER (PARTITION BY usr ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM a)"""


def islands(events: DataFrame) -> DataFrame:
    """Answers with the number of wrong ones up to each: right answers of one number are a streak."""
    return running(answers(events), "user", "pos", (~F.col("correct")).cast("long"), "island")


@query(
    _ISLANDS
    + """, s AS (SELECT usr, island, count(*) FILTER (WHERE correct) AS n FROM i GROUP BY ALL) SELECT usr AS "user", max(n) AS longest, max_by(n, island) AS current, count(*) FILTER (WHERE n >= 2) AS streaks FROM s GROUP BY usr"""
)
def practice_streaks(spark, sf_dir):
    rows = islands(read(spark, sf_dir, "events")).groupBy("user", "island").agg(F.count_if("correct").alias("n"))
    return rows.groupBy("user").agg(F.max("n").alias("longest"), F.max_by("n", "island").alias("current"), F.count_if(F.expr("n >= 2")).alias("streaks"))


@query("""SELECT user_id AS "user", count(*) AS answered, count(*) FILTER (WHERE event_type <> 'error') AS correct, count(DISTINCT event_type) AS topics, (1000 * count(*) FILTER (WHERE event_type <> 'error')) // count(*) AS permille FROM events GROUP BY user_id""")
def practice_stats(spark, sf_dir):
    rows = answers(read(spark, sf_dir, "events")).groupBy("user").agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"), F.countDistinct("topic").alias("topics"))
    return rows.withColumn("permille", F.expr("1000 * correct div answered"))


@query("""SELECT user_id AS "user", event_type AS topic, event_id AS pos FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def latest_entry(spark, sf_dir):
    """The most recent entry of each user and topic, as a map-side maximum."""
    return answers(read(spark, sf_dir, "events")).groupBy("user", "topic").agg(F.max("pos").alias("pos"))


@query(
    _ISLANDS
    + """, l AS (SELECT usr, max_by(correct, pos) AS last_right, max_by(topic, pos) AS last_topic, count(*) FILTER (WHERE island = m) - CASE WHEN bool_or(NOT correct AND island = m) THEN 1 ELSE 0 END AS streak
 FROM (SELECT *, max(island) OVER (PARTITION BY usr) AS m FROM i) GROUP BY usr),
t AS (SELECT user_id AS usr, event_type AS topic, count(*) AS seen FROM events GROUP BY ALL)
SELECT l.usr AS "user", CASE WHEN NOT last_right THEN 'repeat' WHEN streak >= 2 THEN 'harder' ELSE 'default' END AS regime, t.topic
FROM l JOIN t USING (usr) QUALIFY row_number() OVER (PARTITION BY l.usr ORDER BY CASE WHEN NOT last_right THEN (t.topic <> last_topic)::INT WHEN streak >= 2 THEN (t.topic = last_topic)::INT ELSE 0 END, seen, t.topic) = 1"""
)
def pick_next(spark, sf_dir):
    """The next topic: the same after a wrong answer, another after a streak of two, else the least seen; ties by name."""
    rows = islands(read(spark, sf_dir, "events"))
    runs = rows.groupBy("user", "island").agg(F.count_if("correct").alias("streak"))
    state = rows.groupBy("user").agg(F.max_by("correct", "pos").alias("last_right"), F.max_by("topic", "pos").alias("last_topic"))
    state = state.join(runs.groupBy("user").agg(F.max_by("streak", "island").alias("streak")), "user")
    seen = rows.groupBy("user", "topic").agg(F.count("*").alias("seen")).join(state, "user")
    same = F.col("topic") == F.col("last_topic")
    first = F.when(~F.col("last_right"), (~same).cast("int")).when(F.col("streak") >= 2, same.cast("int")).otherwise(0)
    regime = F.when(~F.col("last_right"), "repeat").when(F.col("streak") >= 2, "harder").otherwise("default")
    return seen.groupBy("user").agg(F.min(F.struct(first.alias("f"), "seen", "topic")).alias("best"), F.first(regime).alias("regime")).select("user", "regime", "best.topic")


@query(
    """WITH o AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT coalesce(before, 'start') AS before, role, count(*) AS n FROM o GROUP BY ALL"""
)
def turn_transitions(spark, sf_dir):
    """How often each role follows another in a session."""
    rows = lagged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role", "before")
    rows = rows.select(F.coalesce("before", F.lit("start")).alias("before"), "role")
    return rows.groupBy("before", "role").agg(F.count("*").alias("n"))
