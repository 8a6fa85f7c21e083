"""State machines over several micro-batches against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.streaming import jobs


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Events in five files, one a micro-batch, and the same rows as a list in order of arrival."""
    folder, rng, rows = tmp_path_factory.mktemp("events"), random.Random(6), []
    at = datetime(2024, 1, 1)
    for k in range(400):
        at += timedelta(milliseconds=rng.choice([10, 100, 330, 900]))
        rows.append((k, at, rng.choice([1, 1, 1, 2, 3]), rng.choice(["signup", "click", "purchase", "view", "error"])))
    for n in range(5):
        part = rows[80 * n : 80 * n + 80]
        rng.shuffle(part)
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(f"{folder}/{n}")
    return str(folder), rows


def streamed(spark, folder, *columns):
    raw = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    return raw.select("ts", F.unix_micros("ts").alias("at"), "event_id", "user_id", *columns)


def test_throttle(spark, log):
    folder, rows = log
    last, want = {}, []
    for k, at, user, kind in rows:
        if kind == "purchase" or user not in last or at - last[user] >= timedelta(milliseconds=330):
            last[user] = at
            want.append((user, k))
    got = jobs.throttled(streamed(spark, folder, (F.col("event_type") == "purchase").alias("final"))).collect()
    assert sorted(map(tuple, got)) == sorted(want) and 0 < len(want) < len(rows)


def test_job_log(spark, log):
    folder, rows = log
    state, want = {}, []
    for k, _, user, kind in rows:
        command = jobs._COMMANDS[kind]
        state[user], refused = jobs.move(state.get(user, (False, "new", False)), command)
        want.append((k, user, command, refused, state[user][1], state[user][2]))
    got = jobs.job_log(streamed(spark, folder, F.expr(jobs._COMMAND_SQL).alias("command"))).collect()
    assert sorted(map(tuple, got)) == want
    assert {r[3] for r in want} == {"", jobs.NO_CHUNKS, jobs.RUNNING, jobs.FINISHED, jobs.NOT_RUNNING}


def test_moves():
    assert jobs.move((True, "done", False), "cancel") == ((True, "done", False), jobs.FINISHED)
    assert jobs.move((True, "generating", True), "finish") == ((True, "cancelled", False), "")
    assert jobs.move((True, "cancelled", False), "generate") == ((True, "generating", False), "")


def chosen(bank, served, history):
    left = [q for q in bank if q[0] not in served]
    streak = 0
    for h in reversed(history):
        if not h[4]:
            break
        streak += 1

    def score(q):
        seen = sum(h[1] == q[1] for h in history)
        if history and not history[-1][4]:
            _, topic, level, skill, _ = history[-1]
            return (0 if q[1] == topic else 1 if q[3] == skill else 2, q[2] > level, q[2])
        return (-q[2], seen, 0) if streak >= 2 else (seen, abs(q[2] - 1), 0)

    return min(left, key=score, default=None)


def test_practice(spark, log):
    folder, rows = log
    rng = random.Random(1)
    bank = [(k, f"t{rng.randrange(4)}", rng.randrange(4), f"s{rng.randrange(3)}") for k in range(60)]
    sessions, want = {}, []
    for k, _, user, kind in rows:
        served, history, current = sessions.setdefault(user, ([chosen(bank, [], [])[0]], [], [chosen(bank, [], [])]))
        good = kind != "error"
        asked = current[0]
        if asked:
            history.append((*asked, good))
            current[0] = chosen(bank, served, history)
            served += [current[0][0]] if current[0] else []
        streak = next((n for n, h in enumerate(reversed(history)) if not h[4]), len(history))
        want.append((k, user, asked and asked[0], good, len(history), sum(h[4] for h in history), streak, current[0] and current[0][0]))
    got = jobs.practice_log(streamed(spark, folder, (F.col("event_type") != "error").alias("good")), spark.createDataFrame(bank, "question long, topic string, level int, skill string")).collect()
    assert sorted(map(tuple, got)) == want
    assert any(r[2] is None for r in want)


def test_a_bank_has_to_be_small(spark, log, monkeypatch):
    monkeypatch.setattr(jobs, "BANK", 3)
    with pytest.raises(ValueError):
        jobs.practice_log(streamed(spark, log[0], F.lit(True).alias("good")), spark.range(4).selectExpr("id AS question", "'t' AS topic", "1 AS level", "'s' AS skill"))
