"""Jobs and practice sessions as keyed state: throttled updates, allowed and refused moves, and adaptive sessions.

Each is a stateful processor on a stream. A micro-batch's rows of a key are put in order of time and number; between
batches only what the rule needs is kept, and it goes once a key has been idle, by a timer in event time. A processor's
answer to a row never depends on rows behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from lexmill.plans.registry import query, read

from .status import finished, stream

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time that a row may be late, and time without rows after which a key's state goes.
LATE, IDLE_MS = "1 day", 400 * 86_400_000


class InOrder(StatefulProcessor):
    """Calls start() with a key's state, then row() for each row in order, and keeps what end() gives.

    Rows have at (microseconds) and event_id, and are passed as named tuples.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows), ignore_index=True).sort_values(["at", "event_id"])
        self.start(key)
        out = [x for r in given.itertuples(index=False) if (x := self.row(key, r)) is not None]
        self.end()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(given["at"].max()) // 1000 + IDLE_MS)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


def processed(rows: DataFrame, key: str, processor: InOrder, schema: str) -> DataFrame:
    """All rows that a processor gives for a stream with columns ts, at and event_id."""
    return finished(rows.withWatermark("ts", LATE).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime"), conf={"spark.sql.streaming.stateStore.providerClass": STORE})


def event_stream(spark, sf_dir: str, *columns: str | Column) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return stream(spark, sf_dir, "events").select(ts.alias("ts"), F.unix_micros(ts).alias("at"), "event_id", "user_id", *columns)


# -- throttled updates ------------------------------------------------------------------------------------------------


class Throttle(InOrder):
    """Keeps a row that comes gap microseconds or more after the last one kept of its key, and each final one."""

    columns = ["user_id", "event_id"]

    def __init__(self, gap: int):
        self.gap = gap

    def open(self, handle) -> None:
        self.state = handle.getValueState("last", "at long")

    def start(self, key) -> None:
        self.last = self.state.get()[0] if self.state.exists() else None

    def row(self, key, r):
        if r.final or self.last is None or r.at - self.last >= self.gap:
            self.last = r.at
            return key[0], r.event_id
        return None

    def end(self) -> None:
        self.state.update((self.last,))

    def forget(self) -> None:
        self.state.clear()


#: Fixed value: the gap of progress updates, in seconds. The tables' events are hours apart, hence the query's own gap.
GAP_S = 0.33
_HOURS = 8


def throttled(rows: DataFrame, gap_s: float = GAP_S) -> DataFrame:
    """(user_id, event_id) of the updates that are written; rows have ts, at, event_id, user_id and final."""
    return processed(rows, "user_id", Throttle(round(gap_s * 1_000_000)), "user_id long, event_id long")


@query(
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
r(user_id, pos, event_id, last, kept) AS (SELECT user_id, pos, event_id, ts, true FROM o WHERE pos = 1
 UNION ALL SELECT o.user_id, o.pos, o.event_id, CASE WHEN o.event_type = 'purchase' OR o.ts - r.last >= INTERVAL {_HOURS} HOUR THEN o.ts ELSE r.last END, o.event_type = 'purchase' OR o.ts - r.last >= INTERVAL {_HOURS} HOUR
 FROM r JOIN o ON o.user_id = r.user_id AND o.pos = r.pos + 1)
SELECT user_id, event_id FROM r WHERE kept"""
)
def status_updates(spark, sf_dir):
    """Updates that are at least a gap apart, and all final ones (purchases)."""
    return throttled(event_stream(spark, sf_dir, (F.col("event_type") == "purchase").alias("final")), _HOURS * 3600)


# -- the job machine --------------------------------------------------------------------------------------------------

# States that a job ends in, and reasons why a command is refused.
ENDED = ("done", "cancelled", "error")
NO_CHUNKS, RUNNING, FINISHED, NOT_RUNNING = "chunks_not_ready", "already_generating", "already_finished", "not_generating"


def move(state: tuple[bool, str, bool], command: str) -> tuple[tuple[bool, str, bool], str]:
    """(chunks ready, status, cancel requested) after a command, and why it is refused, or an empty text."""
    chunks, status, cancel = state
    match command:
        case "chunks":
            return (True, status, cancel), ""
        case "generate" if not chunks:
            return state, NO_CHUNKS
        case "generate" if status == "generating":
            return state, RUNNING
        case "generate":
            return (chunks, "generating", False), ""
        case "cancel" if status in ENDED:
            return state, FINISHED
        case "cancel":
            return (chunks, status, True), ""
        case "finish" | "fail" if status != "generating":
            return state, NOT_RUNNING
        case "finish":
            return (chunks, "cancelled" if cancel else "done", False), ""
        case "fail":
            return (chunks, "error", cancel), ""
    return state, "unknown_command"


class Jobs(InOrder):
    """One row a command: what became of it, and the job's state behind it."""

    columns = ["event_id", "job", "command", "refused", "status", "cancel_requested"]

    def open(self, handle) -> None:
        self.state = handle.getValueState("job", "chunks boolean, status string, cancel boolean")

    def start(self, key) -> None:
        self.now = tuple(self.state.get()) if self.state.exists() else (False, "new", False)

    def row(self, key, r):
        self.now, refused = move(self.now, r.command)
        return r.event_id, key[0], r.command, refused, self.now[1], self.now[2]

    def end(self) -> None:
        self.state.update(self.now)

    def forget(self) -> None:
        self.state.clear()


def job_log(rows: DataFrame) -> DataFrame:
    """All commands with their outcome; the refused ones are those with a reason. rows have ts, at, event_id, user_id and command."""
    return processed(rows, "user_id", Jobs(), "event_id long, job long, command string, refused string, status string, cancel_requested boolean")


_COMMANDS = {"signup": "chunks", "click": "generate", "purchase": "finish", "view": "fail", "error": "cancel"}
_COMMAND_SQL = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in _COMMANDS.items()) + " END"
_STEP = f"""CASE WHEN command = 'generate' AND NOT chunks THEN '{NO_CHUNKS}' WHEN command = 'generate' AND status = 'generating' THEN '{RUNNING}' WHEN command = 'cancel' AND status IN {ENDED} THEN '{FINISHED}'
 WHEN command IN ('finish', 'fail') AND status <> 'generating' THEN '{NOT_RUNNING}' ELSE '' END"""


@query(
    f"""WITH RECURSIVE o AS (SELECT event_id, user_id, {_COMMAND_SQL} AS command, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
r(user_id, pos, event_id, command, refused, chunks, status, cancel) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, '', '', false, 'new', false FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT user_id, pos, event_id, command, refused, chunks OR command = 'chunks', CASE WHEN refused <> '' THEN status WHEN command = 'generate' THEN 'generating' WHEN command = 'finish' THEN CASE WHEN cancel THEN 'cancelled' ELSE 'done' END WHEN command = 'fail' THEN 'error' ELSE status END,
  CASE WHEN refused <> '' THEN cancel WHEN command = 'cancel' THEN true WHEN command IN ('generate', 'finish') THEN false ELSE cancel END
  FROM (SELECT *, {_STEP} AS refused FROM (SELECT o.user_id, o.pos, o.event_id, o.command, r.chunks, r.status, r.cancel FROM r JOIN o ON o.user_id = r.user_id AND o.pos = r.pos + 1)))
SELECT event_id, user_id AS job, command, refused, status, cancel AS cancel_requested FROM r WHERE pos > 0"""
)
def job_states(spark, sf_dir):
    """Commands to jobs, one job a user: which moves are allowed, which are refused and why; a late cancel changes nothing."""
    return job_log(event_stream(spark, sf_dir, F.expr(_COMMAND_SQL).alias("command")))


# -- practice sessions ------------------------------------------------------------------------------------------------

#: Questions that a session's bank may have; they are sent to all tasks.
BANK = 100_000


class Bank:
    """Questions in order, gathered in cells of one topic, level and skill, since the choice depends on these alone."""

    def __init__(self, rows: list[tuple]):
        """rows: (question, topic, level, skill) in order."""
        cells: dict[tuple, list[int]] = {}
        for k, (_, *cell) in enumerate(rows):
            cells.setdefault(tuple(cell), []).append(k)
        self.question = [r[0] for r in rows]
        self.cells, self.members = list(cells), list(cells.values())
        self.topics = sorted({c[0] for c in cells})
        self.topic = np.array([self.topics.index(c[0]) for c in cells], np.int64)
        self.level = np.array([c[1] for c in cells], np.int64)
        self.skill = np.array([c[2] for c in cells], object)


def next_cell(bank: Bank, used: np.ndarray, seen: np.ndarray, streak: int, last: tuple | None) -> int | None:
    """The cell of the next question: after a wrong answer near the last one, on a streak of two harder, else of a topic seen least.

    used says how many questions of each cell are served, seen how many answers each topic has; last is the topic's number,
    level, skill and verdict of the last answer. Ties go to the question that comes first.
    """
    left = np.array([len(m) for m in bank.members]) - used
    if not (left > 0).any():
        return None
    first = np.array([m[min(u, len(m) - 1)] for m, u in zip(bank.members, used, strict=True)])
    if last and not last[3]:
        topic, level, skill, _ = last
        near = np.where(bank.topic == topic, 0, np.where(bank.skill == skill, 1, 2))
        keys = (near, bank.level > level, bank.level)
    elif streak >= 2:
        keys = (-bank.level, seen[bank.topic], 0 * bank.level)
    else:
        keys = (seen[bank.topic], np.abs(bank.level - 1), 0 * bank.level)
    return int(np.lexsort((first, *keys[::-1], left <= 0))[0])


class Practice(InOrder):
    """One row an answer: the question answered, the session's counts, and the question that comes next."""

    columns = ["event_id", "session", "question", "is_correct", "answered", "correct", "streak", "next_question"]

    def __init__(self, bank: Bank):
        self.bank = bank

    def open(self, handle) -> None:
        self.state = handle.getValueState("session", "current int, answered long, correct long, streak long, level int, topic int, skill string, good boolean")
        self.served = handle.getMapState("served", "cell int", "n int")
        self.topics = handle.getMapState("topics", "topic int", "n int")

    def start(self, key) -> None:
        b = self.bank
        self.used, self.seen = np.zeros(len(b.cells), np.int64), np.zeros(len(b.topics), np.int64)
        self.changed: set[int] = set()
        for k, n in self.served.iterator():
            self.used[k[0]] = n[0]
        for k, n in self.topics.iterator():
            self.seen[k[0]] = n[0]
        if self.state.exists():
            current, self.answered, self.correct, self.streak, level, topic, skill, good = self.state.get()
            self.current, self.last = current, None if level is None else (topic, level, skill, good)
        else:
            self.answered, self.correct, self.streak, self.last, self.current = 0, 0, 0, None, None
            self.serve()

    def serve(self) -> None:
        cell = next_cell(self.bank, self.used, self.seen, self.streak, self.last)
        self.current = None if cell is None else cell
        self.question = None if cell is None else self.bank.members[cell][self.used[cell]]
        if cell is not None:
            self.used[cell] += 1
            self.changed.add(cell)

    def row(self, key, r):
        b, cell = self.bank, self.current
        if cell is None:
            return r.event_id, key[0], None, r.good, self.answered, self.correct, self.streak, None
        asked = b.question[b.members[cell][self.used[cell] - 1]]
        self.answered, self.correct, self.streak = self.answered + 1, self.correct + r.good, self.streak + 1 if r.good else 0
        topic = int(b.topic[cell])
        self.seen[topic] += 1
        self.last = (topic, int(b.level[cell]), b.skill[cell], bool(r.good))
        self.serve()
        return r.event_id, key[0], asked, r.good, self.answered, self.correct, self.streak, None if self.question is None else b.question[self.question]

    def end(self) -> None:
        topic, level, skill, good = self.last or (None, None, None, None)
        self.state.update((self.current, int(self.answered), int(self.correct), int(self.streak), level, topic, skill, good))
        for cell in self.changed:
            self.served.updateValue((cell,), (int(self.used[cell]),))
        for topic in np.flatnonzero(self.seen).tolist():
            self.topics.updateValue((topic,), (int(self.seen[topic]),))

    def forget(self) -> None:
        for state in (self.state, self.served, self.topics):
            state.clear()


def practice_log(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """One row an answer of a stream with ts, at, event_id, user_id and good; questions have question, topic, level and skill.

    Raises ValueError for a bank that is too large to be sent to all tasks. Answers beyond the last question count nothing.
    """
    rows = questions.select("question", "topic", F.col("level").cast("int"), "skill").orderBy("question").limit(BANK + 1).collect()
    if len(rows) > BANK:
        raise ValueError(f"a bank of more than {BANK} questions")
    return processed(answers, "user_id", Practice(Bank([tuple(r) for r in rows])), "event_id long, session long, question long, is_correct boolean, answered long, correct long, streak long, next_question long")


_BANK_COLUMNS = ("item_id AS question", "concat('t', CAST(item_id % 5 AS STRING)) AS topic", "CAST(length(text) % 4 AS INT) AS level", "concat('s', CAST(item_id % 7 AS STRING)) AS skill")
_SEEN = "len(list_filter(topics, lambda t: t = b.topic))"
_WRONG = "last_topic IS NOT NULL AND NOT good"
_SCORE = [
    f"CASE WHEN {_WRONG} THEN CASE WHEN b.topic = last_topic THEN 0 WHEN b.skill = last_skill THEN 1 ELSE 2 END WHEN streak >= 2 THEN -b.level ELSE {_SEEN} END",
    f"CASE WHEN {_WRONG} THEN CASE WHEN b.level <= last_level THEN 0 ELSE 1 END WHEN streak >= 2 THEN {_SEEN} ELSE abs(b.level - 1) END",
    f"CASE WHEN {_WRONG} THEN b.level ELSE 0 END",
    "b.question",
]


@query(
    f"""WITH RECURSIVE b AS (SELECT {', '.join(_BANK_COLUMNS)} FROM benchmark), o AS (SELECT event_id, user_id, event_type <> 'error' AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
s AS (SELECT question, topic, level, skill FROM b ORDER BY abs(level - 1), question LIMIT 1),
r(user_id, pos, event_id, asked, good, answered, correct, streak, topics, last_topic, last_level, last_skill, served, question, topic, level, skill) AS (
 SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::INTEGER, NULL::VARCHAR, [s.question], s.question, s.topic, s.level, s.skill FROM (SELECT DISTINCT user_id FROM events), s
 UNION ALL SELECT user_id, pos, event_id, asked, good, answered, correct, streak, topics, last_topic, last_level, last_skill, CASE WHEN q IS NULL THEN served ELSE list_append(served, q) END, q, q_topic, q_level, q_skill FROM (
  SELECT a.*, b.question AS q, b.topic AS q_topic, b.level AS q_level, b.skill AS q_skill, row_number() OVER (PARTITION BY a.user_id ORDER BY {', '.join(_SCORE)}) AS k FROM (
   SELECT o.user_id, o.pos, o.event_id, r.question AS asked, o.good, r.answered + CASE WHEN r.question IS NULL THEN 0 ELSE 1 END AS answered, r.correct + CASE WHEN o.good AND r.question IS NOT NULL THEN 1 ELSE 0 END AS correct,
    CASE WHEN r.question IS NULL THEN r.streak WHEN o.good THEN r.streak + 1 ELSE 0 END AS streak, CASE WHEN r.question IS NULL THEN r.topics ELSE list_append(r.topics, r.topic) END AS topics,
    coalesce(r.topic, r.last_topic) AS last_topic, coalesce(r.level, r.last_level) AS last_level, coalesce(r.skill, r.last_skill) AS last_skill, r.served
   FROM r JOIN o ON o.user_id = r.user_id AND o.pos = r.pos + 1) a LEFT JOIN b ON NOT list_contains(a.served, b.question)) WHERE k = 1)
SELECT event_id, user_id AS session, asked AS question, good AS is_correct, answered, correct, streak, question AS next_question FROM r WHERE pos > 0""".replace("AS STRING", "AS VARCHAR")
)
def practice_sessions(spark, sf_dir):
    """Practice over a bank of questions, one session a user: each answer moves the counts and chooses what comes next."""
    answers = event_stream(spark, sf_dir, (F.col("event_type") != "error").alias("good"))
    return practice_log(answers, read(spark, sf_dir, "benchmark").selectExpr(*_BANK_COLUMNS))
