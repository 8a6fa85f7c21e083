"""Records, plans, settings and jobs: parsing candidates from JSON, plan edits, warnings, state machines, cancelling, times, mode switch."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.order import lagged
from lexmill.operators import rules
from lexmill.operators.verify import verdicts
from lexmill.plans.registry import query, read
from lexmill.plans.shared import steps_sql, values, with_steps

# -- candidates as JSON --------------------------------------------------------------------------------------------------

# The names under which replies give a field, the first that is there counts.
ALIASES = {"stem": ["question_text", "question", "stem"], "answer": ["answer_text", "correct_answer", "answer"], "quote": ["source_quote_text", "source_quote", "quote"]}
_JSON = [
    ["replace(replace(replace(stem, chr(92), '/'), chr(34), ''), chr(10), ' ') AS s", "replace(replace(replace(answer, chr(92), '/'), chr(34), ''), chr(10), ' ') AS a", "CASE item_id % 3 WHEN 0 THEN 'question_text' WHEN 1 THEN 'question' ELSE 'stem' END AS k1", "CASE item_id % 2 WHEN 0 THEN 'answer_text' ELSE 'correct_answer' END AS k2"],
    ["'{' || chr(34) || k1 || chr(34) || ': ' || chr(34) || s || chr(34) || ', ' || chr(34) || k2 || chr(34) || ': ' || chr(34) || a || chr(34) || CASE item_id % 7 WHEN 0 THEN '' ELSE '}' END AS reply"],
]


def _get(engine: str, names: list[str]) -> str:
    path = (lambda n: f"get_json_object(reply, '$.{n}')") if engine == "spark" else (lambda n: f"json_extract_string(TRY_CAST(reply AS JSON), '$.{n}')")
    return f"coalesce({', '.join(path(n) for n in names)})"


@query(f"SELECT item_id, TRY_CAST(reply AS JSON) IS NOT NULL AS parsed, {', '.join(f'{_get("duck", names)} AS {field}' for field, names in ALIASES.items() if field != 'quote')} FROM ({steps_sql(rules.SOURCE, _JSON)})")
def parsed_candidates(spark, sf_dir):
    """Candidates from JSON replies, fields under any of their names; broken replies give nothing."""
    rows = with_steps(rules.candidates(spark, sf_dir), _JSON)
    whole = F.try_parse_json("reply").isNotNull()
    return rows.select("item_id", whole.alias("parsed"), *(F.when(whole, F.expr(_get("spark", names))).alias(field) for field, names in ALIASES.items() if field != "quote"))


@query(f"SELECT item_id, answer FROM ({rules.SOURCE}) WHERE answer <> ''")
def accepted_questions(spark, sf_dir):
    """Records that have an answer."""
    return rules.candidates(spark, sf_dir).filter("answer <> ''").select("item_id", "answer")


# -- plans and settings ------------------------------------------------------------------------------------------------

_SLOTS = [
    ["o_orderkey AS slot", "o_orderkey % 6 = 0 AS deleted", "CASE o_custkey % 3 WHEN 0 THEN 'nested ' || CAST(o_custkey AS STRING) END AS nested", "'flat ' || CAST(o_custkey AS STRING) AS flat", "CASE o_orderkey % 4 WHEN 0 THEN 'conceptual' WHEN 1 THEN 'application' WHEN 2 THEN '' ELSE 'reasoning' END AS pattern", "o_custkey % 2 = 0 AS calculate", "CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_orderkey % 7 END AS asked"],
    ["coalesce(nested, flat) AS topic", "CASE WHEN calculate AND NOT contains(pattern, 'concept') THEN 'computation' ELSE pattern END AS final", "CASE WHEN asked > 0 THEN asked ELSE 1 END AS wanted"],
]


@query(f"SELECT slot, topic, final AS pattern, wanted::BIGINT AS wanted FROM ({steps_sql('SELECT * FROM orders', _SLOTS)}) WHERE NOT deleted")
def plan_slots(spark, sf_dir):
    """A plan's slots after editing: deleted ones gone, nested values over flat ones, settings applied, counts made safe."""
    rows = with_steps(read(spark, sf_dir, "orders"), _SLOTS).filter("not deleted")
    return rows.select("slot", "topic", F.col("final").alias("pattern"), F.col("wanted").cast("long").alias("wanted"))


# Settings and what they are without a choice.
DEFAULTS = [("language", "vi"), ("level", "Thông hiểu"), ("count", "12"), ("mode", "fast")]
_GIVEN = "SELECT o_custkey AS job, CASE o_orderkey % 5 WHEN 0 THEN 'language' WHEN 1 THEN 'level' WHEN 2 THEN 'count' WHEN 3 THEN 'mode' ELSE 'odd' END AS name, CASE o_orderkey % 3 WHEN 0 THEN '' ELSE CAST(o_orderkey % 40 AS STRING) END AS value, o_orderkey AS turn FROM orders"


@query(
    f"""WITH d AS ({values(DEFAULTS, ["name", "value"])}), g AS ({_GIVEN}), l AS (SELECT job, name, arg_max(value, turn) AS value FROM g WHERE value <> '' GROUP BY job, name), j AS (SELECT DISTINCT job FROM g)
SELECT j.job, d.name, coalesce(l.value, d.value) AS value, l.value IS NULL OR l.value = d.value AS is_default FROM j CROSS JOIN d LEFT JOIN l ON l.job = j.job AND l.name = d.name"""
)
def merged_settings(spark, sf_dir):
    """Each job's settings: the last value given over the default; unknown names and empty values don't count."""
    given = read(spark, sf_dir, "orders").selectExpr(*(x.strip() for x in rules._split(_GIVEN[len("SELECT ") : -len(" FROM orders")])))
    last = given.filter("value <> ''").groupBy("job", "name").agg(F.max_by("value", "turn").alias("given"))
    defaults = spark.createDataFrame(DEFAULTS, "name string, value string")  # four rows
    rows = given.select("job").distinct().crossJoin(F.broadcast(defaults)).join(last, ["job", "name"], "left")
    return rows.select("job", "name", F.coalesce("given", "value").alias("value"), (F.col("given").isNull() | (F.col("given") == F.col("value"))).alias("is_default"))


_WARNINGS = "SELECT user_id AS slot, event_type AS kind, 'message ' || CAST(event_id % 3 AS STRING) AS message FROM events"


@query(f"WITH w AS (SELECT DISTINCT * FROM ({_WARNINGS}) WHERE kind <> 'view') SELECT slot, count(*) AS n, string_agg(DISTINCT message, '; ' ORDER BY message) AS messages FROM w GROUP BY slot")
def kept_warnings(spark, sf_dir):
    """Warnings of a slot, each once, without a kind that was pruned, and the messages that are left."""
    rows = read(spark, sf_dir, "events").selectExpr("user_id as slot", "event_type as kind", "concat('message ', event_id % 3) as message").filter("kind <> 'view'").distinct()
    return rows.groupBy("slot").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("messages"))


_TEXTS = [
    ["CASE o_orderkey % 3 WHEN 0 THEN 'algebra' WHEN 1 THEN '' ELSE 'graphs, trees' END AS focus", "CASE o_custkey % 2 WHEN 0 THEN 'formal' ELSE '' END AS tone", "o_orderkey % 5 AS a", "o_custkey % 5 AS b", "o_orderkey % 7 AS c", "o_custkey % 7 AS d", "CASE o_orderkey % 4 WHEN 0 THEN 'matrix' WHEN 1 THEN 'graph' WHEN 2 THEN 'truth_table' ELSE 'venn_diagram' END AS kind"],
    [
        "concat_ws(chr(10), CASE WHEN focus <> '' THEN '- Focus on: ' || focus END, CASE WHEN tone <> '' THEN '- Tone: ' || tone END, CASE WHEN a = 0 THEN '- Avoid trick questions' END) AS directive",
        "concat_ws(' | ', CAST(a AS STRING), CAST(b AS STRING)) AS first_row",
        "concat_ws(' | ', CAST(c AS STRING), CAST(d AS STRING)) AS second_row",
    ],
    ["CASE kind WHEN 'matrix' THEN '| ' || first_row || ' |' || chr(10) || '|---|---|' || chr(10) || '| ' || second_row || ' |' WHEN 'graph' THEN 'graph { ' || CAST(a AS STRING) || ' -- ' || CAST(b AS STRING) || '; ' || CAST(c AS STRING) || ' -- ' || CAST(d AS STRING) || '; }' WHEN 'truth_table' THEN '| p | q |' || chr(10) || '|---|---|' || chr(10) || '| ' || CASE WHEN a > b THEN 'T' ELSE 'F' END || ' | ' || CASE WHEN c > d THEN 'T' ELSE 'F' END || ' |' ELSE 'Sets: A (' || CAST(a AS STRING) || '), B (' || CAST(b AS STRING) || ')' END AS markdown"],
]


@query(f"SELECT o_orderkey AS slot, directive, kind, markdown FROM ({steps_sql('SELECT * FROM orders', _TEXTS)})")
def slot_texts(spark, sf_dir):
    """What settings ask of a writer, as a list, and a slot's figure as Markdown or as an edge list."""
    return with_steps(read(spark, sf_dir, "orders"), _TEXTS).select(F.col("o_orderkey").alias("slot"), "directive", "kind", "markdown")


_PATHS = [
    ["CASE o_orderkey % 3 WHEN 0 THEN 'plan.level' WHEN 1 THEN 'plan.quality.score' ELSE 'topic' END AS path", "CAST(o_custkey AS STRING) AS value"],
    ["split_part(path, '.', 1) AS p1", "split_part(path, '.', 2) AS p2", "split_part(path, '.', 3) AS p3"],
    ["'{' || chr(34) || p1 || chr(34) || ':' || CASE WHEN p2 = '' THEN chr(34) || value || chr(34) WHEN p3 = '' THEN '{' || chr(34) || p2 || chr(34) || ':' || chr(34) || value || chr(34) || '}' ELSE '{' || chr(34) || p2 || chr(34) || ':{' || chr(34) || p3 || chr(34) || ':' || chr(34) || value || chr(34) || '}}' END || '}' AS document"],
]


@query(f"SELECT o_orderkey AS slot, path, document FROM ({steps_sql('SELECT * FROM orders', _PATHS)})")
def nested_settings(spark, sf_dir):
    """A value set at a dotted path, with the objects above it made."""
    return with_steps(read(spark, sf_dir, "orders"), _PATHS).select(F.col("o_orderkey").alias("slot"), "path", "document")


# -- jobs ---------------------------------------------------------------------------------------------------------------

#: Which state a job may go to from which.
MOVES = [("view", "click"), ("click", "purchase"), ("click", "click"), ("view", "view"), ("purchase", "view"), ("error", "view"), ("click", "error")]
_ALLOWED = " OR ".join(f"before = '{a}' AND event_type = '{b}'" for a, b in MOVES)


@query(f"WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id, before IS NULL OR {_ALLOWED} AS allowed FROM e")
def job_moves(spark, sf_dir):
    """Whether each change of a job's state is one of its machine's moves."""
    rows = lagged(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", "before")
    return rows.select("user_id", "event_id", F.expr(f"before is null or {_ALLOWED}").alias("allowed"))


@query("WITH c AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT e.user_id, count(*) AS steps, max(event_id) AS last FROM events e LEFT JOIN c USING (user_id) WHERE stop IS NULL OR event_id < stop GROUP BY e.user_id")
def steps_before_cancel(spark, sf_dir):
    """How many steps a job makes before the first request to cancel, and the last of them."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    stop = events.filter("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("stop"))
    rows = events.join(stop, "user_id", "left").filter("stop is null or event_id < stop")
    return rows.groupBy("user_id").agg(F.count("*").alias("steps"), F.max("event_id").alias("last"))


@query("SELECT o_orderkey AS record, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS at, year(o_orderdate)::BIGINT AS year FROM orders")
def record_times(spark, sf_dir):
    """A record's time in ISO form, and its year."""
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("at"), F.year(at).cast("long").alias("year"))


PAGES = 12

@query(f"WITH p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source) SELECT CASE WHEN pages <= {PAGES} THEN source ELSE source || '/' || doc_id END AS unit, count(*) AS parts, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents JOIN p USING (source) GROUP BY 1")
def document_modes(spark, sf_dir):
    """Groups of few pages are one unit each, of others every page is one."""
    docs = read(spark, sf_dir, "documents").select("source", "doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"))
    pages = docs.groupBy("source").agg(F.count("*").alias("pages"))
    unit = F.when(F.col("pages") <= PAGES, F.col("source")).otherwise(F.concat_ws("/", "source", "doc_id"))
    return docs.join(pages, "source").groupBy(unit.alias("unit")).agg(F.count("*").alias("parts"), F.sum("n").cast("long").alias("chars"))


# -- claims of every engine ----------------------------------------------------------------------------------------------

_NAMES = "kind type a b low high verdict".split()
CLAIMS = [
    (0, "logic_equivalence", "p and q", "not (not p or not q)", 0.0, 0.0, "true"),
    (1, "logic_equivalence", "implies(p, q)", "p or not q", 0.0, 0.0, "false"),
    (2, "logic_negation", "p or q", "not p and not q", 0.0, 0.0, "true"),
    (3, "logic_negation", "p and q", "not p and not q", 0.0, 0.0, "false"),
    (4, "simplify_equiv", "(x + 1)^2", "x^2 + 2*x + 1", 0.0, 0.0, "true"),
    (5, "simplify_equiv", "sin(x)^2", "1 + cos(x)^2", 0.0, 0.0, "false"),
    (6, "derivative", "x^3 + sin(x)", "3*x^2 + cos(x)", 0.0, 0.0, "true"),
    (7, "derivative", "exp(2*x)", "exp(2*x)", 0.0, 0.0, "false"),
    (8, "integral", "3*x^2", "8", 0.0, 2.0, "true"),
    (9, "integral", "2*x", "5", 0.0, 2.0, "false"),
    (10, "probability", "1/6 + 1/3", "0.5", 0.0, 0.0, "true"),
    (11, "probability", "3/2", "1.5", 0.0, 0.0, "false"),
    (12, "numeric_eval", "binomial(5, 2) + sqrt(16)", "14", 0.0, 0.0, "true"),
    (13, "numeric_eval", "factorial(4) / 5", "5", 0.0, 0.0, "false"),
    (14, "unheard_of", "1", "1", 0.0, 0.0, None),
    (15, "derivative", "ln(", "1", 0.0, 0.0, None),
]


@query(f"WITH k AS ({values(CLAIMS, _NAMES)}) SELECT o_orderkey AS claim_id, k.type, CASE k.verdict WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS verdict FROM orders JOIN k ON k.kind = o_orderkey % {len(CLAIMS)}")
def verify_claims(spark, sf_dir):
    """Claims of all kinds of engines, each distinct one decided once; the SQL states what is true."""
    known = spark.createDataFrame([c[:-1] for c in CLAIMS], "kind long, type string, a string, b string, low double, high double")  # as many as there are kinds
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_orderkey") % len(CLAIMS)).alias("kind"))
    asked = rows.select("kind").distinct().join(F.broadcast(known), "kind").select(F.col("kind").alias("claim_id"), "type", "a", "b", "low", "high")
    told = verdicts(asked).withColumnRenamed("claim_id", "kind")
    return rows.join(F.broadcast(told), "kind").select("claim_id", "type", "verdict")

