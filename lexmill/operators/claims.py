"""Numeric claims and answer keys, lenient JSON and label blocks, step buckets, and closed-form verifier engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.plans.registry import query, read
from lexmill.plans.shared import steps_sql, values, with_steps

NAMES = "claim_id answer final expected d1 d2 d3".split()
#: Answers in the forms that are read: fractions, decimal commas, units, equations, signs.
SAMPLES = [
    (1, "x = 3", "3", "3", "4", "5", "6"),
    (2, "\\frac{1}{2}", "0,5", "0.5", "1", "2", "3"),
    (3, "34 lít", "34,5 lít", "34.5", "34,5 lít", "35 lít", "36 lít"),
    (4, "12", "-12", "-12", "−12", "13", "14"),
    (5, "S = \\dfrac{9}{2}", "4,5", "4.5", "9", "2", "18"),
    (6, "7 m2", "8 m2", "8", "8", "8,0", "9"),
    (7, "không có", "5", "5", "5", "6", "7"),
    (8, "2/3", "0.6667", "0.6666667", "1/3", "3/2", "1"),
    (9, "10 cm", "", "12", "12 cm", "11", "14"),
]
_BULK = """SELECT 100 + o_orderkey AS claim_id, 'x = ' || CAST(o_orderkey % 40 AS STRING) || CASE o_custkey % 3 WHEN 0 THEN ' m' WHEN 1 THEN ',5' ELSE '/4' END AS answer, CAST(o_custkey % 40 AS STRING) AS final, CAST(o_custkey % 40 AS STRING) AS expected,
 CAST(o_custkey % 40 AS STRING) || ' cm' AS d1, CAST(o_orderkey % 7 AS STRING) AS d2, CAST(o_orderkey % 11 AS STRING) || ',5' AS d3 FROM orders"""
SOURCE = f"SELECT {', '.join(NAMES)} FROM ({values(SAMPLES, NAMES)}) UNION ALL {_BULK}"


def claims(spark, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame(SAMPLES, ", ".join(f"{n} {'long' if n == 'claim_id' else 'string'}" for n in NAMES))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    tail = F.when(c % 3 == 0, " m").when(c % 3 == 1, ",5").otherwise("/4")
    rows = read(spark, sf_dir, "orders").select(
        (k + 100).alias("claim_id"), F.concat(F.lit("x = "), text(k % 40), tail).alias("answer"), text(c % 40).alias("final"), text(c % 40).alias("expected"), F.concat(text(c % 40), F.lit(" cm")).alias("d1"), text(k % 7).alias("d2"), F.concat(text(k % 11), F.lit(",5")).alias("d3")
    )
    return samples.unionByName(rows)


_FRAC = "d?frac *[{] *([-+]?[0-9]+([.][0-9]+)?) *[}] *[{] *([-+]?[0-9]+([.][0-9]+)?) *[}]"


def _number(c: str) -> list[list[str]]:
    """Steps that read the claimed number of column c as v_c: behind the last =, fractions, comma as point, units off."""
    return [
        [f"replace(@at(regexp_extract_all({c}, '[^=]*$', 0), 1), '−', '-') AS a_{c}"],
        [f"replace(a_{c}, chr(92), '') AS b_{c}"],
        [f"@at(regexp_extract_all(b_{c}, '{_FRAC}', 1), 1) AS p_{c}", f"@at(regexp_extract_all(b_{c}, '{_FRAC}', 3), 1) AS q_{c}", f"regexp_replace(b_{c}, '(cm2|cm²|m2|m²|đơn vị|units?)', ' '@g) AS e_{c}"],
        [f"replace(@at(regexp_extract_all(e_{c}, '-?[0-9]+([.,][0-9]+)?( */ *-?[0-9]+([.,][0-9]+)?)?', 0), 1), ',', '.') AS g_{c}"],
        [
            f"CASE WHEN p_{c} IS NOT NULL THEN CAST(p_{c} AS DOUBLE) / nullif(CAST(q_{c} AS DOUBLE), 0) WHEN contains(g_{c}, '/') THEN CAST(trim(split_part(g_{c}, '/', 1)) AS DOUBLE) / nullif(CAST(trim(split_part(g_{c}, '/', 2)) AS DOUBLE), 0) ELSE CAST(g_{c} AS DOUBLE) END AS v_{c}"
        ],
    ]


_READ = _number("answer")


@query(f"SELECT claim_id, round(v_answer, 9) AS value FROM ({steps_sql(SOURCE, _READ)})")
def numeric_claims(spark, sf_dir):
    """The number that an answer's text claims, or null."""
    return with_steps(claims(spark, sf_dir), _READ).select("claim_id", F.round("v_answer", 9).alias("value"))


_close = lambda a, b: f"coalesce(abs({a} - {b}) <= greatest(1e-6, abs({b}) * 1e-4), FALSE)"
_COMPARE = [*_READ, *_number("final"), ["CAST(expected AS DOUBLE) AS wanted"], [f"{_close('v_answer', 'wanted')} AS matches", f"{_close('v_final', 'wanted')} AS supported"]]


@query(f"SELECT claim_id, matches, supported, matches OR v_answer IS NULL AS accepted FROM ({steps_sql(SOURCE, _COMPARE)})")
def numeric_matches(spark, sf_dir):
    """Whether an answer and a solution's final answer come within the tolerance of the verified value; no number is no contradiction."""
    return with_steps(claims(spark, sf_dir), _COMPARE).select("claim_id", "matches", "supported", F.expr("matches or v_answer is null").alias("accepted"))


_REPAIR = [
    *_COMPARE,
    *(step for c in ("d1", "d2", "d3") for step in _number(c)),
    [" + ".join(f"CASE WHEN {_close(f'v_{c}', 'wanted')} THEN 1 ELSE 0 END" for c in ("d1", "d2", "d3")) + " AS hits", "CASE " + " ".join(f"WHEN {_close(f'v_{c}', 'wanted')} THEN {c}" for c in ("d1", "d2", "d3")) + " END AS better"],
    ["NOT matches AND supported AND hits = 1 AND trim(answer) <> '' AS repaired"],
    ["CASE WHEN repaired THEN better ELSE answer END AS key_text", *(f"CASE WHEN repaired AND {c} = better THEN answer ELSE {c} END AS new_{c}" for c in ("d1", "d2", "d3"))],
]


@query(f"SELECT claim_id, repaired, key_text, concat_ws('|', new_d1, new_d2, new_d3) AS options FROM ({steps_sql(SOURCE, _REPAIR)})")
def answer_repair(spark, sf_dir):
    """Swaps answer and distractor where the solution supports the verified value and just one distractor has it."""
    return with_steps(claims(spark, sf_dir), _REPAIR).select("claim_id", "repaired", "key_text", F.concat_ws("|", "new_d1", "new_d2", "new_d3").alias("options"))


# -- JSON and label blocks ----------------------------------------------------------------------------------------------

_JSON_NAMES = ["reply_id", "reply"]
REPLIES = [
    (1, 'Here it is: {"a": 1, "b": "x"} thanks'),
    (2, '```json\n{"expr": "\\frac{1}{2}"}\n```'),
    (3, '[{"q": 1}, {"q": 2}]'),
    (4, "no object at all"),
    (5, '{"t": "\\(x\\)"}'),
    (6, "{broken"),
    (7, 'type: numeric_eval\npayload: {"expr": "1+1", "expected_numeric": 2}'),
    (8, "type: none\npayload: none"),
    (9, ""),
]
_JSON_SOURCE = f"SELECT reply_id, reply FROM ({values(REPLIES, _JSON_NAMES)}) UNION ALL SELECT 100 + event_id AS reply_id, 'reply ' || props || ' end' AS reply FROM events"
_FENCE = "^[ \n]*```(json)?[ \n]*|[ \n]*```[ \n]*$"
#: Commands whose backslash is doubled before parsing, so that the parser takes it as itself.
# Commands of LaTeX.
_LATEX = "frac|sqrt|binom|int|sum|prod|lim|sin|cos|tan|cot|sec|csc|log|ln|exp|left|right|cdot|times|mathrm|text|operatorname|[(),;!]"
_PARSE = [
    [f"regexp_replace(trim(reply), '{_FENCE}', ''@g) AS bare"],
    # a backslash before a command is written as a mark and then twice
    [f"replace(regexp_replace(replace(bare, chr(92), '¦'), '¦({_LATEX})', '§§$1'@g), '¦', chr(92)) AS marked"],
    ["replace(marked, '§', chr(92)) AS repaired"],
    ["CASE WHEN repaired LIKE '[%' THEN '{\"questions\": ' || repaired || '}' WHEN repaired LIKE '{%' AND repaired LIKE '%}' THEN repaired ELSE @at(regexp_extract_all(replace(repaired, chr(10), ' '), '[{].*[}]', 0), 1) END AS found"],
]


def _duck_parse() -> str:
    return steps_sql(_JSON_SOURCE, _PARSE).replace("§§$1", "§§\\1")


@query(f"SELECT reply_id, TRY_CAST(found AS JSON) IS NOT NULL AS parsed, CASE WHEN TRY_CAST(found AS JSON) IS NOT NULL THEN found END AS object FROM ({_duck_parse()})")
def json_objects(spark, sf_dir):
    """The first JSON object of a reply: fences off, backslashes of LaTeX repaired, an array wrapped; null where none parses."""
    replies = spark.createDataFrame(REPLIES, "reply_id long, reply string")
    rows = replies.unionByName(read(spark, sf_dir, "events").select((F.col("event_id") + 100).alias("reply_id"), F.concat(F.lit("reply "), "props", F.lit(" end")).alias("reply")))
    parsed = F.try_parse_json("found").isNotNull()
    return with_steps(rows, _PARSE).select("reply_id", parsed.alias("parsed"), F.when(parsed, F.col("found")).alias("object"))


_HINT = [
    ["coalesce(nullif(@at(regexp_extract_all(reply, 'type *: *([^ \n]+)', 1), 1), ''), 'none') AS type", "@at(regexp_extract_all(replace(reply, chr(10), ' '), 'payload *: *([{].*[}])', 1), 1) AS raw"],
    ["CASE WHEN raw IS NULL OR raw = '' THEN '{}' ELSE raw END AS payload"],
]


@query(f"SELECT reply_id, type, CASE WHEN TRY_CAST(payload AS JSON) IS NOT NULL THEN payload ELSE '{{}}' END AS payload FROM ({steps_sql(_JSON_SOURCE, _HINT)}) WHERE contains(reply, 'type')")
def label_blocks(spark, sf_dir):
    """A verifier hint from a labelled block: its type and JSON payload, with defaults for what is missing or broken."""
    replies = spark.createDataFrame(REPLIES, "reply_id long, reply string")
    rows = replies.unionByName(read(spark, sf_dir, "events").select((F.col("event_id") + 100).alias("reply_id"), F.concat(F.lit("reply "), "props", F.lit(" end")).alias("reply")))
    rows = with_steps(rows.filter("contains(reply, 'type')"), _HINT)
    return rows.select("reply_id", "type", F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).otherwise("{}").alias("payload"))


# -- engines -----------------------------------------------------------------------------------------------------------

_E = ["o_orderkey % 5 - 2 AS a", "o_custkey % 5 - 2 AS b", "o_orderkey % 3 - 1 AS c", "o_custkey % 7 - 3 AS d", "o_orderkey % 11 - 5 AS p", "o_custkey % 11 - 5 AS q", "o_orderkey AS claim_id"]
_ENGINE_SOURCE = f"SELECT {', '.join(_E)} FROM orders"


def _ints(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*_E)


_EIGEN = [["a + d AS trace", "a * d - b * c AS det"], ["trace * trace - 4 * det AS disc"], ["p + q = trace AND p * q = det AS verified", "CASE WHEN disc >= 0 THEN round((trace + sqrt(CAST(greatest(disc, 0) AS DOUBLE))) / 2, 6) END AS larger"]]


@query(f"SELECT claim_id, verified, larger FROM ({steps_sql(_ENGINE_SOURCE, _EIGEN)})")
def verify_eigenvalues(spark, sf_dir):
    """Claimed eigenvalues p and q of [[a, b], [c, d]]: their sum is the trace and their product the determinant."""
    return with_steps(_ints(spark, sf_dir), _EIGEN).select("claim_id", "verified", "larger")


_INVERSE = [["a * d - b * c AS det"], ["det <> 0 AND a * p + b * q = det AND c * p + d * q = 0 AS verified", "CASE WHEN det <> 0 THEN a * d - b * c = det AND a * (-b) + b * a = 0 AND c * d + d * (-c) = 0 END AS adjugate"]]


@query(f"SELECT claim_id, verified, adjugate FROM ({steps_sql(_ENGINE_SOURCE, _INVERSE)})")
def verify_inverse(spark, sf_dir):
    """Whether (p, q) / det is the first column of an inverse, and that the adjugate over det is one; singular matrices have none."""
    return with_steps(_ints(spark, sf_dir), _INVERSE).select("claim_id", "verified", "adjugate")


_PRODUCT = [["a * p + b * q AS e0", "a * q + b * p AS e1", "c * p + d * q AS e2", "c * q + d * p AS e3"], ["e0 = p AND e1 = q AND e2 = q AND e3 = p AS verified"]]


@query(f"SELECT claim_id, concat_ws(',', CAST(e0 AS STRING), CAST(e1 AS STRING), CAST(e2 AS STRING), CAST(e3 AS STRING)) AS product, verified FROM ({steps_sql(_ENGINE_SOURCE, _PRODUCT)})")
def verify_product(spark, sf_dir):
    """The product of [[a, b], [c, d]] and [[p, q], [q, p]], against the claim that it is the second one."""
    return with_steps(_ints(spark, sf_dir), _PRODUCT).select("claim_id", F.concat_ws(",", "e0", "e1", "e2", "e3").alias("product"), "verified")


_ROOTS = [["b * b - 4 * a * c AS disc", "CASE WHEN a = 0 THEN 1 ELSE 2 END AS degree"], ["CASE WHEN a = 0 AND b = 0 THEN CASE WHEN c = 0 THEN -1 ELSE 0 END WHEN degree = 1 OR disc = 0 THEN 1 ELSE 2 END AS roots"], ["CASE WHEN roots = -1 THEN NULL WHEN roots = 0 THEN FALSE WHEN roots = 1 THEN p = q AND a * p * p + b * p + c = 0 ELSE p <> q AND a * p * p + b * p + c = 0 AND a * q * q + b * q + c = 0 END AS verified"]]


@query(f"SELECT claim_id, roots::BIGINT AS roots, verified FROM ({steps_sql(_ENGINE_SOURCE, _ROOTS)})")
def verify_equation(spark, sf_dir):
    """Claimed roots p and q of a x^2 + b x + c = 0 as a set; null where every number is a root."""
    return with_steps(_ints(spark, sf_dir), _ROOTS).select("claim_id", F.col("roots").cast("long").alias("roots"), "verified")


_TRIANGLE = [
    ["(a - c) * (a - c) + (b - d) * (b - d) AS ab", "(c - p) * (c - p) + (d - q) * (d - q) AS bc", "(p - a) * (p - a) + (q - b) * (q - b) AS ca", "abs((c - a) * (q - b) - (p - a) * (d - b)) AS twice"],
    ["twice > 0 AND (ab + bc = ca OR bc + ca = ab OR ca + ab = bc) AS is_right", "twice = 2 * (p - q) AS verified", "round(sqrt(CAST(ab AS DOUBLE)) + sqrt(CAST(bc AS DOUBLE)) + sqrt(CAST(ca AS DOUBLE)), 6) AS perimeter"],
]


@query(f"SELECT claim_id, twice AS twice_area, is_right, perimeter, verified FROM ({steps_sql(_ENGINE_SOURCE, _TRIANGLE)})")
def verify_triangle(spark, sf_dir):
    """Area, perimeter and right angle of the triangle (a, b), (c, d), (p, q), against a claimed area of p - q."""
    return with_steps(_ints(spark, sf_dir), _TRIANGLE).select("claim_id", F.col("twice").alias("twice_area"), "is_right", "perimeter", "verified")


_TRUTH = [["a > 0 AS x", "b > 0 AS y", "p > 0 AS claimed"], ["(NOT x OR y) AND (x OR NOT y) AS actual"], ["actual = claimed AS verified"]]


@query(f"SELECT claim_id, actual, verified FROM ({steps_sql(_ENGINE_SOURCE, _TRUTH)})")
def verify_truth(spark, sf_dir):
    """A row of a truth table: the value of (x implies y) and (y implies x) under an assignment, against a claimed one."""
    return with_steps(_ints(spark, sf_dir), _TRUTH).select("claim_id", "actual", "verified")


_AT = [f"(0.5 + 0.4 * {k} + claim_id % 10 / 10.0)" for k in range(5)]
_TRIG = [[" AND ".join(f"abs(sin({x}) * sin({x}) + CASE WHEN a >= 0 THEN 1 ELSE -1 END * cos({x}) * cos({x}) - CASE WHEN b >= 0 THEN 1 ELSE -cos(2 * {x}) END) < 1e-6" for x in _AT) + " AS verified"]]


@query(f"SELECT claim_id, verified FROM ({steps_sql(_ENGINE_SOURCE, _TRIG)})")
def verify_identity(spark, sf_dir):
    """Claimed identities of sin^2 ± cos^2 at five points: with plus it is 1, with minus -cos 2x."""
    return with_steps(_ints(spark, sf_dir), _TRIG).select("claim_id", "verified")


_LIMIT = [["CASE WHEN d <> 0 THEN CAST(b AS DOUBLE) / d WHEN b = 0 THEN NULL ELSE CASE WHEN b > 0 THEN 1e308 ELSE -1e308 END END AS actual"], ["CASE WHEN d <> 0 THEN b = p * d WHEN b = 0 THEN NULL ELSE FALSE END AS verified"]]


@query(f"SELECT claim_id, actual, verified FROM ({steps_sql(_ENGINE_SOURCE, _LIMIT)})")
def verify_limit(spark, sf_dir):
    """The limit of (a + b n) / (c + d n) for growing n, against p: the quotient of the leading terms, or unbounded."""
    return with_steps(_ints(spark, sf_dir), _LIMIT).select("claim_id", "actual", "verified")


#: Steps of an explanation in two to four buckets, the rest in the last one.
_STEPS = [
    ["regexp_extract_all(text, '[^.!?]+[.!?]', 0) AS parts"],
    ["@size(parts) AS n"],
    ["CASE WHEN n >= 8 THEN 4 WHEN n >= 6 THEN 3 ELSE 2 END AS buckets"],
    ["CAST(floor(n / buckets) AS BIGINT) AS each_", "n - CAST(floor(n / buckets) AS BIGINT) * (buckets - 1) AS last"],
]


@query(f"SELECT conv_id, turn, n::BIGINT AS n, buckets::BIGINT AS buckets, each_, last::BIGINT AS last FROM ({steps_sql('SELECT conv_id, turn, coalesce(text, chr(32)) AS text FROM conversations', _STEPS)})")
def step_buckets(spark, sf_dir):
    """How an explanation's sentences are dealt to two, three or four steps."""
    rows = with_steps(read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "coalesce(text, ' ') as text"), _STEPS)
    return rows.select("conv_id", "turn", F.col("n").cast("long").alias("n"), F.col("buckets").cast("long").alias("buckets"), "each_", F.col("last").cast("long").alias("last"))
