"""The final gate over scored candidates, all metrics of a run's result file, and matrix claims of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.plans.registry import query, read
from lexmill.sources.files import written

# -- the final gate ---------------------------------------------------------------------------------------------------

# Scores below which a candidate is refused, in the order in which they decide, and the code that each gives.
QUALITY, GROUNDING, BLOOM, CLARITY, PLAUSIBILITY, UNIQUENESS = 0.45, 0.4, 0.65, 0.55, 0.55, 0.6
GATE = [
    ("quality", QUALITY, "quality_low"),
    ("grounding", GROUNDING, "grounding_low"),
    ("bloom", BLOOM, "quality_low"),
    ("clarity", CLARITY, "quality_low"),
    ("distractor_plausibility", PLAUSIBILITY, "bad_distractors"),
    ("answer_uniqueness", UNIQUENESS, "multi_answer"),
]
ACTIONS = {"grounding": "expand_context", "distractor_plausibility": "retry_distractor", "answer_uniqueness": "retry_distractor"}


def gated(rows: DataFrame) -> DataFrame:
    """rows (item_id, errored, quality, grounding, bloom, traits) with code, failed (the score that decided), score and action.

    traits is JSON of scores by trait. A score that is null, or a trait that is missing or can't be read, passes. A
    verifier's error decides before all scores. Accepted candidates have an empty code.
    """
    traits = {c: F.get_json_object("traits", f"$.{c}.score").try_cast("double") for c in ("clarity", "distractor_plausibility", "answer_uniqueness")}
    rows = rows.withColumns(traits)
    step = lambda value: F.coalesce(*(F.when(F.col(c) < least, value(c, code)) for c, least, code in GATE))
    errored = F.coalesce("errored", F.lit(False))
    code = F.when(errored, "verifier_failed").otherwise(F.coalesce(step(lambda c, code: F.lit(code)), F.lit("")))
    failed = F.when(errored, "verifier").otherwise(F.coalesce(step(lambda c, _: F.lit(c)), F.lit("")))
    score = F.when(errored, F.col("quality")).otherwise(step(lambda c, _: F.col(c)))
    action = F.when(errored, "").otherwise(F.coalesce(step(lambda c, _: F.lit(ACTIONS.get(c, ""))), F.lit("")))
    return rows.select("item_id", code.alias("code"), failed.alias("failed"), score.alias("score"), action.alias("action"))


_SCORES = {
    "item_id": "conv_id * 64 + turn",
    "errored": "CASE WHEN turn % 6 = 5 THEN conv_id % 2 = 0 END",
    "quality": "CASE WHEN conv_id % 11 > 0 THEN (40 + (conv_id * 37 + turn * 11) % 60) / 100.0e0 END",
    "grounding": "CASE WHEN conv_id % 7 > 0 THEN (35 + (conv_id * 13 + turn * 7) % 65) / 100.0e0 END",
    "bloom": "CASE WHEN turn % 4 > 0 THEN (60 + (conv_id * 29 + turn) % 40) / 100.0e0 END",
    "c": "(50 + (conv_id * 3 + turn * 5) % 50) / 100.0e0",
    "p": "(50 + (conv_id * 5 + turn * 3) % 50) / 100.0e0",
    "u": "(55 + (conv_id * 7 + turn * 2) % 45) / 100.0e0",
}
_TRAITS = "CASE conv_id % 5 WHEN 0 THEN 'no JSON' WHEN 1 THEN '{\"clarity\": {\"score\": ' || c || '}}' ELSE '{\"clarity\": {\"score\": ' || c || '}, \"distractor_plausibility\": {\"score\": ' || p || '}, \"answer_uniqueness\": {\"score\": ' || u || '}}' END"
_CASES = lambda value: "CASE " + " ".join(f"WHEN {c} < {least} THEN {value(c, code)}" for c, least, code in GATE)


@query(
    f"""WITH s AS (SELECT {', '.join(f'{x} AS {n}' for n, x in _SCORES.items())}, conv_id FROM conversations),
t AS (SELECT *, CASE WHEN conv_id % 5 > 0 THEN c END AS clarity, CASE WHEN conv_id % 5 > 1 THEN p END AS distractor_plausibility, CASE WHEN conv_id % 5 > 1 THEN u END AS answer_uniqueness FROM s)
SELECT item_id, CASE WHEN coalesce(errored, false) THEN 'verifier_failed' ELSE {_CASES(lambda c, code: f"'{code}'")} ELSE '' END END AS code, CASE WHEN coalesce(errored, false) THEN 'verifier' ELSE {_CASES(lambda c, _: f"'{c}'")} ELSE '' END END AS failed,
 CASE WHEN coalesce(errored, false) THEN quality ELSE {_CASES(lambda c, _: c)} END END AS score, CASE WHEN coalesce(errored, false) THEN '' ELSE {_CASES(lambda c, _: f"'{ACTIONS.get(c, '')}'")} ELSE '' END END AS action FROM t"""
)
def gate_verdicts(spark, sf_dir):
    """Which candidates pass the last gate, and by which score the others fail."""
    rows = read(spark, sf_dir, "conversations").selectExpr(*(f"{x} AS {n}" for n, x in _SCORES.items()), "conv_id").withColumn("traits", F.expr(_TRAITS))
    return gated(rows)


# -- metrics of a run -------------------------------------------------------------------------------------------------

RUN = (
    "metadata struct<job_id:string,duration_seconds:double,stopped_reason:string,cost:struct<calls:bigint,total_calls:bigint,tokens:bigint,total_tokens:bigint>>,"
    " questions array<struct<verification:struct<verified:boolean>,judging:struct<grounding:double,quality:double,quality_traits:struct<clarity:struct<rationale:string>,user_instruction_alignment:struct<score:double>>>,"
    "source:struct<quote_in_context:boolean>,_attempts:bigint,attempts:bigint,detailed_solution:struct<steps:array<string>>>>,"
    " rejected array<struct<reject_reason_code:string,reject_log:array<struct<reason_code:string>>>>, _corrupt_record string"
)


def mean(values: Column) -> Column:
    """The mean of an array's values that aren't null; null without any."""
    some = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(some))


def run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row a result file that can be read, with the twenty metrics of its run; a mean over nothing is null, a rate 0."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", RUN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*").filter("_corrupt_record is null")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    rows = rows.withColumns({c: none(c) for c in ("questions", "rejected")})
    given = lambda code: code.isNotNull() & (code != "")
    last = lambda r: F.try_element_at(F.filter(F.transform(r.reject_log, lambda e: e.reason_code), given), F.lit(-1))
    codes = F.transform("rejected", lambda r: F.coalesce(F.when(given(r.reject_reason_code), r.reject_reason_code), last(r), F.lit("unknown")))
    rows = rows.withColumn("codes", codes).withColumn("a", F.size("questions").cast("long")).withColumn("r", F.size("rejected").cast("long"))
    each = lambda f: mean(F.transform("questions", f))
    rate = lambda f: F.when(F.col("a") > 0, F.size(F.filter("questions", f)) / F.col("a")).otherwise(0.0)
    per = lambda c: F.when(F.col("a") > 0, c / F.col("a"))
    cost, calls = "metadata.cost", F.coalesce("metadata.cost.calls", "metadata.cost.total_calls")
    distribution = F.transform(F.array_sort(F.array_distinct("codes")), lambda c: F.concat_ws(":", c, F.size(F.filter("codes", lambda x: x == c))))
    return rows.select(
        "metadata.job_id",
        F.col("a").alias("accepted_count"),
        F.col("r").alias("rejected_count"),
        (F.col("a") + F.col("r")).alias("total_attempted"),
        F.when(F.col("a") + F.col("r") > 0, F.col("a") / (F.col("a") + F.col("r"))).otherwise(0.0).alias("acceptance_rate"),
        per(calls).alias("llm_calls_per_question"),
        per(F.col("metadata.duration_seconds")).alias("avg_generation_time_per_question"),
        each(lambda q: F.coalesce(F.when(q["_attempts"] != 0, q["_attempts"]), q.attempts)).alias("avg_attempts_per_accepted"),
        F.array_join(distribution, ",").alias("reject_reason_distribution"),
        rate(lambda q: q.verification.verified).alias("verifier_pass_rate"),
        rate(lambda q: F.startswith(F.lower(q.judging.quality_traits.clarity.rationale), F.lit("fast-path"))).alias("fast_accept_rate"),
        each(lambda q: q.judging.grounding).alias("grounding_avg"),
        each(lambda q: q.source.quote_in_context.cast("double")).alias("quote_score_avg"),
        each(lambda q: q.judging.quality).alias("quality_avg"),
        F.when(F.col("r") > 0, F.size(F.filter("codes", lambda c: c.isin("duplicate_question", "duplicate"))) / F.col("r")).otherwise(0.0).alias("duplicate_rate"),
        each(lambda q: (F.coalesce(F.size(q.detailed_solution.steps), F.lit(0)) >= 2).cast("double")).alias("explanation_quality_avg"),
        each(lambda q: q.judging.quality_traits.user_instruction_alignment.score).alias("user_instruction_alignment_avg"),
        "metadata.stopped_reason",
        F.coalesce(f"{cost}.tokens", f"{cost}.total_tokens").alias("cost_total_tokens"),
        calls.alias("cost_total_calls"),
        "metadata.duration_seconds",
    )


#: Orders of a job, and the fields of its questions and rejected items.
JOB = 100
_FIELDS = {
    "verified": "CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "grounding": "CASE WHEN o_custkey % 7 > 0 THEN (o_custkey % 65) / 64.0e0 END",
    "quality": "CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 65) / 64.0e0 END",
    "rationale": "CASE o_orderkey % 4 WHEN 0 THEN 'Fast-path: by rule' WHEN 1 THEN 'judged' END",
    "alignment": "CASE WHEN o_custkey % 2 = 0 THEN (o_custkey % 33) / 32.0e0 END",
    "quoted": "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "tries": "CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 END",
    "attempts": "1 + o_orderkey % 3",
    "steps": "o_custkey % 4",
    "code": "CASE o_custkey % 5 WHEN 0 THEN 'duplicate_question' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'quality_low' END",
}
_JOB_FIELDS = {"duration": "CASE WHEN job % 4 > 0 THEN job * 8.5e0 END", "calls": "CASE job % 3 WHEN 0 THEN 120 + job END", "total_calls": "CASE job % 3 WHEN 1 THEN 60 END", "tokens": "CASE job % 2 WHEN 0 THEN 1000 * job END", "stopped": "CASE job % 5 WHEN 0 THEN 'cancelled' END"}
_Q = "FILTER (WHERE good)"
_REASON = "coalesce(code, CASE WHEN o_custkey % 5 = 3 THEN 'format_error' ELSE 'unknown' END)"


@query(
    f"""WITH o AS (SELECT o_orderkey // {JOB} AS job, o_custkey, o_orderstatus <> 'F' AS good, {', '.join(f'{x} AS {n}' for n, x in _FIELDS.items())} FROM orders),
d AS (SELECT job, string_agg(reason || ':' || n, ',' ORDER BY reason) AS distribution FROM (SELECT job, {_REASON} AS reason, count(*) AS n FROM o WHERE NOT good GROUP BY ALL) GROUP BY job),
g AS (SELECT job, count(*) {_Q} AS a, count(*) FILTER (WHERE NOT good) AS r, avg(CASE WHEN tries <> 0 THEN tries ELSE attempts END) {_Q} AS tried, count(*) FILTER (WHERE good AND verified) AS passed, count(*) FILTER (WHERE good AND lower(rationale) LIKE 'fast-path%') AS fast, avg(grounding) {_Q} AS grounding,
 avg(quoted::INT::DOUBLE) {_Q} AS quoted, avg(quality) {_Q} AS quality, count(*) FILTER (WHERE NOT good AND {_REASON} LIKE 'duplicate%') AS again, avg((steps >= 2)::INT::DOUBLE) {_Q} AS explained, avg(alignment) {_Q} AS aligned FROM o GROUP BY job),
j AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in _JOB_FIELDS.items())} FROM g LEFT JOIN d USING (job))
SELECT 'job' || job AS job_id, a AS accepted_count, r AS rejected_count, a + r AS total_attempted, a / (a + r) AS acceptance_rate, CASE WHEN a > 0 THEN coalesce(calls, total_calls) / a END AS llm_calls_per_question, CASE WHEN a > 0 THEN duration / a END AS avg_generation_time_per_question,
 tried AS avg_attempts_per_accepted, coalesce(distribution, '') AS reject_reason_distribution, CASE WHEN a > 0 THEN passed / a ELSE 0 END AS verifier_pass_rate, CASE WHEN a > 0 THEN fast / a ELSE 0 END AS fast_accept_rate, grounding AS grounding_avg, quoted AS quote_score_avg, quality AS quality_avg,
 CASE WHEN r > 0 THEN again / r ELSE 0 END AS duplicate_rate, explained AS explanation_quality_avg, aligned AS user_instruction_alignment_avg, stopped AS stopped_reason, tokens::BIGINT AS cost_total_tokens, coalesce(calls, total_calls)::BIGINT AS cost_total_calls, duration AS duration_seconds FROM j"""
)
def result_metrics(spark, sf_dir):
    """All metrics of each job's result file; the files are written from the orders first."""
    orders = read(spark, sf_dir, "orders").selectExpr(f"o_orderkey div {JOB} AS job", "o_custkey", "o_orderstatus <> 'F' AS good", *(f"{x} AS {n}" for n, x in _FIELDS.items()))
    traits = F.struct(F.struct("rationale").alias("clarity"), F.when(F.col("alignment").isNotNull(), F.struct(F.col("alignment").alias("score"))).alias("user_instruction_alignment"))
    question = F.struct(
        F.struct("verified").alias("verification"), F.struct("grounding", "quality", traits.alias("quality_traits")).alias("judging"), F.struct(F.col("quoted").alias("quote_in_context")).alias("source"),
        F.col("tries").alias("_attempts"), "attempts", F.struct(F.array_repeat(F.lit("step"), F.col("steps").cast("int")).alias("steps")).alias("detailed_solution"),
    )
    log = F.when(F.col("o_custkey") % 5 == 3, F.array(*(F.struct(F.lit(c).cast("string").alias("reason_code")) for c in ("grounding_low", "format_error", None))))
    jobs = orders.groupBy("job").agg(F.collect_list(F.when(F.col("good"), question)).alias("questions"), F.collect_list(F.when(~F.col("good"), F.struct(F.col("code").alias("reject_reason_code"), log.alias("reject_log")))).alias("rejected"))
    jobs = jobs.selectExpr("*", *(f"{x} AS {n}" for n, x in _JOB_FIELDS.items()))
    metadata = F.struct(F.concat(F.lit("job"), "job").alias("job_id"), F.col("duration").alias("duration_seconds"), F.col("stopped").alias("stopped_reason"), F.struct("calls", "total_calls", "tokens").alias("cost"))
    return run_metrics(spark, written(jobs.select("job", F.to_json(F.struct(metadata.alias("metadata"), "questions", "rejected")).alias("text")), "job", "text"))


# -- matrices ---------------------------------------------------------------------------------------------------------

NEAR = 1e-6


def _agrees(kind: str, a: np.ndarray, b: np.ndarray | None, claim: np.ndarray) -> np.ndarray:
    """Verdicts of claims on stacks of square matrices: eigenvalues (first row of claim), inverse, product with b, determinant or rank (first entry)."""
    if kind == "product":
        return np.abs(a @ b - claim).max((1, 2)) <= NEAR
    if kind == "inverse":
        one = np.abs(a @ claim - np.eye(a.shape[1])).max((1, 2)) <= NEAR
        return one & (np.linalg.matrix_rank(a) == a.shape[1])
    if kind == "determinant":
        return np.abs(np.linalg.det(a) - claim[:, 0, 0]) <= NEAR * np.maximum(1, np.abs(claim[:, 0, 0]))
    if kind == "rank":
        return np.linalg.matrix_rank(a) == claim[:, 0, 0]
    # the coefficients of the polynomial whose roots are claimed are those of the matrix, also for repeated and complex roots
    poly = lambda roots: np.array([np.poly(r) for r in roots])
    own = poly(np.linalg.eigvals(a))
    return np.abs(own - poly(claim[:, 0, :])).max(1) <= NEAR * np.maximum(1, np.abs(own).max(1))


def matrix_verdicts(claims: DataFrame) -> DataFrame:
    """(claim_id, kind, verdict) of claims (claim_id, kind, a, b, claim) on matrices given as rows of numbers.

    Claims of one kind and size are decided as one stack. A matrix that isn't square, or one whose partner has another
    size, and an unknown kind give null.
    """

    def square(m) -> bool:
        return bool(m) and all(r is not None and len(r) == len(m) and all(v is not None for v in r) for r in m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, a, b, claim = (batch.column(c).to_pylist() for c in ("kind", "a", "b", "claim"))
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(kind):
                fits = square(a[i]) and square(claim[i]) and len(claim[i]) == len(a[i]) and (k != "product" or square(b[i]) and len(b[i]) == len(a[i]))
                if fits and k in ("product", "inverse", "determinant", "rank", "eigenvalues"):
                    groups.setdefault((k, len(a[i])), []).append(i)
            out: list[bool | None] = [None] * len(kind)
            for (k, _), rows in groups.items():
                pick = lambda m: np.array([m[i] for i in rows], float)
                for i, v in zip(rows, _agrees(k, pick(a), pick(b) if k == "product" else None, pick(claim)).tolist(), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([batch.column("claim_id"), batch.column("kind"), pa.array(out, pa.bool_())], ["claim_id", "kind", "verdict"])

    return claims.select("claim_id", "kind", "a", "b", "claim").mapInArrow(run, "claim_id long, kind string, verdict boolean")


_KINDS = ["product", "inverse", "determinant", "rank", "eigenvalues"]


@query(f"SELECT o_orderkey AS claim_id, CASE o_orderkey % 5 {' '.join(f'WHEN {k} THEN {chr(39)}{n}{chr(39)}' for k, n in enumerate(_KINDS))} END AS kind, o_custkey % 2 = 0 AS verdict FROM orders")
def matrix_claims(spark, sf_dir):
    """Claims on matrices of two to five rows made from columns, every second customer's being false by one entry."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c"), (2 + F.col("o_orderkey") % 4).cast("int").alias("n"))
    grid = lambda f: F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: f(i, j).cast("double")))
    key, wrong = F.col("o_orderkey"), F.col("c") % 2
    a_at = lambda i, j: (key * i + F.col("c") * (j + 1) + i * j) % 7 - 3
    b_at = lambda i, j: (key * j + F.col("c") * i) % 5 - 2
    zero = F.lit(0).cast("long")
    off = lambda i, j: F.when((i == F.col("n")) & (j == F.col("n")), wrong).otherwise(0)
    product = lambda i, j: F.aggregate(F.sequence(F.lit(1), F.col("n")), zero, lambda s, k: s + a_at(i, k) * b_at(k, j)) + off(i, j)
    # ones on the diagonal and a number above each: the inverse has the products of these with alternating signs
    u_at = lambda i: key % 3 + i
    above = lambda i, j: F.when(i == j, 1).when(j == i + 1, u_at(i)).otherwise(0)
    inverse = lambda i, j: F.when(i > j, zero).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(1).cast("long"), lambda s, k: F.when((k >= i) & (k < j), -s * u_at(k)).otherwise(s))) + off(i, j)
    upper = lambda i, j: F.when(i > j, 0).when(i == j, (key + i) % 4 + 1).otherwise((F.col("c") + i * j) % 6)
    first = lambda i, j, v: F.when((i == 1) & (j == 1), v + wrong).otherwise(0)
    det = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(1).cast("long"), lambda s, k: s * ((key + k) % 4 + 1))
    values = lambda i, j: F.when(i == 1, (key + j) % 4 + 1 + F.when(j == 1, wrong).otherwise(0)).otherwise(0)
    kind = key % 5
    a = F.when(kind == 0, grid(a_at)).when(kind == 1, grid(above)).otherwise(grid(upper))
    claim = F.when(kind == 0, grid(product)).when(kind == 1, grid(inverse)).when(kind == 2, grid(lambda i, j: first(i, j, det))).when(kind == 3, grid(lambda i, j: first(i, j, F.col("n")))).otherwise(grid(values))
    return matrix_verdicts(rows.select(key.alias("claim_id"), F.get(F.array(*map(F.lit, _KINDS)), kind.cast("int")).alias("kind"), a.alias("a"), grid(b_at).alias("b"), claim.alias("claim")))
