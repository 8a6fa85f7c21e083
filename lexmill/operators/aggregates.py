"""Aggregations over documents, verdict logs and events: statistics, summaries, run comparison, budgets, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from lexmill.functions.shared import cut
from lexmill.plans.registry import query, read

LONG, TOO_LONG = 30_000, 120_000


@query(
    f"SELECT source, sum(length(text))::BIGINT AS total_chars, count(*) AS num_units, max(length(text))::BIGINT AS max_unit_chars, sum(length(text)) >= {LONG} AS is_long, sum(length(text)) >= {TOO_LONG} AS is_too_long FROM documents GROUP BY source"
)
def long_doc_stats(spark, sf_dir):
    size = F.char_length("text").cast("long")
    out = read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(size).alias("total_chars"), F.count("*").alias("num_units"), F.max(size).alias("max_unit_chars"))
    return out.withColumn("is_long", F.col("total_chars") >= LONG).withColumn("is_too_long", F.col("total_chars") >= TOO_LONG)


# Classes in order, with the words that name them.
CLASSES = [("licence", "license|licence"), ("contact", "@"), ("listing", r"\|"), ("prose", r"\. ")]


@query(
    "SELECT source, CASE "
    + " ".join(f"WHEN bool_or(regexp_matches(lower(text), '{p}')) THEN '{c}'" for c, p in CLASSES)
    + " ELSE 'other' END AS document_type, count(*) AS n FROM documents GROUP BY source"
)
def document_class(spark, sf_dir):
    """The first class whose words stand in a unit of the document."""
    head = F.lower("text")
    out = read(spark, sf_dir, "documents").groupBy("source").agg(*(F.bool_or(head.rlike(p)).alias(c) for c, p in CLASSES), F.count("*").alias("n"))
    kind = F.coalesce(*(F.when(F.col(c), c) for c, _ in CLASSES), F.lit("other"))
    return out.select("source", kind.alias("document_type"), "n")


@query("SELECT lang, source, grouping(lang, source)::BIGINT AS grain, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())")
def plan_distribution(spark, sf_dir):
    """Three groupings and the total in one pass."""
    docs = read(spark, sf_dir, "documents")
    sets = docs.groupingSets([[docs.lang], [docs.source], [docs.lang, docs.source], []], docs.lang, docs.source)
    return sets.agg(F.grouping_id().cast("long").alias("grain"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """WITH t AS (SELECT lower(event_type) AS k, min_by(event_type, event_id) AS label, count(*) AS n FROM events GROUP BY 1)
SELECT label, n FROM t ORDER BY n DESC, label LIMIT 8"""
)
def top_labels(spark, sf_dir):
    """The eight most frequent labels without regard to case; the report's length is the feature."""
    out = read(spark, sf_dir, "events").groupBy(F.lower("event_type").alias("k")).agg(F.min_by("event_type", "event_id").alias("label"), F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "label").limit(8).select("label", "n")


@query(
    """SELECT source, count(*) AS total, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS accepted, count(*) FILTER (WHERE quality = 0) AS needs_revision, count(*) FILTER (WHERE quality IS NULL) AS pending,
 (1000 * count(*) FILTER (WHERE quality = 1)) // nullif(count(quality), 0) AS permille FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""
)
def bank_summary(spark, sf_dir):
    """Verdict counters of each source; shares are thousandths, null where nothing is judged."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    out = rows.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if(F.expr("quality = 1 and toxic = 0")).alias("accepted"),
        F.count_if(F.expr("quality = 0")).alias("needs_revision"),
        F.count_if(F.expr("quality is null")).alias("pending"),
        F.count_if(F.expr("quality = 1")).alias("good"),
        F.count("quality").alias("judged"),
    )
    return out.select("source", "total", "accepted", "needs_revision", "pending", F.expr("1000 * good div nullif(judged, 0)").alias("permille"))


# Reasons of rejection in order, and the event they are told by here.
REASONS = "CASE event_type WHEN 'error' THEN 'verifier_failed' WHEN 'signup' THEN 'low_quality' WHEN 'purchase' THEN 'duplicate_question' ELSE 'unknown' END"


@query(
    f"""WITH l AS (SELECT user_id, event_id, {REASONS} AS code FROM events),
p AS (SELECT user_id, coalesce(max_by(code, event_id) FILTER (WHERE code <> 'unknown'), max_by(code, event_id)) AS code FROM l GROUP BY user_id),
a AS (SELECT code, count(*) AS logs FROM l GROUP BY code), b AS (SELECT code, count(*) AS records FROM p GROUP BY code)
SELECT code, coalesce(logs, 0) AS logs, coalesce(records, 0) AS records FROM a FULL JOIN b USING (code)"""
)
def reject_summary(spark, sf_dir):
    """Counts of reasons over all log entries, and over records by their primary reason: the last that is known, else the last."""
    logs = read(spark, sf_dir, "events").select("user_id", "event_id", F.expr(REASONS).alias("code"))
    primary = logs.groupBy("user_id").agg(F.expr("max_by(code, event_id) FILTER (WHERE code <> 'unknown')").alias("known"), F.max_by("code", "event_id").alias("last"))
    records = primary.groupBy(F.coalesce("known", "last").alias("code")).agg(F.count("*").alias("records"))
    out = logs.groupBy("code").agg(F.count("*").alias("logs")).join(records, "code", "full")
    return out.select("code", F.coalesce("logs", F.lit(0)).alias("logs"), F.coalesce("records", F.lit(0)).alias("records"))


@query(
    """WITH l AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS k FROM l)
SELECT event_type, user_id, n, k FROM r WHERE k <= 8"""
)
def reject_top_slots(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return rows.withColumn("k", rank.cast("long")).filter("k <= 8")


_METRICS = {
    "accepted": "count(*) FILTER (WHERE event_type = 'purchase')",
    "rejected": "count(*) FILTER (WHERE event_type = 'error')",
    "total": "count(*)",
    "users": "count(DISTINCT user_id)",
    "acceptance_permille": "1000 * count(*) FILTER (WHERE event_type = 'purchase') {div} nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0)",
    "value_cents": "CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT)",
    "longest_props": "CAST(max(length(props)) AS BIGINT)",
}


def _metrics(div: str, by: str = "") -> str:
    return ", ".join(f"{v.format(div=div)} AS {k}" for k, v in _METRICS.items())


@query(f"WITH m AS (SELECT {_metrics('//')} FROM events) UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value")
def benchmark_metrics(spark, sf_dir):
    """The metrics of a run, one a row; an average over nothing is null."""
    wide = read(spark, sf_dir, "events").agg(*(F.expr(v.format(div="div")).alias(k) for k, v in _METRICS.items()))
    return wide.unpivot([], list(_METRICS), "metric", "value").filter("value is not null")


@query(
    f"""WITH m AS (SELECT CAST(user_id % 2 AS BIGINT) AS run, {_metrics('//')} FROM events GROUP BY 1), u AS (UNPIVOT m ON COLUMNS(* EXCLUDE run) INTO NAME metric VALUE value)
SELECT metric, max(value) FILTER (WHERE run = 0) AS run_a, max(value) FILTER (WHERE run = 1) AS run_b, max(value) FILTER (WHERE run = 1) - max(value) FILTER (WHERE run = 0) AS delta FROM u GROUP BY metric"""
)
def benchmark_compare(spark, sf_dir):
    """Two runs side by side, with the difference of the last to the first."""
    wide = read(spark, sf_dir, "events").groupBy(F.expr("user_id % 2").alias("run")).agg(*(F.expr(v.format(div="div")).alias(k) for k, v in _METRICS.items()))
    rows = wide.unpivot("run", list(_METRICS), "metric", "value")
    both = rows.groupBy("metric").pivot("run", [0, 1]).agg(F.max("value"))
    return both.select("metric", F.col("0").alias("run_a"), F.col("1").alias("run_b"), (F.col("1") - F.col("0")).alias("delta"))


@query(
    """WITH t AS (SELECT json_extract_string(props, '$.k') AS k, event_type FROM events), c AS (SELECT event_type, sum(k::BIGINT)::BIGINT AS total FROM t GROUP BY event_type)
SELECT count(DISTINCT total) FILTER (WHERE total > 0) > 1 AS mismatch, count(*) AS groups, sum(total)::BIGINT AS total FROM c"""
)
def distribution_totals(spark, sf_dir):
    """Sums of counts kept as JSON, and whether more than one positive total occurs."""
    k = F.get_json_object("props", "$.k").cast("long")
    totals = read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"))
    return totals.agg((F.countDistinct(F.when(F.col("total") > 0, F.col("total"))) > 1).alias("mismatch"), F.count("*").alias("groups"), F.sum("total").alias("total"))


#: Units whose digests are hashed together.
LEAF = 1000


@query(
    f"""WITH l AS (SELECT source, doc_id // {LEAF} AS leaf, sha256(string_agg(sha256(doc_id || '|' || lang || '|' || text), chr(10) ORDER BY doc_id)) AS s FROM documents GROUP BY ALL)
SELECT source, substr(sha256(string_agg(s, chr(10) ORDER BY leaf)), 1, 16) AS fingerprint FROM l GROUP BY source"""
)
def dataset_fingerprint(spark, sf_dir):
    """SHA-256 of a data set's units in order, as a tree, 16 digits of it; texts are hashed where they are."""
    own = F.sha2(F.concat_ws("|", "doc_id", "lang", "text").cast("binary"), 256)
    rows = read(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / LEAF).alias("leaf"), F.struct("doc_id", own.alias("s")).alias("r"))
    tree = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda r: r.s), "\n"), 256)
    leaves = rows.groupBy("source", "leaf").agg(tree("r").alias("s"))
    return leaves.groupBy("source").agg(F.substring(tree(F.struct("leaf", "s")), 1, 16).alias("fingerprint"))


@query(
    """WITH s AS (SELECT conv_id, turn, length(text) AS used, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM conversations)
SELECT conv_id, count(*) AS calls, sum(used)::BIGINT AS tokens, count(*) FILTER (WHERE spent > 800) AS over_budget, coalesce(min(turn) FILTER (WHERE spent > 800), -1) AS stopped_at FROM s GROUP BY conv_id"""
)
def cost_budget(spark, sf_dir):
    """Running sums of what calls use, and where the budget stops them."""
    size = F.char_length("text").cast("long")
    spent = F.sum(size).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", size.alias("used"), spent.alias("spent"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("calls"), F.sum("used").alias("tokens"), F.count_if(F.expr("spent > 800")).alias("over_budget"), F.coalesce(F.min(F.when(F.col("spent") > 800, F.col("turn"))), F.lit(-1)).cast("long").alias("stopped_at"))


@query("SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality, (l.doc_id IS NOT NULL) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def attach_contexts(spark, sf_dir):
    """Cached values on their units, with a default where there are none."""
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"), F.col("quality").isNotNull().alias("labelled"))


# What a user is told for the reasons that lead, and how much of a report there is.
HINTS = {
    "Grounding/quote nhiều lần fail — thử expand context hoặc chọn chunk khác bám sát chủ đề slot.": ["grounding_low", "quote_mismatch"],
    "Tài liệu thiếu căn cứ cho slot — bỏ slot này hoặc đổi sang chủ đề có trong PDF.": ["context_missing"],
    "Verifier reject nhiều — thử tăng num_samples hoặc kiểm verifier_hint payload.": ["verifier_failed"],
    "Distractor yếu — kiểm misconception list trong plan, hoặc giảm độ khó.": ["bad_distractors", "distractor_validator_failed"],
    "Trùng câu — giảm num_questions hoặc thêm chủ đề khác.": ["duplicate", "duplicate_question"],
    "Quality liên tục thấp — xem traits/critique và cân nhắc đổi JUDGE_MODEL mạnh hơn.": ["quality_low"],
    "User instruction không khớp — chỉnh focus_topics/style hoặc giảm strict_grounding.": ["customization_mismatch"],
}
RECENT, TOP_SLOTS, TOP_REASONS = 12, 8, 3
_HINT = "CASE " + " ".join(f"WHEN code IN ({', '.join(map(repr, codes))}) THEN '{text}'" for text, codes in HINTS.items()) + " END"


def reject_summary_of(logs: DataFrame) -> DataFrame:
    """(part, place, name, n) of log entries (record, slot, pos, code, stage): a report in five parts.

    Counts by reason and by stage (place null), the last records in order with their last reason and their entries, the slots with most
    records, and hints for the leading reasons, each once. The limits of the last three are the report's own; no part is
    gathered in one task before it is cut to them.
    """
    none = F.lit(None).cast("long")
    reasons = cut(logs.groupBy("code").agg(F.count("*").alias("n")))
    stages = logs.filter("stage is not null").groupBy("stage").agg(F.count("*").alias("n"))
    records = cut(logs.groupBy("record").agg(F.max("pos").alias("pos"), F.max_by("code", "pos").alias("code"), F.max_by("slot", "pos").alias("slot"), F.count("*").alias("n")))
    numbered = lambda rows, *order: rows.orderBy(*order).withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))
    recent = numbered(records.orderBy(F.desc("pos")).limit(RECENT), "pos")
    slots = numbered(records.groupBy("slot").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "slot").limit(TOP_SLOTS), F.desc("n"), "slot")
    leading = numbered(reasons.orderBy(F.desc("n"), "code").limit(TOP_REASONS), F.desc("n"), "code").withColumn("hint", F.expr(_HINT)).filter("hint is not null")
    hints = leading.groupBy("hint").agg(F.min("place").alias("place"), F.max_by("n", "n").alias("n"))
    parts = [
        reasons.select(F.lit("reason").alias("part"), none.alias("place"), F.col("code").alias("name"), "n"),
        stages.select(F.lit("stage"), none, "stage", "n"),
        recent.select(F.lit("recent"), "place", F.concat_ws(":", "record", "code"), "n"),
        slots.select(F.lit("slot"), "place", F.col("slot").cast("string"), "n"),
        hints.select(F.lit("hint"), "place", "hint", "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


_LOG = {
    "record": "user_id",
    "slot": "user_id % 40",
    "pos": "event_id",
    "code": "CASE event_type WHEN 'error' THEN 'verifier_failed' WHEN 'signup' THEN 'quality_low' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'duplicate' ELSE 'duplicate_question' END WHEN 'click' THEN 'grounding_low' ELSE 'format_error' END",
    "stage": "CASE event_id % 4 WHEN 0 THEN 'critic' WHEN 1 THEN 'verifier' WHEN 2 THEN 'final' END",
}


@query(
    f"""WITH l AS (SELECT {', '.join(f'{x} AS {n}' for n, x in _LOG.items())} FROM events), c AS (SELECT code, count(*) AS n FROM l GROUP BY code),
r AS (SELECT record, max(pos) AS pos, max_by(code, pos) AS code, max_by(slot, pos) AS slot, count(*) AS n FROM l GROUP BY record),
h AS (SELECT *, row_number() OVER (ORDER BY n DESC, code) AS place FROM c QUALIFY place <= {TOP_REASONS}), t AS (SELECT *, {_HINT} AS hint FROM h)
SELECT 'reason' AS part, NULL::BIGINT AS place, code AS name, n FROM c UNION ALL SELECT 'stage', NULL, stage, count(*) FROM l WHERE stage IS NOT NULL GROUP BY stage
UNION ALL SELECT 'recent', row_number() OVER (ORDER BY pos), record || ':' || code, n FROM (SELECT * FROM r ORDER BY pos DESC LIMIT {RECENT})
UNION ALL SELECT 'slot', row_number() OVER (ORDER BY n DESC, slot), slot::VARCHAR, n FROM (SELECT slot, count(*) AS n FROM r GROUP BY slot ORDER BY n DESC, slot LIMIT {TOP_SLOTS})
UNION ALL SELECT 'hint', min(place), hint, max(n) FROM t WHERE hint IS NOT NULL GROUP BY hint"""
)
def reject_report(spark, sf_dir):
    """The whole report of a job's rejects: reasons, stages, the last twelve, the worst slots, and what to try."""
    return reject_summary_of(read(spark, sf_dir, "events").selectExpr(*(f"{x} AS {n}" for n, x in _LOG.items())))
