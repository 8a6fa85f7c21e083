"""Reason classes, difficulty, context trimming, diverse selection and sequence ratios."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import text as T
from lexmill.operators.candidates import _ITEMS, items
from lexmill.operators.matching import greedy_keep, shared_tokens
from lexmill.plans.registry import query, read

# Reason codes in the order in which they are tried, with the markers of each.
REASONS = [
    ("cancelled", ["cancelled", "cancel requested"]),
    ("budget_exceeded", ["budget exceeded", "budgetexceeded"]),
    ("max_attempts_exceeded", ["max attempt", "attempts exceeded", "exhausted"]),
    ("multi_answer", ["multi_answer", "multi-answer", "cũng được verifier xác nhận"]),
    ("verifier_failed", ["verifier=false", "verifier failed", "verifier error"]),
    ("duplicate", ["duplicate with previously accepted", "duplicate question"]),
    ("duplicate_question", ["duplicate distractor", "source_exercise_paraphrase"]),
    ("distractor_validator_failed", ["distractor_validator", "option_text_sanity", "iwf_", "distractor_plausibility", "duplicate distractor", "format_consistency"]),
    ("bad_distractors", ["answer_uniqueness", "uniqueness"]),
    ("quote_mismatch", ["quote", "unsupported_stem_numbers", "unsupported stem"]),
    ("grounding_low", ["grounding=", "grounding ", "grounding<", "grounding low"]),
    ("context_too_noisy", ["context_too_noisy", "too noisy", "high noise", "context noise"]),
    ("context_missing", ["context_missing", "no candidate passed filters", "no source slot", "missing doc_id"]),
    ("quality_low", ["quality=", "final gate: quality", "quality<", "quality_low"]),
    ("format_error", ["final formatted sanity", "format_error", "option_text_sanity"]),
    ("customization_mismatch", ["customization", "user_instruction_alignment", "focus_topic"]),
    ("explanation_low_quality", ["explanation_low_quality", "detailed_solution missing"]),
    ("generation_parse_error", ["writer trả 0", "writer error", "parse error", "parsing failed"]),
    ("orchestrator_error", ["orchestrator error", "unexpected exception"]),
]


def reason(message: Column) -> Column:
    """The first reason one of whose markers stands in the message."""
    low = F.lower(message)
    out = None
    for code, markers in REASONS:
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(low, F.lit(m))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("unknown")


_MESSAGE = "CASE event_type WHEN 'click' THEN 'Grounding=0.2 below' WHEN 'purchase' THEN 'Duplicate question of #' WHEN 'error' THEN 'verifier failed; quote' WHEN 'view' THEN 'IWF_absolute' ELSE 'other' END"


@query(
    f"WITH m AS (SELECT lower({_MESSAGE} || event_id % 7) AS t FROM events) SELECT CASE "
    + " ".join(f"WHEN {' OR '.join(f'''contains(t, '{m}')''' for m in ms)} THEN '{c}'" for c, ms in REASONS)
    + " ELSE 'unknown' END AS code, count(*) AS n FROM m GROUP BY 1"
)
def reason_classes(spark, sf_dir):
    message = F.concat(F.expr(_MESSAGE), F.col("event_id") % 7)
    return read(spark, sf_dir, "events").select(reason(message).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


# Base difficulty of four levels, in hundredths.
BASE = [30, 50, 70, 85]


def difficulty(level: Column, stem: Column, options: Column) -> Column:
    """Hundredths: base by level, stem length, and two or more numeric distractors within half of the answer; 10 to 95."""
    base = F.get(F.array(*map(F.lit, BASE)), level.cast("int"))
    size = F.when(stem > 400, 10).when(stem > 250, 6).when(stem > 150, 3).when(stem < 70, -4).otherwise(0)
    answer = F.trim(F.get(options, 0)).try_cast("double")
    near = F.filter(F.slice(options, 2, 3), lambda o: F.coalesce(F.when(answer == 0, F.abs(F.trim(o).try_cast("double")) < 2).otherwise(F.abs(F.trim(o).try_cast("double") - answer) < 0.5 * F.abs(answer)), F.lit(False)))
    return F.greatest(F.lit(10), F.least(F.lit(95), base + size + F.when(F.size(near) >= 2, 4).otherwise(0))).cast("long")


@query(
    _ITEMS
    + """, n AS (SELECT item_id, (item_id * 37) % 500 AS stem, item_id % 4 AS level, try_cast(trim(o[1]) AS DOUBLE) AS a, list_transform(o[2:4], lambda x: try_cast(trim(x) AS DOUBLE)) AS d FROM i),
c AS (SELECT *, len(list_filter(d, lambda x: coalesce(CASE WHEN a = 0 THEN abs(x) < 2 ELSE abs(x - a) < 0.5 * abs(a) END, false))) AS near FROM n)
SELECT item_id, greatest(10, least(95, [30, 50, 70, 85][level + 1] + CASE WHEN stem > 400 THEN 10 WHEN stem > 250 THEN 6 WHEN stem > 150 THEN 3 WHEN stem < 70 THEN -4 ELSE 0 END + CASE WHEN near >= 2 THEN 4 ELSE 0 END))::BIGINT AS difficulty FROM c"""
)
def difficulty_estimate(spark, sf_dir):
    rows = items(read(spark, sf_dir, "lineitem"))
    return rows.select("item_id", difficulty(F.col("item_id") % 4, F.col("item_id") * 37 % 500, F.col("options")).alias("difficulty"))


def trimmed(units: Column, keywords: Column, limit: int = 1500) -> Column:
    """The most relevant units that fit into limit characters, in source order: a misfit is passed over, and packing stops at 85 %."""
    score = lambda u: 5 * F.size(F.array_intersect(T.token_set(u), keywords)) + F.least(F.lit(2), F.floor(F.regexp_count(u, F.lit("[0-9]")) / 4)).cast("int")
    ranked = F.array_sort(F.transform(units, lambda u, i: F.struct((-score(u)).alias("s"), i.alias("i"), u.alias("u"))))
    none = F.array().cast("array<struct<i:int,u:string>>")

    def step(s: Column, r: Column) -> Column:
        extra = F.char_length(r.u) + F.when(F.size(s.kept) > 0, 2).otherwise(0)
        skip = (s.used * 100 >= limit * 85) | (s.used + extra > limit) | ((r.s >= 0) & (F.size(s.kept) > 0))
        return F.when(skip, s).otherwise(F.struct(F.concat(s.kept, F.array(F.struct(r.i.alias("i"), r.u.alias("u")))).alias("kept"), (s.used + extra).alias("used")))

    kept = F.aggregate(ranked, F.struct(none.alias("kept"), F.lit(0).alias("used")), step, lambda s: s.kept)
    return F.array_join(F.transform(F.array_sort(kept), lambda k: k.u), "\n\n")


@query()
def trim_context(spark, sf_dir):
    """Contexts cut to 1500 characters by relevance to the words of the language's licence line."""
    units = F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda p: p != "")
    words = F.array(*map(F.lit, ["released", "under", "license", "the", "and"]))
    rows = read(spark, sf_dir, "documents").select("doc_id", trimmed(units, words).alias("t"))
    return rows.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def item_links(items_: DataFrame, percent: int = 20) -> DataFrame:
    other = items_.select(F.col("item_id").alias("b"), "text")
    pairs = shared_tokens(items_.select(F.col("item_id").alias("a"), "text"), other, "a", "b").filter("a < b")
    return pairs.filter(f"100 * shared_n >= {percent} * (n_a + n_b - shared_n)").select("a", "b")


@query()
def diverse_items(spark, sf_dir):
    """Items in order, without those whose words are a fifth like those of one kept before."""
    rows = read(spark, sf_dir, "benchmark")
    return greedy_keep(rows, item_links(rows), "item_id")


def ratios(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, permille) of pairs (a, b, x, y) of texts whose matching-block ratio is least or more; upper bounds come first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                m = SequenceMatcher(None, r.x, r.y)
                if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (v := m.ratio()) >= least:
                    out.append((r.a, r.b, int(v * 1000)))
            yield pd.DataFrame(out, columns=["a", "b", "permille"])

    size = F.expr("2 * least(char_length(x), char_length(y)) / (char_length(x) + char_length(y))")
    return pairs.filter(size >= least).mapInPandas(run, "a long, b long, permille long")


@query()
def similar_stems(spark, sf_dir):
    """Pairs of items that share a word and whose texts are alike as sequences to 30 %."""
    rows = read(spark, sf_dir, "benchmark")
    pairs = shared_tokens(rows.select(F.col("item_id").alias("a"), "text"), rows.select(F.col("item_id").alias("b"), "text"), "a", "b").filter("a < b")
    pairs = pairs.join(rows.select(F.col("item_id").alias("a"), F.col("text").alias("x")), "a").join(rows.select(F.col("item_id").alias("b"), F.col("text").alias("y")), "b")
    return ratios(pairs.select("a", "b", "x", "y"), 0.3)
