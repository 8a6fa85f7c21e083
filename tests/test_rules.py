"""Rules on Vietnamese candidates and contexts, against what each was written to break; folding against unicodedata."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import quality, text as T
from lexmill.functions.order import running
from lexmill.operators import claims, contexts, rules, units
from lexmill.plans.shared import with_steps

from .conftest import SMALL


def test_fold_is_compatibility_decomposition(spark):
    words = ["Tích phân", "Nguyên hàm", "đường ĐỒ THỊ", "ế ạ ơ ư ỹ ằ", "Straße café naïve", "é ố", "²³ ªº"]
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.lower().replace("đ", "d")) if not unicodedata.combining(c))
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.fold(F.col("w")).alias("f"), T.tokens(F.col("w")).alias("t")).collect()
    assert all(r.f == plain(r.w).replace("ß", "ß") for r in rows)
    assert rows[0].t == ["tich", "phan"] and rows[2].t == ["duong", "thi"]


def test_counts_without_arrays(spark):
    rows = spark.createDataFrame([("a.b.. C? [x] {y} \x01 for example printf(1); return 2",), ("",), (None,)], "t string")
    t = F.col("t")
    got = rows.select(quality.chars(t, ".[]"), quality.hits(t, "[a-z]{2,}"), quality.hits(t, quality.CODE), quality.hits(t, "zz")).collect()
    assert tuple(got[0]) == (5, 4, 2, 0) and tuple(got[1]) == (0, 0, 0, 0) and tuple(got[2]) == (None,) * 4


@pytest.fixture(scope="module")
def issues(spark):
    return {r.item_id: r.issues.split(",") for r in rules.candidate_rules(spark, SMALL).collect()}


def test_candidate_rules(issues):
    assert "question_too_trivial:bare_one_step_integral" in issues[1] and "quote_mismatch:source_quote_is_metadata" in issues[1]
    assert "verifier_missing:numeric_computation" in issues[1] and "d1:vague_distractor_rationale" in issues[1]
    assert "explanation_low_quality:first_step_is_conclusion" in issues[1]
    assert "d3:choice_label" in issues[2] and "duplicate_question:source_exercise_paraphrase" in issues[3] and "d2:duplicate_option" in issues[3]
    assert {"stem_contains_embedded_options", "answer_is_choice_label", "d1:empty", "empty_source_quote"} <= set(issues[4])
    assert issues[8] == [""]


def test_issue_codes(spark):
    names = ["a,duplicate_question:x", "explanation_low_quality:y,d2:duplicate_option", "question_too_trivial:z", "verifier_missing:n", "d1:duplicate_option", "options_count=3", "empty_stem", ""]
    got = with_steps(spark.createDataFrame([(n,) for n in names], "issues string"), [[rules.CODE]]).collect()
    assert [r.code for r in got] == ["duplicate_question", "explanation_low_quality", "quality_low", "verifier_failed", "duplicate", "bad_distractors", "format_error", ""]


def test_signatures(spark):
    got = {r.item_id: r for r in rules.question_signatures(spark, SMALL).collect()}
    want = {1: "bare_definite_integral", 3: "accumulation:motion", 5: "integral_positivity_property", 7: "area_between_graphs", 9: "integral_zero_interval_property", 10: "antiderivative_initial_condition:cos"}
    assert {k: got[k].core for k in want} == want
    assert got[7].expression == got[8].expression == "numeric_eval:expr:2^2/2" and got[8].value == "numeric_eval:expected:2"
    again = {r.item_id: r.repeats for r in rules.repeated_signatures(spark, SMALL).collect()}
    assert again[6] == "core" and again[8] == "expression" and again[5] == ""


def test_contexts(spark):
    got = {r.context_id: r for r in contexts.usable_contexts(spark, SMALL).collect()}
    assert got[1].beyond and got[2].beyond and got[3].reason == "context_too_noisy" and got[4].reason == "context_missing" and got[5].weak and not got[6].unplannable
    topics = {r.context_id: r for r in contexts.context_topics(spark, SMALL).collect()}
    assert topics[2].shown == "Toán" and topics[6].shown.startswith("Tổ hợp") and (topics[6].kind, topics[7].kind) == ("example", "exercise")
    plan = contexts.fast_plan(spark, SMALL).collect()
    assert [r.turn for r in plan] == list(range(1, 61)) and all(r.level == "Vận dụng" or r.target != 65 for r in plan)


def test_claims(spark):
    got = {r.claim_id: r.value for r in claims.numeric_claims(spark, SMALL).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 5, 6, 7, 9)] == [3.0, 0.5, 34.0, 12.0, 4.5, 7.0, None, 10.0]
    fixed = {r.claim_id: r for r in claims.answer_repair(spark, SMALL).collect()}
    assert fixed[3].key_text == "34,5 lít" and fixed[4].key_text == "−12" and not fixed[6].repaired and not fixed[1].repaired
    found = {r.reply_id: r for r in claims.json_objects(spark, SMALL).collect()}
    assert found[1].object == '{"a": 1, "b": "x"}' and found[2].parsed and found[3].object.startswith('{"questions"') and not found[4].parsed and not found[6].parsed


def test_cleaning_in_place_equals_cleaning_by_join(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.union(docs.limit(1).withColumn("doc_id", F.lit(10**6).cast("long")).withColumn("text", F.lit(None).cast("string")))
    one, two = ({r.doc_id: r.text for r in units.clean_pages_of(docs, few=n).collect()} for n in (10_000, 0))
    assert one == two


def test_places_span_by_span(spark):
    rows = [(k % 3, 7 * k + k % 5, k % 4) for k in range(200)]
    got = running(spark.createDataFrame(rows, "g long, o long, v long"), "g", "o", F.col("v"), "s", span=50).collect()
    for r in got:
        assert r.s == sum(v for g, o, v in rows if g == r.g and o <= r.o)
    assert len(got) == 200
