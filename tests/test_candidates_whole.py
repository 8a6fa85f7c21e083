"""Replies, solutions, the final gate, result metrics, matrices and orders within a hot key, by cases and plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions.order import lagged
from lexmill.operators import gate, replies, solutions


def test_replies(spark):
    rows = [
        (1, json.dumps({"question": "Q", "answer_key": " c ", "options": ["a", {"key": "B", "text": "b"}, {"label": "c", "option": "right"}], "why_others_wrong": {"a": "no"}, "source_quote": ' "“quote”" ', "detailed_solution": {"steps": [{"title": "t"}]}})),
        (2, json.dumps({"stem": "S", "answer": 5, "distractors": [{"text": "1", "reason": "r"}, "2", None, {"x": 1}, "3", "4"]})),
        (3, "Question: A\nb?\nAnswer: 7\nSource quote: 'x'\nDistractors:\nDistractor category: k\nDistractor explanation: why\nDistractor: 8\n\n\nDistractor: 9"),
        (4, None),
        (5, "{broken"),
        (6, "[1, 2]"),
        (7, "{}"),
    ]
    got = {r["item_id"]: r for r in replies.parsed_replies(spark.createDataFrame(rows, "item_id long, reply string")).collect()}
    told = lambda k: [tuple(d) for d in got[k]["distractors"]]
    assert (got[1]["answer"], got[1]["answer_key"], got[1]["quote"], got[1]["n_steps"]) == ("right", "C", "quote", 1) and told(1) == [("a", "no"), ("b", "")]
    assert (got[2]["question"], got[2]["answer"]) == ("S", "5") and told(2) == [("1", "r"), ("2", ""), ("3", "")]
    assert (got[3]["question"], got[3]["answer"], got[3]["explanation"]) == ("A\nb?\nAnswer: 7\nSource quote: 'x'\nDistractors:\nDistractor category: k\nDistractor explanation: why\nDistractor: 8\n\n\nDistractor: 9", "7", "") and told(3) == [("8", "why"), ("9", "")]
    assert all(got[k]["question"] == "" and told(k) == [] for k in (4, 5, 6, 7)) and [got[k]["kind"] for k in range(1, 8)] == ["json", "json", "labels", "labels", "labels", "labels", "json"]


@pytest.mark.parametrize(
    ("text", "key", "want"),
    [
        ("A đúng đúng vi ket qua khop.", "B", "B đúng vi ket qua khop."),
        ("Phương án **A** đúng vì dùng đúng công thức.", "C", "Phương án C đúng vì dùng đúng công thức."),
        ("Doi chieu voi phuong an \\(A\\). Phuong an A la cach viet cu.", "C", "Doi chieu voi phuong an C. Phuong an C la cach viet cu."),
        ("Đáp án đúng là b; \\text{D}", "A", "Đáp án đúng là A; \\text{A}"),
        ("phương án AB và đáp án", "C", "phương án AB và đáp án"),
        ("chọn đáp án A", "", "chọn đáp án A"),
        ("chọn đáp án A", None, "chọn đáp án A"),
    ],
)
def test_letters(spark, text, key, want):
    row = spark.createDataFrame([(text, key)], "t string, k string")
    assert row.select(solutions.letters_follow(F.col("t"), F.col("k")).alias("x")).first()["x"] == want


def test_solutions(spark):
    steps = "steps array<struct<title:string,content:string>>"
    rows = [(1, "C", "right answer", [("Buoc 1", "phuong an A"), ("Ket luan", "Vi vay phuong an dung la A.")]), (2, "B", " .", [("x", None), (None, "chon A")]), (3, None, "a", [("Kết luận", "A")]), (4, "A", "b", None), (5, "A", "b", [])]
    got = {r["item_id"]: r for r in solutions.aligned(spark.createDataFrame(rows, f"item_id long, answer_key string, answer string, {steps}")).collect()}
    assert [s["content"] for s in got[1]["steps"]] == ["phuong an C", "Chọn đáp án C: right answer."] and got[1]["final_answer"] == "right answer"
    assert [s["content"] for s in got[2]["steps"]] == ["", "Chọn đáp án B."]
    assert [s["content"] for s in got[3]["steps"]] == ["A"] and got[4]["steps"] is None and got[5]["steps"] == []


def test_gate(spark):
    trait = lambda **t: json.dumps({k: {"score": v} for k, v in t.items()})
    rows = [(1, None, None, None, None, None), (2, True, 0.9, 0.9, 0.9, None), (3, False, 0.44, 0.1, None, None), (4, None, 0.45, 0.39, None, None), (5, None, None, 0.4, 0.64, None), (6, None, 1.0, 1.0, 1.0, trait(clarity=0.5)), (7, None, 1.0, 1.0, 1.0, trait(clarity=1, distractor_plausibility=0.1)), (8, None, 1.0, 1.0, 1.0, trait(answer_uniqueness=0.59)), (9, None, 1.0, 1.0, 1.0, "no JSON"), (10, None, 1.0, 1.0, 1.0, '{"clarity": {"score": "high"}}')]
    got = {r["item_id"]: (r["code"], r["failed"], r["score"], r["action"]) for r in gate.gated(spark.createDataFrame(rows, "item_id long, errored boolean, quality double, grounding double, bloom double, traits string")).collect()}
    assert got[1] == got[9] == got[10] == ("", "", None, "")
    assert got[2] == ("verifier_failed", "verifier", 0.9, "") and got[3] == ("quality_low", "quality", 0.44, "") and got[4] == ("grounding_low", "grounding", 0.39, "expand_context")
    assert got[5] == ("quality_low", "bloom", 0.64, "") and got[6] == ("quality_low", "clarity", 0.5, "") and got[7] == ("bad_distractors", "distractor_plausibility", 0.1, "retry_distractor") and got[8] == ("multi_answer", "answer_uniqueness", 0.59, "retry_distractor")


def test_run_metrics(spark, tmp_path):
    run = {"metadata": {"job_id": "j", "cost": {"total_calls": 6}}, "questions": [{"verification": {"verified": True}, "judging": {"quality": 0.5}, "attempts": 2}, {"_attempts": 0, "attempts": 4, "source": {"quote_in_context": False}}], "rejected": [{"reject_log": [{"reason_code": "a"}, {}]}, {"reject_reason_code": "duplicate"}, {}]}
    for name, text in {"a": json.dumps(run), "b": "{", "c": '{"metadata": {"job_id": "none"}}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["job_id"]: r for r in gate.run_metrics(spark, str(tmp_path)).collect()}
    j, none = got["j"], got["none"]
    assert (j["accepted_count"], j["rejected_count"], j["acceptance_rate"], j["llm_calls_per_question"], j["avg_attempts_per_accepted"], j["verifier_pass_rate"]) == (2, 3, 0.4, 3.0, 3.0, 0.5)
    assert j["reject_reason_distribution"] == "a:1,duplicate:1,unknown:1" and j["quality_avg"] == 0.5 and j["quote_score_avg"] == 0.0 and j["grounding_avg"] is None and j["duplicate_rate"] == pytest.approx(1 / 3)
    assert (none["accepted_count"], none["acceptance_rate"], none["llm_calls_per_question"], none["quality_avg"], none["reject_reason_distribution"]) == (0, 0.0, None, None, "") and set(got) == {"j", "none"}


def test_matrices(spark):
    one, swap = [[1.0, 0.0], [0.0, 1.0]], [[0.0, 1.0], [1.0, 0.0]]
    turn = [[0.0, -1.0], [1.0, 0.0]]
    claims = [("product", swap, swap, one, True), ("product", swap, one, one, False), ("product", swap, None, one, None), ("product", swap, [[1.0]], one, None), ("inverse", swap, None, swap, True), ("inverse", [[1.0, 1.0], [1.0, 1.0]], None, one, False), ("determinant", swap, None, [[-1.0, 0.0], [0.0, 0.0]], True), ("rank", [[1.0, 2.0], [2.0, 4.0]], None, one, True), ("eigenvalues", swap, None, [[-1.0, 1.0], [0.0, 0.0]], True), ("eigenvalues", turn, None, [[1.0, -1.0], [0.0, 0.0]], False), ("trace", one, None, one, None), ("rank", [[1.0, 2.0]], None, one, None), ("rank", [], None, one, None)]
    rows = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(claims)], "claim_id long, kind string, a array<array<double>>, b array<array<double>>, claim array<array<double>>")
    got = {r["claim_id"]: r["verdict"] for r in gate.matrix_verdicts(rows).collect()}
    assert [got[k] for k in range(len(claims))] == [c[4] for c in claims]


def test_values_before(spark):
    rng = random.Random(1)
    rows = [(k, n, rng.choice("abc")) for k in "xy" for n in rng.sample(range(1000), 60)]
    got = lagged(spark.createDataFrame(rows, "key string, n long, v string"), "key", "n", "v", "before", span=50).collect()
    want, last = [], {}
    for k, n, v in sorted(rows):
        want.append((k, n, v, last.get(k)))
        last[k] = v
    assert sorted((r["key"], r["n"], r["v"], r["before"]) for r in got) == want
