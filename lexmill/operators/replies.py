"""Whole candidates from replies: JSON under any of its names, or blocks of labelled text, with options, reasons and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import text as T
from lexmill.plans.registry import query, read

# The names that a field may have, the first that isn't empty counts; and the labels of a text reply, in order.
FIELDS = {
    "question": ["question_text", "question", "stem"],
    "explanation": ["answer_explanation_text", "explanation", "short_explanation"],
    "quote": ["source_quote_text", "source_quote"],
    "given_answer": ["answer_text", "answer"],
}
OPTION_KEY, OPTION_TEXT = ["key", "label"], ["text", "option"]
DISTRACTOR_TEXT, DISTRACTOR_REASON = ["distractor_text", "text", "option"], ["distractor_explanation_text", "explanation", "reason"]
WHY_KEY, WHY_TEXT = ["option", "key"], ["reason", "explanation"]
LABELS = {"question": ("Question:", ["Answer explanation:"]), "explanation": ("Answer explanation:", ["Answer:"]), "given_answer": ("Answer:", ["Source quote:", "Verifier hint:"]), "quote": ("Source quote:", ["Visual:", "Verifier hint:"])}
MOST = 3


def first_of(v: Column, names: list[str]) -> Column:
    """The first of some fields of a variant that isn't an empty text."""
    found = [F.try_variant_get(v, f"$.{n}", "string") for n in names]
    return F.coalesce(*(F.when(f != "", f) for f in found), F.lit(""))


def scalar(v: Column) -> Column:
    """A variant's own text, if it isn't an object or a list."""
    return F.when(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit("")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))


def bare_quote(c: Column) -> Column:
    return T.strip(F.regexp_replace(T.strip(c), "^[\"“”]+|[\"“”]+$", ""))


def between(text: Column, label: str, ends: list[str]) -> Column:
    """What follows a label up to the first of the labels behind it, trimmed; an empty text without the label."""
    stop = "|".join(ends)
    return T.strip(F.regexp_extract(text, f"(?s)(?:^|\n){label}(.*?)(?:\n(?:{stop})|$)" if ends else f"(?s)(?:^|\n){label}(.*)$", 1))


def from_json(rows: DataFrame) -> DataFrame:
    """rows (item_id, reply, v: its variant) of replies that are objects, as candidates."""
    v = F.col("v")
    rows = rows.select("item_id", "v", *(first_of(v, names).alias(f) for f, names in FIELDS.items()), F.upper(T.strip(first_of(v, ["answer_key"]))).alias("answer_key"))
    named = F.try_variant_get("v", "$.why_others_wrong", "map<string,string>")
    each = F.try_variant_get("v", "$.why_others_wrong", "array<variant>")
    why = F.coalesce(F.when(named.isNotNull(), F.map_entries(named)), F.transform(each, lambda w: F.struct(first_of(w, WHY_KEY).alias("key"), first_of(w, WHY_TEXT).alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))
    options = F.coalesce(F.try_variant_get("v", "$.options", "array<variant>"), F.array().cast("array<variant>"))
    key = lambda o, i: F.upper(T.strip(F.coalesce(F.nullif(first_of(o, OPTION_KEY), F.lit("")), F.chr(i + 65))))
    option = lambda o, i: F.struct(key(o, i).alias("key"), T.strip(F.coalesce(F.nullif(first_of(o, OPTION_TEXT), F.lit("")), scalar(o))).alias("text"))
    given = F.coalesce(F.try_variant_get("v", "$.distractors", "array<variant>"), F.array().cast("array<variant>"))
    listed = F.transform(given, lambda d: F.struct(F.coalesce(F.nullif(first_of(d, DISTRACTOR_TEXT), F.lit("")), scalar(d)).alias("text"), first_of(d, DISTRACTOR_REASON).alias("reason")))
    steps = F.size(F.coalesce(F.try_variant_get("v", "$.detailed_solution.steps", "array<variant>"), F.try_variant_get("v", "$.detailed_solution", "array<variant>"), F.array().cast("array<variant>")))
    rows = rows.withColumn("why", why).withColumn("options", F.filter(F.transform(options, option), lambda o: (o.key != "") & (o.text != ""))).withColumn("listed", F.filter(listed, lambda d: d.text != "")).withColumn("n_steps", steps.cast("long"))
    right = F.filter("options", lambda o: o.key == F.col("answer_key"))
    rows = rows.withColumn("right", F.get(right, 0)["text"])
    reason = lambda o: F.coalesce(F.get(F.filter("why", lambda w: F.upper(w.key) == o.key), 0)["value"], F.lit(""))
    wrong = F.transform(F.array_sort(F.filter("options", lambda o: o.key != F.col("answer_key"))), lambda o: F.struct(o.text.alias("text"), reason(o).alias("reason")))
    # options count if the key is among them and there are others; else the list of distractors does
    own = F.when(F.col("right").isNotNull() & (F.size(wrong) > 0), wrong).otherwise(F.col("listed"))
    return rows.select("item_id", F.lit("json").alias("kind"), "question", T.strip(F.col("explanation")).alias("explanation"), F.coalesce("right", "given_answer").alias("answer"), bare_quote(F.col("quote")).alias("quote"), "answer_key", F.slice(own, 1, MOST).alias("distractors"), "n_steps")


def from_labels(rows: DataFrame) -> DataFrame:
    """rows (item_id, reply) of labelled text, as candidates; distractors are blocks between blank lines."""
    reply = F.col("reply")
    part = {f: between(reply, label, ends) for f, (label, ends) in LABELS.items()}
    blocks = F.split(between(reply, "Distractors:", []), "\n[ \t\r]*\n")
    found = F.transform(blocks, lambda b: F.struct(between(b, "Distractor:", []).alias("text"), between(b, "Distractor explanation:", ["Distractor:"]).alias("reason")))
    own = F.filter(found, lambda d: d.text != "")
    return rows.select("item_id", F.lit("labels").alias("kind"), part["question"].alias("question"), part["explanation"].alias("explanation"), part["given_answer"].alias("answer"), bare_quote(part["quote"]).alias("quote"), F.lit("").alias("answer_key"), F.slice(own, 1, MOST).alias("distractors"), F.lit(0).cast("long").alias("n_steps"))


def parsed_replies(rows: DataFrame) -> DataFrame:
    """One candidate a row of replies (item_id, reply): those that hold a JSON object by its fields, others by labels.

    A reply that is neither gives empty texts and no distractors; so does a null one. Three distractors are kept, which is
    what a candidate has.
    """
    rows = rows.select("item_id", F.coalesce("reply", F.lit("")).alias("reply")).withColumn("v", F.try_parse_json("reply"))
    whole = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return from_json(rows.filter(whole)).unionByName(from_labels(rows.filter(~whole)))


#: Replies written from the columns k (key), n (a number) and the words a, b of an order's row, in seven forms.
_REPLIES = """SELECT o_orderkey AS item_id, CASE o_orderkey % 7
 WHEN 0 THEN '{"question_text": "Q' || n || '?", "answer_key": "b", "options": [{"key": "A", "text": "' || n || '"}, {"label": "B", "option": "' || p || '"}, "x' || n || '", {"key": "D", "text": ""}], "why_others_wrong": {"A": "too small", "C": "odd"}, "source_quote": "“said ' || p || '”", "detailed_solution": {"steps": ["one", "two"]}}'
 WHEN 1 THEN '{"stem": "S' || n || '", "question": "", "answer": "' || n || '", "distractors": ["1", {"text": "' || p || '", "reason": "guess"}, "", {"option": "3"}, "4"], "short_explanation": " since ' || n || ' "}'
 WHEN 2 THEN '{"question": "K", "answer_key": "E", "answer_text": "given", "options": ["a", "b"], "distractors": [{"distractor_text": "' || p || '", "distractor_explanation_text": "e"}], "detailed_solution": ["s"]}'
 WHEN 3 THEN '{"question": "Z", "answer_key": "A", "options": ["' || n || '", "b", "c", "d", "e"], "why_others_wrong": [{"option": "B", "reason": "rb"}, {"key": "c", "explanation": "rc"}]}'
 WHEN 4 THEN 'Question: How many ' || p || '?' || chr(10) || 'Answer explanation: as ' || n || chr(10) || 'Answer: ' || n || chr(10) || 'Source quote: "' || p || '"' || chr(10) || 'Verifier hint: none' || chr(10) || 'Distractors:' || chr(10) || 'Distractor category: c' || chr(10) || 'Distractor explanation: too few' || chr(10) || 'Distractor: 1' || chr(10) || chr(10) || 'Distractor: ' || n
 WHEN 5 THEN '{"question": "cut off ' || n ELSE '["' || p || '"]' END AS reply FROM (SELECT o_orderkey, CAST(o_custkey AS STRING) AS n, lower(substr(o_orderpriority, 3)) AS p FROM orders)"""
_D = "CASE o_orderkey % 7 WHEN 0 THEN n || '~too small|x' || n || '~odd' WHEN 1 THEN '1~|' || p || '~guess|3~' WHEN 2 THEN p || '~e' WHEN 3 THEN 'b~rb|c~rc|d~' WHEN 4 THEN '1~too few|' || n || '~' ELSE '' END"


@query(
    f"""SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 7 < 4 THEN 'json' ELSE 'labels' END AS kind, CASE o_orderkey % 7 WHEN 0 THEN 'Q' || n || '?' WHEN 1 THEN 'S' || n WHEN 2 THEN 'K' WHEN 3 THEN 'Z' WHEN 4 THEN 'How many ' || p || '?' ELSE '' END AS question,
 CASE o_orderkey % 7 WHEN 1 THEN 'since ' || n WHEN 4 THEN 'as ' || n ELSE '' END AS explanation, CASE o_orderkey % 7 WHEN 0 THEN p WHEN 1 THEN n WHEN 2 THEN 'given' WHEN 3 THEN n WHEN 4 THEN n ELSE '' END AS answer, CASE o_orderkey % 7 WHEN 0 THEN 'said ' || p WHEN 4 THEN p ELSE '' END AS quote,
 CASE o_orderkey % 7 WHEN 0 THEN 'B' WHEN 2 THEN 'E' WHEN 3 THEN 'A' ELSE '' END AS answer_key, {_D} AS distractors, CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS n_steps FROM (SELECT o_orderkey, o_custkey::VARCHAR AS n, lower(substr(o_orderpriority, 3)) AS p FROM orders)"""
)
def reply_candidates(spark, sf_dir):
    """Candidates from replies in seven forms, written from the orders; the SQL knows what each holds."""
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_custkey AS STRING) AS n", "lower(substr(o_orderpriority, 3)) AS p")
    got = parsed_replies(orders.selectExpr("o_orderkey AS item_id", _REPLIES[_REPLIES.index("CASE o_orderkey") : _REPLIES.index(" AS reply FROM")] + " AS reply"))
    return got.withColumn("distractors", F.array_join(F.transform("distractors", lambda d: F.concat(d.text, F.lit("~"), d.reason)), "|"))
