"""Smaller rules around candidates: classes of messages and misconceptions, routes of repair, visuals, answer shapes, hints, fast acceptance, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexmill.operators import contexts, rules
from lexmill.operators.rules import GAP, _in, _tokens, _word
from lexmill.plans.registry import query, read
from lexmill.plans.shared import steps_sql, values, with_steps

# The agents that a status message names, in the order in which they are tried.
AGENTS = [
    (["plan", "blueprint"], "PlannerAgent"),
    (["generator", "fast"], "QuestionGeneratorAgent"),
    (["slot", "writer"], "QuestionWriterAgent"),
    (["distract"], "DistractorAgent"),
    (["critic", "rubric"], "LLMJudge"),
    (["verif"], "VerifierAgent"),
    (["refin"], "RefinerAgent"),
    (["format"], "FormatterAgent"),
    (["render"], "RendererAgent"),
]
# Words of a misconception and the type of distractor that they tell.
MISCONCEPTIONS = [
    (["cộng", "nhân", "tính", "sai số", "formula"], "computation_error"),
    (["bỏ qua", "điều kiện", "ràng buộc", "constraint"], "missing_condition"),
    (["nhầm", "đọc", "misread"], "misread_problem"),
    (["khái niệm", "định nghĩa", "concept"], "conceptual_confusion"),
]
# Codes and markers that send a candidate back to one writer or the other.
TO_DISTRACTOR = ["bad_distractors", "distractor_validator_failed", "multi_answer"]
TO_WRITER = ["verifier_failed", "duplicate_question", "generation_parse_error", "writer_empty", "quality_low", "explanation_low_quality", "grounding_low", "quote_mismatch", "context_missing", "context_too_noisy", "customization_mismatch"]
DISTRACTOR_MARKERS = ["distractor_validator", "option_text_sanity", "iwf_", "multi_answer", "answer_uniqueness", "uniqueness", "distractor_plausibility", "duplicate distractor", "format_consistency"]
LEVELS = ["Nhận biết", "Thông hiểu", "Vận dụng", "Vận dụng cao"]

NAMES = "note_id message code level".split()
NOTES = [
    (1, "Planner: building blueprint", "", "Nhận biết"),
    (2, "Distractor: nhầm dấu khi tính", "bad_distractors", "Vận dụng"),
    (3, "verifier=false for q_001", "verifier_failed", "Thông hiểu"),
    (4, "critic rubric: clarity low", "", "Vận dụng cao"),
    (5, "IWF_absolute found; format_consistency", "", "khác"),
    (6, "bỏ qua điều kiện xác định", "no_such_code", None),
    (7, "định nghĩa bị hiểu sai", "grounding_low", "Nhận biết"),
    (8, "rendering figure", "cancelled", "Vận dụng"),
    (9, None, None, ""),
]
_BULK = """SELECT 100 + event_id AS note_id, CASE event_type WHEN 'click' THEN 'writer slot ' || CAST(event_id % 9 AS STRING) WHEN 'view' THEN 'rendering view' WHEN 'error' THEN 'verifier error: misread' WHEN 'purchase' THEN 'format check; answer_uniqueness' ELSE 'other' END AS message,
 CASE event_id % 5 WHEN 0 THEN 'multi_answer' WHEN 1 THEN 'quote_mismatch' WHEN 2 THEN 'odd_code' ELSE '' END AS code, CASE event_id % 6 WHEN 0 THEN 'Nhận biết' WHEN 1 THEN 'Thông hiểu' WHEN 2 THEN 'Vận dụng' WHEN 3 THEN 'Vận dụng cao' ELSE 'x' END AS level FROM events"""
SOURCE = f"SELECT note_id, coalesce(message, '') AS message, coalesce(code, '') AS code, coalesce(level, '') AS level FROM ({values(NOTES, NAMES)} UNION ALL {_BULK})"


def notes(spark, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame(NOTES, "note_id long, message string, code string, level string")
    bulk = read(spark, sf_dir, "events").selectExpr(*(x.strip() for x in rules._split(_BULK[len("SELECT ") : -len(" FROM events")])))
    return samples.unionByName(bulk).select("note_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("message", "code", "level")))


def _first(column: str, classes: list[tuple[list[str], str]], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {_in(column, *words)} THEN '{name}'" for words, name in classes) + f" ELSE {rest} END"


def _list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_CODES = _list(["accepted", "cancelled", *TO_DISTRACTOR, *TO_WRITER])
_NOTES = [
    ["lower(message) AS low"],
    [
        f"{_first('low', AGENTS, 'NULL')} AS agent",
        f"{_first('low', MISCONCEPTIONS, chr(39) + 'plausible_misconception' + chr(39))} AS mistake",
        f"CASE WHEN code IN ({_list(TO_DISTRACTOR)}) THEN 'distractor' WHEN code IN ({_list(TO_WRITER)}) THEN 'writer' WHEN {_in('low', *DISTRACTOR_MARKERS)} THEN 'distractor' ELSE 'writer' END AS route",
        f"CASE WHEN code IN ({_CODES}) THEN code ELSE 'unknown' END AS reason",
        f"CASE WHEN code <> '' AND code NOT IN ({_CODES}) THEN code ELSE '' END AS raw_code",
        "CASE level " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(LEVELS)) + " ELSE 1 END AS level_index",
        "CASE level " + " ".join(f"WHEN '{x}' THEN {k}" for x, k in zip(LEVELS, (30, 50, 70, 85), strict=True)) + " ELSE 50 END AS target",
    ],
]
_NOTES_SQL = steps_sql(SOURCE, _NOTES)


@query(f"SELECT note_id, agent FROM ({_NOTES_SQL})")
def message_agents(spark, sf_dir):
    """The agent that a status message speaks of, or null."""
    return with_steps(notes(spark, sf_dir), _NOTES).select("note_id", "agent")


@query(f"SELECT note_id, mistake FROM ({_NOTES_SQL})")
def misconception_types(spark, sf_dir):
    """The type of distractor that a misconception's words tell."""
    return with_steps(notes(spark, sf_dir), _NOTES).select("note_id", "mistake")


@query(f"SELECT note_id, route FROM ({_NOTES_SQL})")
def repair_routes(spark, sf_dir):
    """Whom a rejected candidate goes back to: by its code, else by its message."""
    return with_steps(notes(spark, sf_dir), _NOTES).select("note_id", "route")


@query(f"SELECT note_id, reason, raw_code, substr(message, 1, 500) AS message FROM ({_NOTES_SQL})")
def reject_entries(spark, sf_dir):
    """Reject entries with a known code; an unknown one is kept beside."""
    return with_steps(notes(spark, sf_dir), _NOTES).select("note_id", "reason", "raw_code", F.substring("message", 1, 500).alias("message"))


@query(f"SELECT note_id, level_index::BIGINT AS level_index, target::BIGINT AS target FROM ({_NOTES_SQL})")
def level_targets(spark, sf_dir):
    """A level's place in the taxonomy, the second one if unknown, and its target difficulty in hundredths."""
    return with_steps(notes(spark, sf_dir), _NOTES).select("note_id", F.col("level_index").cast("long").alias("level_index"), F.col("target").cast("long").alias("target"))


# -- rules on candidates ------------------------------------------------------------------------------------------------

_SHAPE = [
    [f"regexp_replace(answer, '{GAP}+', ''@g) AS compact"],
    ["CASE WHEN @rx(compact, '^[-+−]?[0-9]+([.,][0-9]+)?(/[0-9]+([.,][0-9]+)?)?$') THEN 'number' WHEN contains(answer, chr(92)) OR @rx(answer, '^[-0-9A-Za-zÀ-ỹĐđ +−*/=^().,]+$') AND @rx(answer, '[-+−*/=^()]') THEN 'expression' WHEN substr(answer, 1, 1) IN ('[', '{', '(') AND substr(answer, length(answer), 1) IN (']', '}', ')') THEN 'set' ELSE 'phrase' END AS shape"],
]


@query(f"SELECT item_id, shape FROM ({steps_sql(rules.SOURCE, _SHAPE)})")
def answer_shapes(spark, sf_dir):
    """Whether an answer is a number, an expression, a set or a phrase."""
    return with_steps(rules.candidates(spark, sf_dir), _SHAPE).select("item_id", "shape")


_HINTS = [
    ["CASE item_id % 9 WHEN 0 THEN 'modular' WHEN 1 THEN 'analytic_geometry' WHEN 2 THEN 'probability' ELSE hint END AS type", "CASE item_id % 7 WHEN 0 THEN 'modular_power' WHEN 1 THEN 'remainder' WHEN 2 THEN 'point_plane_distance' WHEN 3 THEN 'distance_point_line' ELSE '' END AS op", "item_id % 2 = 0 AS has_base"],
    [
        """CASE WHEN type = 'modular' THEN CASE WHEN op IN ('modular_exponentiation', 'modular_power', 'pow_mod') THEN 'mod_pow' WHEN op IN ('remainder', 'modulo') THEN 'mod' WHEN op <> '' THEN op WHEN has_base THEN 'mod_pow' ELSE 'mod' END
 WHEN type = 'analytic_geometry' THEN CASE WHEN op IN ('point_plane_distance', 'distance_point_plane') THEN 'distance_point_plane_3d' WHEN op IN ('point_line_distance', 'distance_point_line') THEN 'distance_point_line_2d' ELSE op END ELSE op END AS operation""",
        "CASE WHEN type = 'probability' THEN expr ELSE '' END AS formula",
        "CASE WHEN expected <> '' THEN expected WHEN type IN ('analytic_geometry', 'probability', 'counting', 'modular', 'numeric_eval', 'limit') THEN answer ELSE '' END AS filled",
    ],
]


@query(f"SELECT item_id, type, operation, formula, filled FROM ({steps_sql(rules.SOURCE, _HINTS)})")
def verifier_hints(spark, sf_dir):
    """Verifier hints with operations under one name, a probability's formula, and a missing expectation from the answer."""
    return with_steps(rules.candidates(spark, sf_dir), _HINTS).select("item_id", "type", "operation", "formula", "filled")


_VISUALS = [
    ["lower(stem || CASE item_id % 17 WHEN 0 THEN ' Dựa vào bảng chân trị' WHEN 1 THEN ' ma trận sau' WHEN 2 THEN ' đồ thị sau' WHEN 3 THEN ' cây đã cho' WHEN 4 THEN ' biểu đồ Venn' WHEN 5 THEN ' quan sát hình' ELSE '' END) AS low", "CASE item_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'matrix' WHEN 2 THEN 'truth_table' WHEN 3 THEN 'tree' ELSE 'graph_network' END AS visual", "item_id % 4 AS cells", "item_id % 3 AS others"],
    [
        f"CASE WHEN @rx(low, 'bảng{GAP}+chân{GAP}+(lý|trị)|bảng{GAP}+(sau|trên|dưới|đã{GAP}+cho)') THEN 'truth_table' WHEN @rx(low, 'ma{GAP}+trận{GAP}+(sau|trên|đã{GAP}+cho|nào)') THEN 'matrix' WHEN @rx(low, '(đồ{GAP}+thị|graph){GAP}+(sau|trên|đã{GAP}+cho|nào|với{GAP}+các)|(số{GAP}+đỉnh|số{GAP}+cạnh|bậc{GAP}+đỉnh).{{0,30}}(sau|trên|đã{GAP}+cho)') THEN 'graph_network' WHEN @rx(low, 'cây{GAP}+(sau|trên|đã{GAP}+cho|nào)') THEN 'tree' WHEN @rx(low, '(sơ|biểu){GAP}+đồ{GAP}+venn') THEN 'venn_diagram' WHEN @rx(low, '(dựa{GAP}+vào|theo|quan{GAP}+sát|xem){GAP}+hình') THEN 'function_graph' ELSE '' END AS wanted",
        "CASE visual WHEN 'truth_table' THEN cells > 0 AND others > 0 WHEN 'matrix' THEN cells > 0 WHEN 'graph_network' THEN cells >= 2 WHEN 'tree' THEN cells >= 2 ELSE TRUE END AS valid",
    ],
]


@query(f"SELECT item_id, wanted, wanted = '' OR wanted = visual AS consistent, valid FROM ({steps_sql(rules.SOURCE, _VISUALS)})")
def visual_checks(spark, sf_dir):
    """The visual that a stem asks for, whether the item has it, and whether its parts are there."""
    return with_steps(rules.candidates(spark, sf_dir), _VISUALS).select("item_id", "wanted", F.expr("wanted = '' or wanted = visual").alias("consistent"), "valid")


_FAST = [
    rules.FOLDS,
    rules.SHARED,
    [f"@uniq({_tokens('f_expl')}) AS t_expl", "CASE WHEN hint = 'numeric_eval' THEN replace(trim(expected), ',', '.') = replace(trim(answer), ',', '.') END AS verified", "@rx(lower(expl), '(increase|more|plus|tăng).{0,50}(decrease|less|minus|giảm)') AS contradiction"],
    ["@size(@both(t_quote, t_expl)) * 2 >= @size(t_quote) AND @size(t_quote) > 0 AS supported"],
    ["(coalesce(verified, FALSE) AND length(answer) <= 80 OR verified IS NULL AND hint IN ('', 'none') AND length(answer) <= 260) AND NOT contradiction AND expl <> '' AND supported AS accepted"],
]


@query(f"SELECT item_id, accepted, CASE WHEN accepted THEN 86 ELSE 0 END::BIGINT AS quality, CASE WHEN NOT accepted THEN '' WHEN verified THEN 'verified_short_answer_fast_path' ELSE 'grounded_rule_valid_fast_path' END AS path FROM ({steps_sql(rules.SOURCE, _FAST)})")
def fast_accepts(spark, sf_dir):
    """Short verified or grounded answers without contradiction, with explanation and a supported quote, at a constant score."""
    rows = with_steps(rules.candidates(spark, sf_dir), _FAST)
    path = F.when(~F.col("accepted"), "").when(F.col("verified"), "verified_short_answer_fast_path").otherwise("grounded_rule_valid_fast_path")
    return rows.select("item_id", "accepted", F.when(F.col("accepted"), 86).otherwise(0).cast("long").alias("quality"), path.alias("path"))


_TRACE = [[*rules.FOLDS, *(f"FOLD({c}) AS f_{c}" for c in ("d1", "d2", "d3"))], [f"@uniq({_tokens('f_span')}) AS of", *(f"@uniq({_tokens(f'f_{c}')}) AS t_{c}" for c in ("d1", "d2", "d3"))], [f"@size(@both(of, t_{c})) AS n_{c}" for c in ("d1", "d2", "d3")]]


@query(f"SELECT item_id, n_d1::BIGINT AS n1, n_d2::BIGINT AS n2, n_d3::BIGINT AS n3, n_d1 >= 2 AND n_d2 >= 2 AND n_d3 >= 2 AS passed FROM ({steps_sql(rules.SOURCE, _TRACE)})")
def distractor_traces(spark, sf_dir):
    """How many words each distractor shares with its source; two each are enough."""
    rows = with_steps(rules.candidates(spark, sf_dir), _TRACE)
    return rows.select("item_id", *(F.col(f"n_d{k}").cast("long").alias(f"n{k}") for k in (1, 2, 3)), F.expr("n_d1 >= 2 and n_d2 >= 2 and n_d3 >= 2").alias("passed"))


# -- rules on contexts --------------------------------------------------------------------------------------------------

# Words of concepts.
_CONCEPT = "nguyên hàm|nguyen ham|tích phân|tich phan|diện tích|dien tich|vận tốc|van toc|lưu lượng|luu luong|điện lượng|dien luong|[=<>∫]"
_QUOTES = [
    [f"trim(regexp_replace(clean, '{GAP}+', ' '@g)) AS line"],
    ["@each(regexp_extract_all(line, '[^.!?]+[.!?]*', 0), @s: trim(s)) AS parts"],
    [f"@keep(parts, @s: length(s) BETWEEN 20 AND 260 AND NOT @rx(lower(s), '^(topic|chunk type|context type|title) *:') AND NOT @rx(lower(s), '(^|[^a-z0-9])(cau|bai|question|exercise) *[0-9]') AND @rx(lower(s), '{_CONCEPT}')) AS good"],
    ["CASE WHEN @size(good) > 0 THEN concat_ws(chr(10), @at(good, 1), @at(good, 2), @at(good, 3), @at(good, 4)) WHEN length(trim(substr(line, 1, 240))) >= 20 THEN trim(substr(line, 1, 240)) ELSE '' END AS quotes"],
]


@query(f"SELECT context_id, @COUNT::BIGINT AS n, quotes FROM ({steps_sql(contexts.SOURCE, _QUOTES)})".replace("@COUNT", "len(good)"))
def quote_candidates(spark, sf_dir):
    """The first four sentences that can serve as source quotes; without any, the text's beginning. The limit is the feature."""
    return with_steps(contexts.contexts(spark, sf_dir), _QUOTES).select("context_id", F.size("good").cast("long").alias("n"), "quotes")


# Mathematical objects.
OBJECTS = ["ma trận", "đồ thị", "cây", "tập hợp", "hoán vị", "chỉnh hợp", "tổ hợp", "xác suất", "mệnh đề", "hàm số", "phương trình", "vector", "không gian"]
_LABELS = [
    ["lower(clean) AS low"],
    [
        "concat_ws('; ', " + ", ".join(f"CASE WHEN @rx(low, '(^|[^a-zà-ỹđ0-9_]){x}($|[^a-zà-ỹđ0-9_])') THEN '{x}' END" for x in OBJECTS) + ") AS objects",
        f"concat_ws('; ', CASE WHEN @rx(low, 'định{GAP}+nghĩa|công{GAP}+thức') THEN 'nhận diện định nghĩa/công thức' END, CASE WHEN @rx(low, 'định{GAP}+lý|hệ{GAP}+quả') THEN 'áp dụng định lý' END, CASE WHEN @rx(low, 'ví{GAP}+dụ|lời{GAP}+giải') THEN 'tính toán theo ví dụ' END, CASE WHEN @rx(low, '[=≤≥<>^]|{_word('mod')}') THEN 'suy luận với ký hiệu toán' END) AS skills",
    ],
]


@query(f"SELECT context_id, objects, skills FROM ({steps_sql(contexts.SOURCE, _LABELS)})")
def context_labels(spark, sf_dir):
    """Mathematical objects and skills that a context's words tell."""
    return with_steps(contexts.contexts(spark, sf_dir), _LABELS).select("context_id", "objects", "skills")


_SPANS = [
    [f"trim(regexp_replace(text, '{GAP}+', ' '@g)) AS line"],
    # a mark that text doesn't have, before each question's number
    [f"regexp_replace(line, '(^|[ .;:])((c(au|âu)|b(ai|ài)|C(au|âu)|B(ai|ài)|question|Question|exercise|Exercise) *[0-9]+)', '¦@2'@g) AS marked"],
    ["@keep(@each(regexp_extract_all(marked, '¦[^¦]+', 0), @s: trim(substr(s, 2, 420))), @s: length(s) > 0) AS spans"],
    ["concat_ws(chr(10), @at(spans, 1), @at(spans, 2), @at(spans, 3), @at(spans, 4), @at(spans, 5), @at(spans, 6)) AS found"],
]


def _group(steps: list[list[str]], sign: str) -> list[list[str]]:
    return [[x.replace("¦@2", "¦" + sign + "2") for x in step] for step in steps]


@query(f"SELECT context_id, len(spans)::BIGINT AS n, found FROM ({steps_sql(contexts.SOURCE, _group(_SPANS, chr(92)))})")
def question_spans(spark, sf_dir):
    """Questions that a text already holds, from each numbered marker to the next, 420 characters at most; the first six are the feature."""
    return with_steps(contexts.contexts(spark, sf_dir), _group(_SPANS, "$")).select("context_id", F.size("spans").cast("long").alias("n"), "found")


_LINES = [
    ["regexp_extract_all(text, '[^\n]+', 0) AS every"],
    ["@each(every, @s: trim(s)) AS every_"],
    ["@keep(every_, @s: length(s) BETWEEN 12 AND 140 AND length(regexp_replace(s, '[^A-Za-zÀ-ỹ]', ''@g)) * 20 >= length(s) * 9) AS fine", "@keep(every_, @s: @rx(s, '^(#{1,4} |[0-9]+([.][0-9]+)*[.]? [A-ZÀ-Ý])') AND length(s) <= 140) AS heads"],
    ["coalesce(@at(heads, 1), '') AS heading", "coalesce(@at(fine, 1), '') AS good_line"],
]


@query(f"SELECT context_id, heading, good_line, coalesce(nullif(heading, ''), nullif(good_line, ''), 'Toán') AS topic FROM ({steps_sql(contexts.SOURCE, _LINES)})")
def inferred_topics(spark, sf_dir):
    """A text's topic: its first heading, else its first line of words, else the subject's name."""
    rows = with_steps(contexts.contexts(spark, sf_dir), _LINES)
    return rows.select("context_id", "heading", "good_line", F.expr("coalesce(nullif(heading, ''), nullif(good_line, ''), 'Toán')").alias("topic"))


#: Patterns of a knowledge base and their keywords.
PATTERNS = [("integral", ["tích phân", "nguyên hàm"]), ("area", ["diện tích", "hình elip"]), ("combinatorics", ["tổ hợp", "chỉnh hợp"]), ("limit", ["giới hạn", "dãy số"]), ("license", ["license", "email"]), ("the", ["the"])]
_EDGE = "(^|[^a-zà-ỹđ0-9_])"
_hits = lambda c, k: f"(length(regexp_replace({c}, '{_EDGE}{k}', '¦'@g)) - length(replace(regexp_replace({c}, '{_EDGE}{k}', '¦'@g), '¦', '')))"
_SCORES = [
    ["replace(lower(topic), '¦', ' ') AS low_topic", "replace(lower(clean), '¦', ' ') AS low"],
    [f"({' + '.join(_hits('low_topic', k) for k in words)}) * 8 + least({' + '.join(_hits('low', k) for k in words)}, 8) AS s_{name}" for name, words in PATTERNS],
    ["greatest(" + ", ".join(f"s_{name}" for name, _ in PATTERNS) + ") AS top"],
    ["concat_ws(',', " + ", ".join(f"CASE WHEN s_{name} > 0 AND s_{name} * 100 >= greatest(100, top * 45) THEN '{name}' END" for name, _ in PATTERNS) + ") AS patterns"],
]


@query(f"SELECT context_id, top::BIGINT AS top, patterns FROM ({steps_sql(contexts.SOURCE, _SCORES)})")
def topic_patterns(spark, sf_dir):
    """Patterns whose keywords stand in topic (eight points each) and text (eight at most), from 45 % of the best score on."""
    return with_steps(contexts.contexts(spark, sf_dir), _SCORES).select("context_id", F.col("top").cast("long").alias("top"), "patterns")


# Ordered patterns of plain mathematics and their LaTeX.
_LATEX = [
    ["regexp_replace(regexp_replace(answer || ' sqrt(' || d1 || ') + C(5, 2) ** ' || d2, '[*][*]', '~'@g), '(^|[^a-zA-Z0-9_])(C|binomial) *[(] *([^,()]+) *, *([^()]+) *[)]', '@1¦binom{@3}{@4}'@g) AS step1"],
    ["regexp_replace(step1, '(^|[^a-zA-Z0-9_¦])sqrt *[(] *([^()]+) *[)]', '@1¦sqrt{@2}'@g) AS step2"],
    [f"trim(regexp_replace(replace(replace(step2, '¦', chr(92)), '~', '^'), '{GAP}+', ' '@g)) AS latex"],
]


def _groups(steps: list[list[str]], sign: str) -> list[list[str]]:
    out = []
    for step in steps:
        for k in "1234":
            step = [x.replace(f"@{k}", sign + k) for x in step]
        out.append(step)
    return out


@query(f"SELECT item_id, latex FROM ({steps_sql(rules.SOURCE, _groups(_LATEX, chr(92)))})")
def latex_forms(spark, sf_dir):
    """Powers, binomials and roots of plain text as LaTeX."""
    return with_steps(rules.candidates(spark, sf_dir), _groups(_LATEX, "$")).select("item_id", "latex")


# Labels that a reply leaks.
_LEAK = "(answer explanation|reasoning|explanation|lời giải|giải thích) *:"
_SHOWN = [
    ["stem || CASE item_id % 3 WHEN 0 THEN ' Reasoning: because' WHEN 1 THEN ' ,' ELSE '' END AS raw"],
    [f"CASE WHEN @rx(lower(raw), '^ *{_LEAK}') THEN regexp_replace(raw, '^ *[^:]*: *', '') ELSE trim(@at(regexp_extract_all(replace(raw, chr(10), ' ') || ' Reasoning:', '^(.*?)(Answer explanation|Reasoning|Explanation|Lời giải|Giải thích) *:', 1), 1)) END AS cut"],
    ["trim(regexp_replace(trim(cut), '[,;:] *$', '')) AS shown"],
    ["CASE WHEN length(shown) > 280 THEN substr(shown, 1, 280) ELSE shown END AS text"],
]


@query(f"SELECT item_id, text FROM ({steps_sql(rules.SOURCE, _SHOWN)})")
def display_texts(spark, sf_dir):
    """A stem as it is shown: without what leaks behind a label, without a dangling mark, 280 characters at most."""
    return with_steps(rules.candidates(spark, sf_dir), _SHOWN).select("item_id", "text")


# -- listings and joins --------------------------------------------------------------------------------------------------


@query("SELECT user_id AS session, count(*) AS answers, max(ts) AS last FROM events GROUP BY user_id ORDER BY last DESC, session LIMIT 50")
def recent_sessions(spark, sf_dir):
    """The fifty sessions that were active last; the report's length is the feature."""
    rows = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(F.count("*").alias("answers"), F.max("ts").alias("last"))
    return rows.orderBy(F.desc("last"), "session").limit(50)


@query("SELECT e.event_id AS answer_id, o.o_orderkey AS item_id, e.value > o.o_totalprice % 100 AS correct FROM events e JOIN orders o ON o.o_orderkey = e.event_id % 1000 + 1")
def answers_to_items(spark, sf_dir):
    """Each answer with its item, and whether it is right."""
    items = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), "o_totalprice")
    answers = read(spark, sf_dir, "events").select(F.col("event_id").alias("answer_id"), "value", (F.col("event_id") % 1000 + 1).alias("item_id"))
    return answers.join(items, "item_id").select("answer_id", "item_id", (F.col("value") > F.col("o_totalprice") % 100).alias("correct"))


_MERGE = [["CASE context_id % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE 'Model: ' || topic END AS other"], ["coalesce(nullif(trim(other), ''), topic) AS merged", "substr(coalesce(nullif(trim(formulas), ''), clean), 1, 200) AS key"]]


@query(f"SELECT context_id, merged, key FROM ({steps_sql(contexts.SOURCE, _MERGE)})")
def merged_contexts(spark, sf_dir):
    """Fields of a second reading of a context override the first one's where they aren't empty."""
    return with_steps(contexts.contexts(spark, sf_dir), _MERGE).select("context_id", "merged", "key")


_RICH = [
    *contexts._PLAN,
    ["concat_ws('. ', 'Focus: ' || shown, CASE WHEN formula THEN 'Use the formula' END, CASE kind WHEN 'exercise' THEN 'Write a new item' WHEN 'example' THEN 'Vary the example' ELSE 'Ask for the idea' END) AS rationale", "CASE WHEN formula THEN 'wrong step or formula' ELSE 'neighbouring concept' END AS strategy"],
]


@query(f"SELECT context_id, rationale, strategy FROM ({steps_sql(contexts.SOURCE, _RICH)})")
def slot_notes(spark, sf_dir):
    """What a slot's text says of its focus, and how its distractors are to be made."""
    return with_steps(contexts.contexts(spark, sf_dir), _RICH).select("context_id", "rationale", "strategy")


_KEYWORDS = [["FOLD(topic) AS f_topic", "FOLD(formulas) AS f_formulas"], ["@sort(@uniq(regexp_extract_all(f_topic || ' ' || f_formulas, '[a-z0-9]{3,}', 0))) AS words"]]


@query(f"SELECT context_id, array_to_string(words, ' ') AS keywords FROM ({steps_sql(contexts.SOURCE, _KEYWORDS)})")
def slot_keywords(spark, sf_dir):
    """The folded words of a slot's topic and formulas, each once, in order."""
    return with_steps(contexts.contexts(spark, sf_dir), _KEYWORDS).select("context_id", F.array_join("words", " ").alias("keywords"))
