"""Rules for whole candidates: shape, quotes, solution depth, records, signatures and repeats of accepted items.

A candidate is a row of item_id, level, pattern, source_type, stem, answer, expl, quote, hint (verifier type), expr and
expected of it, options d1 to d3 with rationales r1 to r3, steps (solution steps, one a line, the first ``STEPS``), and
span (an existing question of its source).
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, functions as F

from lexmill.functions.shared import cut
from lexmill.plans.registry import query, read
from lexmill.plans.shared import steps_sql, values, with_steps

NAMES = "item_id level pattern source_type stem answer expl quote hint expr expected d1 d2 d3 r1 r2 r3 steps span".split()
TEXTS = [n for n in NAMES if n != "item_id"]
# Words that tell nothing of a question's content.
STOP = "cau hoi bai cho chon dap an dung sai mot cac trong sau la co voi duoc hay tinh tim phuong ans option topic chunk type context title step buoc ket luan".split()
GAP = "[ \t\n\r\x0b\x0c]"
#: Candidates that reach rules which the tables' prose doesn't.
SAMPLES = [
    (1, "Vận dụng", "computation", "theory", "Tính ∫_0^2 x dx", "2", "Tính phần diện tích", "Topic: tích phân", "none", "", "", "3", "4", "5", "tính nhầm", "sai dấu", "2 + 2 = 4", "Kết luận\nx = 2", ""),
    (2, "Nhận biết", "conceptual", "theory", "Khẳng định nào về nguyên hàm của hàm số liên tục trên đoạn là đúng?", "F là nguyên hàm của f", "Theo định nghĩa nguyên hàm của hàm số liên tục", "nguyên hàm của hàm số liên tục trên đoạn", "none", "", "", "f là nguyên hàm của F", "F là đạo hàm của f", "A.", "đảo vai trò", "đảo chiều", "nhãn", "Nhớ lại định nghĩa\nÁp dụng: F' = f", ""),
    (3, "Vận dụng cao", "application", "exercise", "Một xe chạy với vận tốc v(t) = 3t + 2 trong năm giây đầu, quãng đường xe chạy được bằng bao nhiêu mét?", "47,5", "Quãng đường bằng tích phân của vận tốc", "vận tốc v(t) = 3t + 2", "numeric_eval", "3*25/2 + 10", "47.5", "45", "47,5", "40", "thiếu một phần 5", "trùng", "cộng nhầm", "Lập tích phân\nTính 3*25/2 = 37.5\nCộng 10\nKết quả 47.5\nKiểm tra", "Câu 4. Một xe chạy với vận tốc v(t) = 3t + 2 trong năm giây đầu, quãng đường xe chạy được là bao nhiêu mét?"),
    (4, "Vận dụng", "application", "theory", "Chọn A. 1 B. 2 C. 3 D. 4", "B", "", "", "", "", "", "", "2", "3", "", "", "", "", ""),
    (5, "Thông hiểu", "reasoning", "theory", "Cho hàm f không âm và liên tục trên đoạn [a; b], dấu của ∫ f(x) dx là gì khi f(x) ≥ 0?", "Không âm", "Tích phân của hàm không âm thì không âm, vì f(x) ≥ 0", "hàm không âm có tích phân không âm", "none", "", "", "Âm", "Bằng 1", "Không xác định", "sai dấu", "nhầm số", "bỏ điều kiện", "f(x) ≥ 0\nTích phân ≥ 0\nVậy không âm", ""),
    (6, "Thông hiểu", "reasoning", "theory", "Cho hàm g không âm và liên tục trên đoạn [c; d], so sánh ∫ g(x) dx với 0 khi g(x) ≥ 0?", "Không nhỏ hơn 0", "g(x) ≥ 0 nên tích phân không âm", "hàm không âm có tích phân không âm", "none", "", "", "Nhỏ hơn 0", "Bằng 1", "Không xác định", "sai dấu", "nhầm số", "bỏ điều kiện", "g(x) ≥ 0\nTích phân ≥ 0\nVậy không âm", ""),
    (7, "Vận dụng", "computation", "theory", "Diện tích hình phẳng giới hạn bởi đồ thị y = x và trục hoành trên [0; 2] là bao nhiêu?", "2", "Diện tích bằng tích phân của x từ 0 đến 2, bằng 2", "Diện tích hình phẳng giới hạn bởi đồ thị y = f(x)", "numeric_eval", "2**2 / 2", "2", "1", "4", "3", "quên nửa", "quên chia 2", "cộng nhầm", "S = ∫ x dx\nS = 2\nVậy S = 2\nĐúng", ""),
    (8, "Vận dụng", "computation", "theory", "Một vật chuyển động với vận tốc không đổi 2 m/s trong 1 giây, quãng đường đi được bằng bao nhiêu?", "2", "Quãng đường 2 * 1 = 2", "vận tốc không đổi, quãng đường s = v t", "numeric_eval", "2^2/2", "2,0", "1", "4", "3", "chia 2", "nhân 4", "cộng 1", "s = v t\ns = 2\nVậy s = 2\nĐúng", ""),
    (9, "Vận dụng cao", "reasoning", "theory", "Giá trị của ∫_a^a f(x) dx bằng bao nhiêu với mọi hàm f liên tục?", "0", "Cận trùng nhau", "Tích phân có hai cận bằng nhau thì bằng 0", "integral", "", "0", "1", "a", "2a", "sai", "sai", "sai", "Cận trùng: ∫ = 0", ""),
    (10, "Vận dụng", "computation", "theory", "Biết nguyên hàm F của f(x) = cos x thoả F(0) = 1, khi đó F(x) là hàm nào trong các hàm sau?", "sin x + 1", "Nguyên hàm của cos x là sin x + C, F(0) = 1", "Nguyên hàm của cos x là sin x + C", "none", "", "", "cos x + 1", "sin x", "-sin x + 1", "nhầm", "thiếu hằng số", "sai dấu", "F = sin x + C\nC = 1\nF(x) = sin x + 1\nĐúng", ""),
]
_BULK = """SELECT 1000 + conv_id * 64 + turn AS item_id, CASE turn % 4 WHEN 0 THEN 'Nhận biết' WHEN 1 THEN 'Thông hiểu' WHEN 2 THEN 'Vận dụng' ELSE 'Vận dụng cao' END AS level,
 CASE conv_id % 3 WHEN 0 THEN 'computation' WHEN 1 THEN 'conceptual' ELSE 'reasoning' END AS pattern, CASE conv_id % 5 WHEN 0 THEN 'exercise' ELSE 'theory' END AS source_type, text AS stem,
 CAST(conv_id % 90 AS STRING) AS answer, text AS expl, split_part(text, '.', 1) AS quote, CASE turn % 3 WHEN 0 THEN 'numeric_eval' ELSE 'none' END AS hint, CAST(conv_id % 90 AS STRING) || ' * 1' AS expr,
 CAST(conv_id % 90 AS STRING) AS expected, CAST(turn % 7 AS STRING) AS d1, split_part(text, ' ', 1) AS d2, split_part(text, ' ', 2) AS d3, split_part(text, '.', 2) AS r1, split_part(text, '.', 3) AS r2, split_part(text, '.', 4) AS r3,
 replace(text, '. ', chr(10)) AS steps, role || ' ' || text AS span FROM conversations"""
_FILLED = ", ".join(["item_id", *(f"trim(coalesce({n}, '')) AS {n}" for n in TEXTS)])
SOURCE = f"SELECT {_FILLED} FROM (SELECT {', '.join(NAMES)} FROM ({values(SAMPLES, NAMES)}) UNION ALL {_BULK})"


def candidates(spark, sf_dir: str) -> DataFrame:
    talk = read(spark, sf_dir, "conversations").selectExpr(*(x.strip() for x in _split(_BULK[len("SELECT ") : -len(" FROM conversations")])))
    samples = spark.createDataFrame(SAMPLES, ", ".join(f"{n} {'long' if n == 'item_id' else 'string'}" for n in NAMES))
    return samples.unionByName(talk).select("item_id", *(F.trim(F.coalesce(F.col(n), F.lit(""))).alias(n) for n in TEXTS))


def _split(columns: str) -> list[str]:
    """The parts between commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        out[-1] += "" if c == "," and not depth else c
        if c == "," and not depth:
            out.append("")
    return out


def _word(*words: str) -> str:
    return "(^|[^a-z0-9_])(" + "|".join(words) + ")($|[^a-z0-9_])"


def _in(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_STOP = "@list(" + ", ".join(f"'{w}'" for w in STOP) + ")"
_tokens = lambda folded: f"@keep(regexp_extract_all({folded}, '[a-z0-9]{{3,}}', 0), @t: NOT array_contains({_STOP}, t))"
_label = lambda c: f"upper(trim(TRAILING '.)' FROM {c})) IN ('A', 'B', 'C', 'D')"
_norm = lambda c: f"trim(TRAILING '.;:, ' FROM regexp_replace(replace(replace(lower({c}), '−', '-'), '·', '*'), '{GAP}+', ' '@g))"
_INT = "contains({0}, chr(92) || 'int') OR contains({0}, '∫')"
MATHS = "[=<>^∫Σ]|sqrt[(]|C *[(]|(^|[^a-z0-9_])mod($|[^a-z0-9_])|[0-9]"
_maths = lambda c: f"(@rx({c}, '{MATHS}') OR contains({c}, chr(92) || 'frac') OR contains({c}, chr(92) || 'sqrt'))"
_formula = lambda c: f"(@rx({c}, '∫|[=<>^0-9]') OR contains({c}, chr(92) || 'int'))"

#: Columns that several rules use.
FOLDS = [f"FOLD({c}) AS f_{c}" for c in ("level", "pattern", "stem", "answer", "expl", "quote", "span", "r1", "r2", "r3")]
SHARED = [
    f"{_tokens('f_stem')} AS t_stem",
    f"{_tokens('f_span')} AS t_span",
    f"@uniq({_tokens('f_quote')}) AS t_quote",
    "stem || ' ' || answer || ' ' || expl AS qa",
    "f_stem || ' ' || f_answer || ' ' || f_expl AS f_qa",
    *(f"{_norm(c)} AS n_{c}" for c in ("answer", "d1", "d2", "d3")),
    f"@keep(regexp_extract_all(steps, '[^{chr(10)}]+', 0), @s: length(trim(s)) > 0) AS lines",
    "CASE WHEN contains(f_level, 'van dung cao') THEN 5 WHEN contains(f_level, 'van dung') THEN 4 WHEN contains(f_level, 'thong hieu') THEN 3 WHEN contains(f_level, 'nhan biet') THEN 2 ELSE 3 END AS required",
    "f_pattern IN ('computation', 'application', 'reasoning') OR hint NOT IN ('', 'none') AS needs_work",
    f"f_pattern IN ('computation', 'application') AND (@rx(answer, '[0-9]|frac|sqrt')) AND ({_in('f_stem', 'tinh', 'bang bao nhieu', 'gia tri', 'quang duong', 'dien tich', 'the tich', 'do doi', 'dien luong')} OR @rx(answer, '^ *([(]?-?[0-9]|d?frac)') OR @rx(answer, '^ *' || chr(92) || chr(92) || 'd?frac')) AS needs_number",
]
SETS = [
    f"{_tokens('f_qa')} AS t_qa",
    "@uniq(t_stem) AS u_stem",
    "@uniq(t_span) AS u_span",
    "@uniq(regexp_extract_all(stem, '[0-9]+([.,][0-9]+)?', 0)) AS num_stem",
    "@uniq(regexp_extract_all(span, '[0-9]+([.,][0-9]+)?', 0)) AS num_span",
    f"contains(f_qa, 'tich phan') OR contains(qa, chr(92) || 'int') OR contains(qa, '∫') AS asks_integral",
    f"contains(f_quote, 'tich phan') OR contains(quote, chr(92) || 'int') OR contains(quote, '∫') OR {_in('f_quote', 'hinh phang gioi han', 'duoc tinh boi cong thuc')} AS has_integral",
]
COUNTS = [
    "@size(@both(u_stem, u_span)) AS common",
    "@size(u_stem) AS size_stem",
    "@size(u_span) AS size_span",
    "@size(@both(t_quote, @uniq(t_qa))) AS shared_quote",
    "@join(@each(t_span, @t: CASE WHEN array_contains(u_stem, t) THEN '1' ELSE '0' END), '') AS run",
]
PARAPHRASE = (
    "size_stem >= 6 AND size_span >= 6 AND (common >= 0.48 * (size_stem + size_span - common)"
    " OR common >= 0.7 * size_stem AND @size(num_stem) > 0 AND @size(@both(num_stem, num_span)) = @size(num_stem) OR contains(run, '111111111'))"
)
_EXERCISE = f"@rx(f_quote, '(^|[^a-z0-9_])(cau|bai|question|exercise){GAP}*[0-9]') OR @rx(f_quote, '{_word('chon', 'dap an', 'phuong an', 'trac nghiem', 'hoi', 'bao nhieu', 'khang dinh', 'dung sai')}')"
QUOTE = [
    f"CASE WHEN @rx(lower(quote), '^(topic|chunk type|context type|title){GAP}*:') THEN 'quote_mismatch:source_quote_is_metadata' END",
    f"CASE WHEN lower(source_type) <> 'exercise' AND NOT (@size(t_quote) >= 3 AND @size(t_qa) > 0 AND NOT (asks_integral AND NOT has_integral) AND (shared_quote >= 2 OR shared_quote >= 1 AND {_formula('quote')} AND {_formula('qa')})) THEN 'quote_mismatch:source_quote_not_relevant' END",
    f"CASE WHEN {_EXERCISE} THEN 'duplicate_question:source_quote_is_existing_exercise' END",
]
QUOTE = [f"CASE WHEN quote <> '' THEN {x} END" for x in QUOTE]


def _option(k: int, name: str, column: str) -> list[str]:
    before = ["n_answer", "n_d1", "n_d2", "n_d3"][:k]
    filled = ["answer", "d1", "d2", "d3"][:k]
    again = " OR ".join(f"{b} = n_{column} AND {c} <> ''" for b, c in zip(before, filled, strict=True)) or "FALSE"
    return [
        f"CASE WHEN {column} = '' THEN '{name}:empty' END",
        f"CASE WHEN {column} <> '' AND {_label(column)} THEN '{name}:choice_label' END",
        f"CASE WHEN length({column}) > 240 THEN '{name}:too_long:' || length({column}) END",
        f"CASE WHEN {column} <> '' AND ({again}) THEN '{name}:duplicate_option' END",
    ]


def _rationale(k: int) -> str:
    vague = _word("tinh nham", "cong nham", "tru nham", "sai dau", "nham so", "sai do", "thieu mot phan", "calculation mistake")
    return f"CASE WHEN r{k} = '' THEN 'd{k}:missing_distractor_rationale' WHEN @rx(d{k}, '[0-9]|frac') AND @rx(f_r{k}, '{vague}') AND NOT {_maths(f'r{k}')} THEN 'd{k}:vague_distractor_rationale' END"


ISSUES = [
    f"CASE WHEN stem = '' THEN 'empty_stem' WHEN @rx(regexp_replace(stem, '{GAP}+', ' '@g), '(^|[^A-Za-z0-9_])A[.)] .+[^A-Za-z0-9_]B[.)] .+[^A-Za-z0-9_]C[.)] .+[^A-Za-z0-9_]D[.)] ') THEN 'stem_contains_embedded_options' WHEN length(stem) > 700 THEN 'stem_too_long:' || length(stem) END",
    f"CASE WHEN answer = '' THEN 'empty_answer' WHEN {_label('answer')} THEN 'answer_is_choice_label' END",
    *(x for k, (name, c) in enumerate((("answer", "answer"), ("d1", "d1"), ("d2", "d2"), ("d3", "d3"))) for x in _option(k, name, c)),
    "CASE WHEN expl = '' THEN 'empty_explanation' WHEN length(expl) > 1400 THEN 'explanation_too_long:' || length(expl) END",
    f"CASE WHEN ({_INT.format('stem')} OR contains(f_stem, 'tich phan')) AND @rx(f_stem, '{_word('tinh', 'gia tri cua', 'bang bao nhieu')}') AND NOT {_in('f_stem', 'biet', 'cho ham', 'dien tich', 'hinh phang', 'luu luong', 'dien luong', 'quang duong', 'van toc', 'the tich', 'nguyen ham', 'do thi')} AND @size(t_stem) <= 6 THEN 'question_too_trivial:bare_one_step_integral' END",
    "CASE WHEN quote = '' THEN 'empty_source_quote' WHEN length(quote) > 350 THEN 'source_quote_too_long:' || length(quote) END",
    "CASE WHEN needs_number AND hint IN ('', 'none') THEN 'verifier_missing:numeric_computation' END",
    f"CASE WHEN {PARAPHRASE} THEN 'duplicate_question:source_exercise_paraphrase' END",
    *QUOTE,
    *(_rationale(k) for k in (1, 2, 3)),
    "CASE WHEN @size(lines) < required THEN 'explanation_low_quality:solution_steps<' || required || ':' || @size(lines) END",
    f"CASE WHEN @rx(FOLD(steps), '^{GAP}*[^{chr(10)}]*(ket luan|conclusion)') THEN 'explanation_low_quality:first_step_is_conclusion' END",
    f"CASE WHEN needs_work AND @size(lines) > 0 AND NOT {_maths('steps')} THEN 'explanation_low_quality:no_formula_or_calculation_step' END",
]
_issues = lambda parts: f"concat_ws(',', {', '.join(parts)}) AS issues"
RULES = [FOLDS, SHARED, SETS, COUNTS, [_issues(ISSUES)]]
_RULES_SQL = steps_sql(SOURCE, RULES)


@query(f"SELECT item_id, issues FROM ({_RULES_SQL})")
def candidate_rules(spark, sf_dir):
    """Every rule that a candidate breaks, in a fixed order."""
    return with_steps(candidates(spark, sf_dir), RULES).select("item_id", "issues")


_QUOTES = [FOLDS, SHARED, SETS, COUNTS, [_issues(QUOTE), "shared_quote AS n"]]


@query(f"SELECT item_id, issues, n::BIGINT AS shared FROM ({steps_sql(SOURCE, _QUOTES)})")
def quote_rules(spark, sf_dir):
    """Whether a source quote is metadata, tells nothing of the question, or is an exercise itself."""
    return with_steps(candidates(spark, sf_dir), _QUOTES).select("item_id", "issues", F.col("n").cast("long").alias("shared"))


# Parts of issue names in the order in which they decide, and the codes that they give.
CODES = [
    (["source_exercise_paraphrase", "duplicate_question"], "duplicate_question"),
    (["explanation_low_quality", "detailed_solution"], "explanation_low_quality"),
    (["question_too_trivial"], "quality_low"),
    (["verifier_missing"], "verifier_failed"),
    (["distractor_rationale"], "bad_distractors"),
    (["duplicate"], "duplicate"),
    (["distractor_count", "options_count"], "bad_distractors"),
]
CODE = "CASE WHEN issues = '' THEN '' " + " ".join(f"WHEN {_in('issues', *parts)} THEN '{code}'" for parts, code in CODES) + " ELSE 'format_error' END AS code"


@query(f"SELECT code, count(*) AS n FROM ({steps_sql(_RULES_SQL, [[CODE]])}) GROUP BY code")
def issue_codes(spark, sf_dir):
    """How many candidates each reject code takes."""
    return with_steps(candidates(spark, sf_dir), [*RULES, [CODE]]).groupBy("code").agg(F.count("*").alias("n"))


_KEYS = ["chr(CAST(65 + (item_id + {0}) % (4 + CASE item_id % 11 WHEN 0 THEN 1 ELSE 0 END) AS INT)) AS k{0}".format(k) for k in range(4)]
_KEYS.append("CASE item_id % 13 WHEN 0 THEN 'E' WHEN 1 THEN '' ELSE chr(CAST(65 + item_id % 4 AS INT)) END AS answer_key")
# Names of what is wrong with a record, in order.
RECORD = [
    "CASE WHEN NOT (array_contains(@list(k0, k1, k2, k3), 'A') AND array_contains(@list(k0, k1, k2, k3), 'B') AND array_contains(@list(k0, k1, k2, k3), 'C') AND array_contains(@list(k0, k1, k2, k3), 'D')) THEN 'option_keys_invalid' END",
    "CASE WHEN answer_key NOT IN ('A', 'B', 'C', 'D') THEN 'answer_key_invalid' END",
    "CASE WHEN NOT array_contains(@list(k0, k1, k2, k3), answer_key) THEN 'answer_key_missing' END",
    "CASE WHEN stem = '' THEN 'empty_stem' END",
]
for _k, _c in enumerate(("answer", "d1", "d2", "d3")):
    _before = " OR ".join(f"n_{b} = n_{_c} AND {b} <> ''" for b in ("answer", "d1", "d2", "d3")[:_k]) or "FALSE"
    RECORD += [f"CASE WHEN {_c} = '' THEN 'option_' || k{_k} || '_empty' END", f"CASE WHEN {_c} <> '' AND {_label(_c)} THEN 'option_' || k{_k} || '_choice_label' END", f"CASE WHEN {_c} <> '' AND ({_before}) THEN 'option_' || k{_k} || '_duplicate_text' END"]
_RECORD = [[f"{_norm(c)} AS n_{c}" for c in ("answer", "d1", "d2", "d3")] + _KEYS, [_issues(RECORD)]]


@query(f"SELECT item_id, answer_key, issues FROM ({steps_sql(SOURCE, _RECORD)})")
def record_rules(spark, sf_dir):
    """What is wrong with a finished record: keys, answer key, stem, empty, labelled or repeated options."""
    return with_steps(candidates(spark, sf_dir), _RECORD).select("item_id", "answer_key", "issues")


_SIGNALS = [FOLDS, SHARED, SETS, [f"{_maths('stem')} AS maths", f"{_formula('qa')} AS formula"]]


@query(f"SELECT item_id, maths, formula, asks_integral, needs_work, needs_number, required::BIGINT AS required FROM ({steps_sql(SOURCE, _SIGNALS)})")
def maths_signals(spark, sf_dir):
    """Which candidates show mathematics, ask for an integral, need work or a number, and how many steps their level takes."""
    return with_steps(candidates(spark, sf_dir), _SIGNALS).select("item_id", "maths", "formula", "asks_integral", "needs_work", "needs_number", F.col("required").cast("long").alias("required"))


_NUMBERS = [
    ["@uniq(regexp_extract_all(stem, '[0-9]+([.,][0-9]+)?', 0)) AS asked", "regexp_extract_all(span || ' ' || quote, '[0-9]+([.,][0-9]+)?', 0) AS told"],
    ["@sort(@keep(asked, @n: NOT array_contains(told, n) AND n NOT IN ('0', '1', '2'))) AS missing"],
]


@query(f"SELECT item_id, array_to_string(missing, ',') AS unsupported FROM ({steps_sql(SOURCE, _NUMBERS)})")
def stem_numbers(spark, sf_dir):
    """Numbers of a stem, but 0, 1 and 2, that its source doesn't have."""
    return with_steps(candidates(spark, sf_dir), _NUMBERS).select("item_id", F.array_join("missing", ",").alias("unsupported"))


# -- signatures -------------------------------------------------------------------------------------------------------

_NONNEG = "contains(c_text, 'khongam') OR @rx(c_raw, '[fg][(]x[)](>=|≥)0|0(<=|≤)[fg][(]x[)]') OR contains(c_raw, 'x)' || chr(92) || 'ge0')"
_START = "@rx(raw, '[fsvFSV] *[(] *0 *[)]')"
#: An integral from a letter to the same letter; powers are written with ~.
# The letters are listed, as one of the engines has no back references.
_ZERO = "∫ *_ *(" + "|".join(f"[{{]? *{x} *[}}]? *~ *[{{]? *{x}" for x in string.ascii_letters) + ")"
# The cores' names and words, in the order in which they decide.
CORE = f"""CASE WHEN integral AND ({_NONNEG}) AND ({_in('text', 'khong am', 'khong duong', 'khong nho hon 0', '>= 0', 'ge 0', '≥ 0')} OR {_in('c_text', '>=0', '≥0', '0<=', '0≤')}) THEN 'integral_positivity_property'
 WHEN integral AND @rx(replace(raw, '^', '~'), '{_ZERO}') THEN 'integral_zero_interval_property'
 WHEN contains(text, 'dien tich') AND {_in('text', 'do thi', 'hinh phang')} THEN 'area_between_graphs'
 WHEN contains(text, 'nguyen ham') AND {_START} OR {_START} AND {_in('text', 'cos', 'sin')} THEN 'antiderivative_initial_condition' || CASE WHEN contains(text, 'cos') THEN ':cos' WHEN contains(text, 'sin') THEN ':sin' ELSE '' END
 WHEN contains(text, 'nguyen ham') AND {_in('text', 'nghich bien', 'dong bien', 'cuc dai', 'cuc tieu')} THEN 'antiderivative_monotonicity'
 WHEN {_in('text', 'luu luong', 'be nuoc')} THEN 'accumulation:flow' WHEN {_in('text', 'dien luong', 'dong dien')} THEN 'accumulation:current' WHEN {_in('text', 'quang duong', 'van toc')} THEN 'accumulation:motion'
 WHEN length(raw) - length(replace(raw, '∫', '')) + (length(raw) - length(replace(raw, chr(92) || 'int', ''))) / 4 >= 2 AND {_in('text', 'biet', 'cho')} THEN 'integral_additivity_or_linearity'
 WHEN integral AND @rx(text, '^ *(tinh|gia tri cua) *([a-z] *= *)?∫') THEN 'bare_definite_integral' ELSE '' END AS core"""
_EXPECTED = "TRY_CAST(replace(trim(expected), ',', '.') AS DOUBLE)"
SIGNATURES = [
    FOLDS,
    [f"replace(f_stem || ' ' || f_answer || ' ' || f_expl, '{chr(10)}', ' ') AS text", "stem || ' ' || answer AS raw", f"{_EXPECTED} AS number"],
    [f"regexp_replace(text, '{GAP}+', ''@g) AS c_text", f"lower(regexp_replace(raw, '{GAP}+', ''@g)) AS c_raw", f"{_INT.format('raw')} OR contains(text, 'tich phan') AS integral"],
    [CORE, f"CASE WHEN hint = 'numeric_eval' AND expr <> '' THEN 'numeric_eval:expr:' || regexp_replace(replace(FOLD(expr), '**', '^'), '{GAP}+', ''@g) ELSE '' END AS expression",
     "CASE WHEN hint NOT IN ('numeric_eval', 'probability', 'counting', 'limit', 'modular') OR number IS NULL THEN '' WHEN abs(number - round(number)) < 1e-10 THEN hint || ':expected:' || CAST(CAST(round(number) AS BIGINT) AS STRING) ELSE hint || ':expected:' || CAST(number AS STRING) END AS value"],
    [f"""CASE WHEN core LIKE 'accumulation:%' THEN 'accumulation' WHEN core LIKE 'antiderivative_initial_condition%' THEN 'antiderivative_initial_condition' WHEN core <> '' THEN split_part(core, ':', 1)
 WHEN {_in('f_quote', 'luu luong', 'be nuoc', 'quang duong', 'van toc', 'dien luong', 'dong dien')} THEN 'accumulation' WHEN contains(f_quote, 'dien tich') AND {_in('f_quote', 'do thi', 'hinh phang')} THEN 'area_between_graphs'
 WHEN contains(f_quote, 'nguyen ham') THEN 'antiderivative_initial_condition' ELSE '' END AS family"""],
]
_SIGNED = steps_sql(SOURCE, SIGNATURES)


@query(f"SELECT item_id, core, expression, value, family FROM ({_SIGNED})")
def question_signatures(spark, sf_dir):
    """What a question is about, by ordered rules; its verifier's expression and expected value in normal form; their family."""
    return with_steps(candidates(spark, sf_dir), SIGNATURES).select("item_id", "core", "expression", "value", "family")


_REPEATS = f"""WITH s AS ({_SIGNED}),
e AS (SELECT expression, min(item_id) AS first FROM s WHERE expression <> '' GROUP BY 1), v AS (SELECT value, family, min(item_id) AS first FROM s WHERE value <> '' AND family <> '' GROUP BY 1, 2),
c AS (SELECT core, min(item_id) AS first, min(CASE WHEN expression = '' AND value = '' THEN item_id END) AS plain FROM s WHERE core <> '' GROUP BY 1)
SELECT item_id, CASE WHEN e.first < item_id THEN 'expression' WHEN v.first < item_id THEN 'value' WHEN CASE WHEN s.expression = '' AND s.value = '' THEN c.first ELSE c.plain END < item_id THEN 'core' ELSE '' END AS repeats
FROM s LEFT JOIN e USING (expression) LEFT JOIN v USING (value, family) LEFT JOIN c USING (core)"""


@query(_REPEATS)
def repeated_signatures(spark, sf_dir):
    """Whether an earlier item has the same expression, the same value and family, or the same core unless both have a numeric verifier.

    Only the first item of a signature is looked up, so large groups make no pairs.
    """
    # signatures are made once, before they are grouped three times
    rows = cut(with_steps(candidates(spark, sf_dir), SIGNATURES).select("item_id", "core", "expression", "value", "family"))
    plain = F.expr("expression = '' and value = ''")
    e = rows.filter("expression <> ''").groupBy("expression").agg(F.min("item_id").alias("e"))
    v = rows.filter("value <> '' and family <> ''").groupBy("value", "family").agg(F.min("item_id").alias("v"))
    c = rows.filter("core <> ''").groupBy("core").agg(F.min("item_id").alias("c"), F.min(F.when(plain, F.col("item_id"))).alias("p"))
    rows = rows.join(e, "expression", "left").join(v, ["value", "family"], "left").join(c, "core", "left")
    core = F.when(plain, F.col("c")).otherwise(F.col("p"))
    return rows.select("item_id", F.when(F.col("e") < F.col("item_id"), "expression").when(F.col("v") < F.col("item_id"), "value").when(core < F.col("item_id"), "core").otherwise("").alias("repeats"))


@query(f"SELECT item_id, stem, answer, quote, core, expression, value, family FROM ({_SIGNED}) WHERE answer <> ''")
def accepted_references(spark, sf_dir):
    """What is kept of an accepted question for later comparisons: three texts and four signatures."""
    return with_steps(candidates(spark, sf_dir), SIGNATURES).filter("answer <> ''").select("item_id", "stem", "answer", "quote", "core", "expression", "value", "family")

