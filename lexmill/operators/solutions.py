"""Worked solutions after the options were shuffled: letters follow the key, the conclusion names the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexmill.functions import text as T
from lexmill.plans.registry import query, read

GAP = "[ \t\n\r\x0b\x0c]"
_END = "([^A-Za-z0-9_]|$)"
# Words for an answer or option, for right, and for a step that concludes, with and without accents.
_OPTION = f"(?:[đĐ][áÁ]p{GAP}+[áÁ]n|[pP]hương{GAP}+[áÁ]n|[dD]ap{GAP}+[aA]n|[pP]huong{GAP}+[aA]n)"
_RIGHT = "(?:[đĐ]úng|[dD]ung)"
CONCLUSION, LAST = "ket luan", "(^|[^a-z0-9_])(chon|dap an|phuong an|answer)($|[^a-z0-9_])"
#: Patterns and what they become; @1 and @2 are groups, @K is the key.
LETTERS = [
    (f"[*]{{2}}{GAP}*([A-Da-d]){GAP}*[*]{{2}}", "@1"),
    (f"({_OPTION}{GAP}+(?:{_RIGHT}{GAP}+(?:(?:là|la){GAP}+)?)?)(?:[\\\\][(][A-Da-d][\\\\][)]|[A-Da-d]){_END}", "@1@K@2"),
    ("([\\\\]text[{])[A-D]([}])", "@1@K@2"),
    (f"(^|[^A-Za-z0-9_])[A-Da-d]({GAP}+{_RIGHT}){_END}", "@1@K@2@3"),
    (f"([đĐ]úng){GAP}+[đĐ]úng{_END}", "@1@2"),
    (f"([dD]ung){GAP}+[dD]ung{_END}", "@1@2"),
]


def letters_follow(text: Column, key: Column) -> Column:
    """A text in which each letter that is said to be the answer is key (one of A to D); unchanged where there is no key."""
    out = text
    for pattern, to in LETTERS:
        parts = [key if p == "K" else F.lit(f"${p}") for p in to.split("@")[1:]]
        out = F.regexp_replace(out, pattern, F.concat(*parts))
    return F.when(F.coalesce(key, F.lit("")) == "", text).otherwise(out)


def _letters_sql(text: str, key: str) -> str:
    out = text
    for pattern, to in LETTERS:
        parts = " || ".join(key if p == "K" else f"'\\{p}'" for p in to.split("@")[1:])
        out = f"regexp_replace({out}, '{pattern}', {parts}, 'g')"
    return out


def aligned(rows: DataFrame) -> DataFrame:
    """rows (item_id, answer_key, answer, steps of title and content) with their steps aligned, and final_answer.

    A step concludes if it says so, or if it is the last one and names an option; its content is then the choice. Other
    steps keep their words. Null titles and contents count as empty, and no steps give none.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    answer = F.regexp_replace(text(F.col("answer")), "[ .]+$", "")
    chosen = F.concat(F.lit("Chọn đáp án "), "answer_key", F.when(answer != "", F.concat(F.lit(": "), answer)).otherwise(""), F.lit("."))

    def step(s: Column, i: Column) -> Column:
        folded = T.fold(F.concat(text(s.title), F.lit(" "), text(s.content)))
        ends = F.contains(folded, F.lit(CONCLUSION)) | ((i == F.size("steps") - 1) & folded.rlike(LAST))
        content = F.when(ends & (text(F.col("answer_key")) != ""), chosen).otherwise(letters_follow(text(s.content), F.col("answer_key")))
        return F.struct(text(s.title).alias("title"), content.alias("content"))

    return rows.select("item_id", F.transform("steps", step).alias("steps"), answer.alias("final_answer"))


_ROWS = """SELECT o_orderkey AS item_id, CASE WHEN o_custkey % 9 > 0 THEN chr(CAST(65 + o_custkey % 4 AS INT)) ELSE '' END AS answer_key, CASE WHEN o_custkey % 5 > 0 THEN o_custkey || ' m.' ELSE '' END AS answer, chr(CAST(65 + o_orderkey % 4 AS INT)) AS old, o_orderkey % 6 AS form, o_custkey AS n FROM orders"""
_FIRST = "CASE form WHEN 0 THEN 'Đối chiếu công thức với phương án ' || chr(92) || '(' || old || chr(92) || '). Phương án ' || old || ' là cách viết cũ.' WHEN 1 THEN 'Ta có S = ' || n || ' nên ' || old || ' đúng đúng vì khớp.' WHEN 2 THEN 'Đáp án đúng là ' || old || '; không phải Bài ' || n WHEN 3 THEN 'Chon dap an **' || old || '** hay ' || chr(92) || 'text{' || old || '}' WHEN 4 THEN 'phuong an dung ' || old || ', A dung. ABC đúng' ELSE 'Không có chữ cái nào ở đây, S = ' || n END"
_LAST = "CASE form WHEN 0 THEN 'Vì vậy phương án đúng là ' || old || '.' WHEN 3 THEN 'Answer ' || old WHEN 5 THEN 'Xong' ELSE 'Vậy chọn ' || old END"
_TITLE = "CASE form WHEN 5 THEN 'Kết luận' ELSE 'Bước 2' END"
_FOLD = "strip_accents(translate(lower({}), 'đ', 'd'))"
_ENDS = f"contains({_FOLD.format('title || chr(32) || content')}, '{CONCLUSION}') OR is_last AND regexp_matches({_FOLD.format('title || chr(32) || content')}, '{LAST}')"


@query(
    f"""WITH r AS ({_ROWS}), s AS (SELECT *, 1 AS at_, 'Bước 1' AS title, {_FIRST} AS content, false AS is_last FROM r UNION ALL SELECT *, 2, {_TITLE}, {_LAST}, true FROM r),
c AS (SELECT item_id, at_, rtrim(answer, ' .') AS final_answer, CASE WHEN answer_key <> '' AND ({_ENDS}) THEN 'Chọn đáp án ' || answer_key || CASE WHEN rtrim(answer, ' .') <> '' THEN ': ' || rtrim(answer, ' .') ELSE '' END || '.' WHEN answer_key = '' THEN content ELSE {_letters_sql('content', 'answer_key')} END AS content FROM s)
SELECT item_id, string_agg(content, ' | ' ORDER BY at_) AS solution, any_value(final_answer) AS final_answer FROM c GROUP BY item_id"""
)
def aligned_solutions(spark, sf_dir):
    """Solutions of two steps whose letters are those of before the shuffle, after it."""
    columns = _ROWS.removeprefix("SELECT ").removesuffix(" FROM orders")
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS item_id", "CASE" + columns.split(", CASE")[1], "CASE" + columns.split(", CASE")[2].split(", chr(CAST(65 + o_orderkey")[0], "chr(CAST(65 + o_orderkey % 4 AS INT)) AS old", "o_orderkey % 6 AS form", "o_custkey AS n")
    steps = F.array(F.struct(F.lit("Bước 1").alias("title"), F.expr(_FIRST).alias("content")), F.struct(F.expr(_TITLE).alias("title"), F.expr(_LAST).alias("content")))
    got = aligned(rows.withColumn("steps", steps))
    return got.select("item_id", F.array_join(F.transform("steps", lambda s: s.content), " | ").alias("solution"), "final_answer")
