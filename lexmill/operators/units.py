"""Text-unit producers: line and page cleaning, splitting, chunking, key lines, summaries, quality tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as S, Window as W

from lexmill.functions import quality as Q, text as T
from lexmill.functions.folds import SPACE, fold_texts
from lexmill.plans.registry import query, read

from .cleaning import FORMULA

MIN_RATIO = 0.05
_WS = r"[ \t\n\x0b\f\r]"
_SQL_STRIP = r"regexp_replace({}, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')"


def repeated(docs: DataFrame, ratio: float = MIN_RATIO, key: str = "source") -> DataFrame:
    """Lines of 4 to 119 characters that stand in a group of at least three pages as often as ratio of its pages, and twice."""
    counts = docs.select(key, F.explode(T.lines(F.col("text"))).alias("line")).select(key, T.strip(F.col("line")).alias("line"))
    counts = counts.filter(F.char_length("line").between(4, 119)).groupBy(key, "line").agg(F.count("*").alias("n"))
    pages = docs.groupBy(key).agg(F.count("*").alias("pages")).filter("pages >= 3")
    return counts.join(pages, key).filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(ratio)))).select(key, "line", "n")


_REPEATED_SQL = rf"""
WITH l AS (SELECT source, {_SQL_STRIP.format("unnest(string_split(text, chr(10)))")} AS line FROM documents),
c AS (SELECT source, line, count(*) AS n FROM l WHERE length(line) BETWEEN 4 AND 119 GROUP BY ALL),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source HAVING count(*) >= 3),
r AS (SELECT c.* FROM c JOIN p USING (source) WHERE n >= greatest(2, floor(pages * {MIN_RATIO})))
"""


@query(_REPEATED_SQL + "SELECT source, line, n FROM r")
def repeated_lines(spark, sf_dir):
    return repeated(read(spark, sf_dir, "documents"))


# Fixed value: the share of a group's pages from which a line is a header or footer.
RATIO = 0.4


@query(_REPEATED_SQL.replace(str(MIN_RATIO), str(RATIO)) + "SELECT source, line, n FROM r")
def repeated_headers(spark, sf_dir):
    """Lines that stand on two fifths of a group's pages."""
    return repeated(read(spark, sf_dir, "documents"), RATIO)


#: Repeated lines (119 characters each at most) that are sent to all tasks; more of them are joined with the lines.
FEW_LINES = 10_000


def clean_pages_of(docs: DataFrame, ratio: float = MIN_RATIO, few: int = FEW_LINES) -> DataFrame:
    """Texts without page numbers and repeated lines, with blank runs collapsed; lines keep their order.

    Repeated lines that are few go to the texts, which then are cleaned in place; else lines go to their repeats.
    """
    text = F.regexp_replace(F.regexp_replace("text", "\f", "\n"), "ƣ", "ư")
    again = repeated(docs, ratio).select("source", "line")
    held = again.limit(few + 1).collect()
    if len(held) <= few:
        by_source: dict[str, list[str]] = {}
        for r in held:
            by_source.setdefault(r.source, []).append(r.line)
        known = docs.sparkSession.createDataFrame(list(by_source.items()), "source string, again array<string>")
        own = docs.select("doc_id", "source", F.transform(T.lines(text), lambda x: F.struct(x.alias("line"), T.strip(x).alias("bare"))).alias("lines")).join(F.broadcast(known), "source", "left")
        fine = F.filter("lines", lambda x: ~x.bare.rlike("^[0-9]+$") & ~F.coalesce(F.array_contains("again", x.bare), F.lit(False)))
        whole = own.select("doc_id", F.array_join(F.transform(fine, lambda x: F.when(x.bare == "", "").otherwise(x.line)), "\n").alias("text"))
    else:
        rows = docs.select("doc_id", "source", F.posexplode(T.lines(text)).alias("pos", "line")).withColumn("bare", T.strip(F.col("line")))
        rows = rows.filter(~F.col("bare").rlike("^[0-9]+$"))
        kept = rows.join(again.withColumnRenamed("line", "bare"), ["source", "bare"], "left_anti")
        joined = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.when(F.col("bare") == "", "").otherwise(F.col("line")).alias("line")))), lambda x: x.line), "\n").alias("text"))
        whole = docs.select("doc_id").join(joined, "doc_id", "left")
    clean = T.strip(F.regexp_replace(F.regexp_replace("text", "\n{3,}", "\n\n"), "[ \t]{2,}", " "))
    return whole.select("doc_id", F.coalesce(clean, F.lit("")).alias("text"))


@query(
    _REPEATED_SQL
    + rf""", b AS (SELECT doc_id, source, string_split(replace(replace(text, chr(12), chr(10)), 'ƣ', 'ư'), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, source, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM b),
f AS (SELECT *, {_SQL_STRIP.format("line")} AS bare FROM e),
k AS (SELECT * FROM f WHERE NOT regexp_full_match(bare, '[0-9]+') AND NOT EXISTS (SELECT 1 FROM r WHERE r.source = f.source AND r.line = f.bare)),
g AS (SELECT doc_id, string_agg(CASE WHEN bare = '' THEN '' ELSE line END, chr(10) ORDER BY pos) AS text FROM k GROUP BY doc_id),
h AS (SELECT doc_id, {_SQL_STRIP.format("regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g')")} AS text FROM g)
SELECT d.doc_id, length(coalesce(h.text, ''))::BIGINT AS n_chars, md5(coalesce(h.text, '')) AS digest FROM documents d LEFT JOIN h USING (doc_id)
"""
)
def clean_pages(spark, sf_dir):
    return clean_pages_of(read(spark, sf_dir, "documents")).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    rf"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, trim(regexp_replace(t, '{_WS}+', ' ', 'g')) AS t FROM a)
SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM b
"""
)
def page_text(spark, sf_dir):
    """Markup stripping by ordered patterns."""
    text = F.col("html")
    for pattern in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?is)<nav[^>]*>.*?</nav>", "<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    return read(spark, sf_dir, "pages").select("page_id", T.squeeze(text).alias("t")).select("page_id", F.char_length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


def sentences(c: Column) -> Column:
    """Pieces that end in . ! or ? before white space, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])[ \t\n\x0b\f\r]+"), T.strip), lambda s: s != "")


_SENTENCES_SQL = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_SQL_STRIP.format('s')}), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENTENCES_SQL})::BIGINT AS n_sentences, coalesce(list_max(list_transform({_SENTENCES_SQL}, lambda s: length(s))), 0)::BIGINT AS longest FROM documents")
def sentence_units(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.char_length)), F.lit(0)).cast("long").alias("longest"))


@query(
    rf"""
WITH s AS (SELECT doc_id, {_SENTENCES_SQL} AS s FROM documents), e AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS s FROM s),
k AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM e)
SELECT doc_id, count(*) AS n, substr(string_agg(s, ' ' ORDER BY pos), 1, 700) AS summary FROM k WHERE upto - length(s) < 700 GROUP BY doc_id
"""
)
def summaries(spark, sf_dir):
    """Leading sentences until 700 characters are reached, cut there."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "s"))
    upto = F.sum(F.char_length("s")).over(W.partitionBy("doc_id").orderBy("pos"))
    rows = rows.withColumn("upto", upto).filter(F.col("upto") - F.char_length("s") < 700)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda x: x.s)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.substring(F.array_join(ordered, " "), 1, 700).alias("summary"))


@query(
    rf"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {_SQL_STRIP.format("s")}), lambda s: length(s) BETWEEN 12 AND 420) AS ls FROM documents),
k AS (SELECT doc_id, ls, list_filter(ls, lambda s: regexp_matches(s, '[0-9=:]')) AS ks FROM l)
SELECT doc_id, len(ks) > 0 AS has_key, array_to_string(list_slice(CASE WHEN len(ks) > 0 THEN ks ELSE ls END, 1, 8), chr(10)) AS lines FROM k
"""
)
def key_lines(spark, sf_dir):
    """The first eight lines with a number, an equation or a colon; without any, the first eight lines."""
    own = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda s: F.char_length(s).between(12, 420)).alias("ls"))
    own = own.withColumn("ks", F.filter("ls", lambda s: s.rlike("[0-9=:]")))
    chosen = F.when(F.size("ks") > 0, F.col("ks")).otherwise(F.col("ls"))
    return own.select("doc_id", (F.size("ks") > 0).alias("has_key"), F.array_join(F.slice(chosen, 1, 8), "\n").alias("lines"))


def without_noise(c: Column) -> Column:
    """Lines but page numbers, headings of contents and references, and lines mostly of dots."""

    def fine(line: Column) -> Column:
        return ~line.rlike(r"(?i)^[ \t\x0b\f\r]*(?:[0-9]+|contents|references|bibliography)[ \t\x0b\f\r]*$") & ~(Q.chars(line, ".") * 4 > F.greatest(F.lit(32), F.char_length(line)))

    return F.array_join(F.filter(T.lines(c), fine), "\n")


_CLEAN_SQL = rf"""SELECT doc_id, lang, source, array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_full_match({_SQL_STRIP.format("s")}, '[0-9]+')
 AND lower({_SQL_STRIP.format("s")}) NOT IN ('contents', 'references', 'bibliography')
 AND NOT (length(s) - length(replace(s, '.', ''))) * 4 > greatest(32, length(s))), chr(10)) AS t FROM documents"""


def _count_sql(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_NOISE_SQL = f"""CASE WHEN length(t) < 80 THEN 'high' WHEN {_count_sql(r"[#$%&*|~{}\[\]\\]")} * 100 > greatest(length(t), 1) * 8 THEN 'high'
 WHEN {_count_sql(r"[#$%&*|~{}\[\]\\]")} * 100 > greatest(length(t), 1) * 2 THEN 'medium' ELSE 'low' END"""
_TYPE_SQL = f"""CASE WHEN {_count_sql(chr(92) + "n[A-D][.)] ")} >= 3 OR {_count_sql(chr(92) + "?")} >= 2 THEN 'exercise'
 WHEN regexp_matches(lower(t), 'for example|zum beispiel|par exemple|por ejemplo') THEN 'example' ELSE 'theory' END"""
_LOW_SQL = f"""CASE WHEN length(t) < 80 THEN 'short' WHEN regexp_matches(t, '{Q.MATHS}') THEN NULL WHEN {_count_sql(chr(92) + ".")} * 5 > length(t) THEN 'dots'
 WHEN {_count_sql("[A-Za-zÀ-ÿ]{2,}")} < 18 THEN 'few_words' WHEN {_count_sql(Q.CODE.replace("(", chr(92) + "(").replace(chr(92) * 2, chr(92)))} >= 8 THEN 'code'
 WHEN {_count_sql("[+<=>|~^`$]")} * 100 > length(t) * 18 THEN 'symbols' WHEN {_count_sql(r"[{};=<>+/*\[\]]")} * 5 > {_count_sql("[A-Za-zÀ-ÿ]")} * 4 THEN 'code' END"""
_DENSITY_SQL = f"least(1000, floor(1000 * {_count_sql(Q.MATHS)} / greatest(20, floor(length(t) / 35))))::BIGINT"


def measured(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "lang", "source", without_noise(F.col("text")).alias("t"))
    t = F.col("t")
    return own.select("doc_id", "lang", "source", t, Q.chunk_type(t).alias("chunk_type"), Q.noise(t).alias("noise_level"), Q.density(t).alias("density"), Q.low_quality(t).alias("low"))


@query(f"WITH d AS ({_CLEAN_SQL}) SELECT lang, {_TYPE_SQL} AS chunk_type, {_NOISE_SQL} AS noise_level, count(*) AS n, sum(length(t))::BIGINT AS chars, count({_LOW_SQL}) AS low FROM d GROUP BY ALL")
def chunk_quality(spark, sf_dir):
    """Units by language, type and noise."""
    rows = measured(read(spark, sf_dir, "documents"))
    return rows.groupBy("lang", "chunk_type", "noise_level").agg(F.count("*").alias("n"), F.sum(F.char_length("t")).cast("long").alias("chars"), F.count("low").alias("low"))


@query(f"WITH d AS ({_CLEAN_SQL}) SELECT doc_id, {_TYPE_SQL} AS chunk_type, {_NOISE_SQL} AS noise_level, {_DENSITY_SQL} AS density, {_LOW_SQL} AS low FROM d")
def unit_measures(spark, sf_dir):
    return measured(read(spark, sf_dir, "documents")).drop("t", "lang", "source")


@query(
    f"WITH d AS ({_CLEAN_SQL}), m AS (SELECT doc_id, {_NOISE_SQL} AS noise_level FROM d) SELECT noise_level, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad FROM m JOIN labels USING (doc_id) GROUP BY noise_level"
)
def quality_vs_label(spark, sf_dir):
    rows = measured(read(spark, sf_dir, "documents")).select("doc_id", "noise_level").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("noise_level").agg(F.count("*").alias("n"), F.count_if(F.expr("quality = 1")).alias("good"), F.count_if(F.expr("quality = 0")).alias("bad"))


@query("SELECT doc_id, text, n_chars FROM documents WHERE length(trim(text)) >= 120 AND (contains(lower(text), 'license') OR (SELECT count(*) FROM documents WHERE contains(lower(text), 'license')) = 0)")
def section_filter(spark, sf_dir):
    """Units of 120 characters that hold the wanted section's word; the filter is off if none does."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    hit = F.contains(F.lower("text"), F.lit("license"))
    some = docs.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("some"))
    return docs.filter(F.char_length(F.trim("text")) >= 120).crossJoin(F.broadcast(some)).filter(hit | ~F.col("some")).drop("some")


# Characters at which a chunk is full, under which it joins the one before, and that it has at most; what a heading is.
FULL, LEAST, MOST, HEADING_CHARS = 1000, 200, 1800, 140
_HEADING = "^(#{1,4} |[0-9]+([.][0-9]+)*[.]? [A-ZÀ-Ý])"


def packed_chunks(text: str, target: int = FULL, least: int = LEAST, most: int = MOST) -> list[tuple[int, str, str]]:
    """Numbered chunks of a text's lines: a new one at a heading, before most, at target; one under least joins the one before.

    Each has the last heading up to its first line, or an empty text.
    """
    rule, chunks = re.compile(_HEADING), []
    held, size, heading, at_start = [], 0, "", ""

    def flush() -> None:
        body = "\n\n".join(held)
        if held and chunks and len(body) < least:
            chunks[-1][0].append(body)
        elif held:
            chunks.append(([body], at_start))

    for line in filter(None, (p.strip(SPACE) for p in text.split("\n"))):
        heads = len(line) <= HEADING_CHARS and rule.search(line)
        if held and (heads or size + len(line) > most):
            flush()
            held, size = [], 0
        heading = line if heads else heading
        at_start = at_start if held else heading
        held.append(line)
        size += len(line)
        if size >= target:
            flush()
            held, size = [], 0
    flush()
    return [(k, "\n\n".join(parts), head) for k, (parts, head) in enumerate(chunks)]


def chunks_of(docs: DataFrame, target: int = FULL, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, chunk_no, context, heading) of whole texts, linear in their length."""
    return fold_texts(docs, "doc_id", "text", lambda t: packed_chunks(t, target, least, most), {"chunk_no": "bigint", "context": "string", "heading": "string"})


_LINE = r"regexp_replace({}, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g')"
_LINES_SQL = rf"""l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l1 AS (SELECT doc_id, unnest(range(len(ls))) AS k, {_LINE.format('unnest(ls)')} AS line FROM l0),
l AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos, line FROM l1 WHERE line <> '')"""


@query(
    rf"""WITH RECURSIVE {_LINES_SQL}, h AS MATERIALIZED (SELECT *, length(line) AS n, length(line) <= {HEADING_CHARS} AND regexp_matches(line, '{_HEADING}') AS head FROM l),
r(doc_id, pos, part, size, heading, at_start) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', '' FROM (SELECT DISTINCT doc_id FROM h)
 UNION ALL SELECT doc_id, pos, part + fresh::INT, CASE WHEN fresh THEN n ELSE size + n END, CASE WHEN head THEN line ELSE heading END, CASE WHEN fresh THEN CASE WHEN head THEN line ELSE heading END ELSE at_start END
 FROM (SELECT r.doc_id, h.pos, r.part, r.size, r.heading, r.at_start, h.line, h.n, h.head, r.size = 0 OR r.size >= {FULL} OR h.head OR r.size + h.n > {MOST} AS fresh FROM r JOIN h ON h.doc_id = r.doc_id AND h.pos = r.pos + 1)),
p AS (SELECT doc_id, part, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS body, min(at_start) AS heading FROM r JOIN h USING (doc_id, pos) GROUP BY ALL),
m AS (SELECT *, sum(CASE WHEN length(body) >= {LEAST} OR part = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY part) - 1 AS chunk_no FROM p),
c AS (SELECT doc_id, chunk_no, string_agg(body, chr(10) || chr(10) ORDER BY part) AS context, min_by(heading, part) AS heading FROM m GROUP BY ALL)
SELECT doc_id, chunk_no::BIGINT AS chunk_no, length(context)::BIGINT AS n_chars, md5(context) AS digest, heading FROM c"""
)
def chunk_text(spark, sf_dir):
    """Whole texts as chunks of about a thousand characters, with the heading that each stands under."""
    chunks = chunks_of(read(spark, sf_dir, "documents").filter(F.col("text").isNotNull()))
    return chunks.select("doc_id", "chunk_no", F.char_length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest"), "heading")


# A line that is short and has no end, a formula that goes on, and a line that begins with an operator join.
SHORT_LINE, SHORT_FORMULA, _END, _OPERATOR = 120, 100, "[.!?:;)]$", "^[-,.;:=+*/^≤≥<>)]"


def join_lines(text: str) -> list[str]:
    """The lines of a text without blank ones, where a line that goes on takes the next one in."""
    end, operator, formula = re.compile(_END), re.compile(_OPERATOR), re.compile(FORMULA)
    done: list[str] = []
    for line in filter(None, (p.strip(SPACE) for p in text.split("\n"))):
        last = done[-1] if done else None
        goes_on = last is not None and (len(last) < SHORT_LINE and not end.search(last) or operator.search(line) or len(line) < SHORT_FORMULA and formula.search(line) and formula.search(last))
        if goes_on:
            done[-1] = f"{last} {line}"
        else:
            done.append(line)
    return done


def joined_lines(c: Column) -> Column:
    """join_lines() of a column; a null text has no lines."""

    def joined(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: join_lines(t or ""))

    return F.pandas_udf(joined, S.ArrayType(S.StringType()))(c)


@query(
    rf"""WITH RECURSIVE {_LINES_SQL},
r(doc_id, pos, part, body) AS (SELECT doc_id, pos, 0::BIGINT, line FROM l WHERE pos = 1
 UNION ALL SELECT doc_id, pos, CASE WHEN goes_on THEN part ELSE part + 1 END, CASE WHEN goes_on THEN body || ' ' || line ELSE line END
 FROM (SELECT r.doc_id, l.pos, r.part, r.body, l.line, length(r.body) < {SHORT_LINE} AND NOT regexp_matches(r.body, '{_END}') OR regexp_matches(l.line, '{_OPERATOR}') OR length(l.line) < {SHORT_FORMULA} AND regexp_matches(l.line, '{FORMULA}') AND regexp_matches(r.body, '{FORMULA}') AS goes_on
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.pos = r.pos + 1)),
w AS (SELECT doc_id, part, max_by(body, pos) AS body FROM r GROUP BY ALL)
SELECT doc_id, count(part) AS n_lines, md5(coalesce(string_agg(body, chr(10) ORDER BY part), '')) AS digest FROM documents LEFT JOIN w USING (doc_id) GROUP BY doc_id"""
)
def line_joins(spark, sf_dir):
    """Lines that go on take the next one in: by their end, an operator, or a formula."""
    own = read(spark, sf_dir, "documents").select("doc_id", joined_lines(F.col("text")).alias("ls"))
    return own.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.md5(F.array_join("ls", "\n")).alias("digest"))


_MARKDOWN = [(r"(?m)^#{1,6} +", ""), (r"(?m)^ *[*+-] +", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`([^`]*)`", "$1"), *[(r"(\*\*|__|\*|_)([^*_\n]+)(\*\*|__|\*|_)", "$2")] * 3, (r"(?m)^\||\|$", ""), (r" *\| *", "; ")]


def markdown_text(c: Column) -> Column:
    """Markdown as plain text: emphasis is unwrapped three times, table rows are flattened."""
    for pattern, to in _MARKDOWN:
        c = F.regexp_replace(c, pattern, to)
    return T.strip(c)


def _markdown_sql() -> str:
    out = "text"
    for pattern, to in _MARKDOWN:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return _SQL_STRIP.format(out)


@query(f"WITH t AS (SELECT doc_id, {_markdown_sql()} AS t FROM documents) SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest FROM t")
def strip_markdown(spark, sf_dir):
    own = read(spark, sf_dir, "documents").select("doc_id", markdown_text(F.col("text")).alias("t"))
    return own.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(
    r"""
WITH e AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT *, CASE WHEN length(line) <= 140 AND regexp_matches(line, '^[A-Z][^.]*:$|^#|^[0-9]+[.] ') THEN line END AS head FROM e),
f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS topic FROM h)
SELECT doc_id, coalesce(topic, '') AS topic, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM f GROUP BY ALL
"""
)
def inherited_heading(spark, sf_dir):
    """Lines take the last heading above them."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    head = F.when((F.char_length("line") <= 140) & F.col("line").rlike("^[A-Z][^.]*:$|^#|^[0-9]+[.] "), F.col("line"))
    topic = F.last(head, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("topic", F.coalesce(topic, F.lit(""))).groupBy("doc_id", "topic").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).cast("long").alias("chars"))
