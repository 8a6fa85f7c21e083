"""Candidate items and their rule checks: structure, balance, flaws, numbers, final gate, best candidate of a slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from lexmill.plans.registry import query, read

# Phrases that a wrong option must not hold, and words of certainty.
BANNED = ["all of the above", "none of the above", "tất cả các phương án", "không có phương án", "tất cả đáp án"]
ABSOLUTE = ["luôn luôn", "luôn", "mọi trường hợp", "tất cả các trường hợp", "không bao giờ", "tuyệt đối không", "chắc chắn không", "always", "never", "absolutely", "definitely"]
NUMERIC = r"^ *-?[0-9]+(?:[.,][0-9]+)? *$"
MATHS_VALUE = r"^ *(?:-?[0-9]+(?:[.,][0-9]+)?|[+-]? *(?:∞|inf|infty)|undefined|dne) *$"


#: Numbers of items of one order.
GROUP = 1000


def options_of(lineitem: DataFrame) -> DataFrame:
    """(item_id, options): each four lines of an order, in order, are an item's answer and distractors; a rest has fewer."""
    line = F.col("l_linenumber")
    option = (
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("int").cast("string"))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("about "), F.col("l_quantity").cast("int").cast("string"), F.lit(" units of it")))
        .when(F.col("l_partkey") % 17 == 0, "never more than this")
        .when(F.col("l_partkey") % 19 == 0, "all of the above")
        .otherwise(F.col("l_suppkey").cast("string"))
    )
    rows = lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(line.alias("pos"), option.alias("o")))).alias("o"))
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.size("o") - 1, F.lit(4)), lambda k: F.struct((k / 4).cast("long").alias("k"), F.slice("o", k + 1, 4).alias("o"))))
    return rows.select("l_orderkey", parts.alias("p")).select((F.col("l_orderkey") * GROUP + F.col("p.k")).alias("item_id"), F.transform("p.o", lambda x: x.o).alias("options"))


def items(lineitem: DataFrame) -> DataFrame:
    """The items that have all four options; candidate_issues() tells which others there are."""
    return options_of(lineitem).filter(F.size("options") == 4)


_PARTS = f"""WITH x AS (SELECT l_orderkey, l_linenumber AS pos, CASE WHEN l_returnflag = 'A' THEN l_quantity::INT::VARCHAR WHEN l_returnflag = 'R' THEN 'about ' || l_quantity::INT || ' units of it'
 WHEN l_partkey % 17 = 0 THEN 'never more than this' WHEN l_partkey % 19 = 0 THEN 'all of the above' ELSE l_suppkey::VARCHAR END AS o FROM lineitem),
y AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, o) - 1) // 4 AS k FROM x),
j AS (SELECT l_orderkey * {GROUP} + k AS item_id, list(o ORDER BY pos, o) AS o FROM y GROUP BY l_orderkey, k)"""
_ITEMS = _PARTS + ", i AS (SELECT * FROM j WHERE len(o) = 4)"


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(text), F.lit(w))
    return out


def scaled(options: Column) -> Column:
    """Whether the numbers of all-numeric options stay within a factor of 1000 of their upper median; true for others."""
    numbers = F.transform(options, lambda o: F.expr("null").cast("double") if o is None else F.replace(F.trim(o), F.lit(","), F.lit(".")).try_cast("double"))
    sizes = F.array_sort(F.transform(F.filter(numbers, lambda x: x != 0), F.abs))
    median = F.get(sizes, F.floor(F.size(sizes) / 2).cast("int"))
    fine = F.forall(sizes, lambda x: F.when(x >= median, x <= median * 1000).otherwise(median <= x * 1000))
    return F.when(F.exists(numbers, lambda x: x.isNull()) | (F.size(sizes) < 2), True).otherwise(fine)


def issues(options: Column) -> Column:
    """The names of the checks that options (the answer first) fail, in a fixed order."""
    bare = F.transform(options, lambda o: F.lower(F.trim(o)))
    answer, wrong = F.get(bare, 0), F.slice(bare, 2, 3)
    size = F.transform(options, lambda o: F.char_length(F.trim(o)))
    number = F.get(options, 0).rlike(NUMERIC)
    checks = {
        "unique_answer": ~F.array_contains(wrong, answer),
        "length_balance": (F.array_min(size) > 0) & (F.array_max(size) * 10 <= F.array_min(size) * 35),
        "anti_pattern": ~F.exists(wrong, lambda o: _any(o, BANNED)),
        "no_absolute_terms": ~F.exists(wrong, lambda o: _any(o, ABSOLUTE)),
        "label_answer": ~F.upper(answer).isin("A", "B", "C", "D"),
        "subsumption": ~F.exists(wrong, lambda o: (F.char_length(o) >= 8) & (F.char_length(answer) >= 8) & (F.contains(o, answer) | F.contains(answer, o))),
        "format_consistency": ~number | F.forall(options, lambda o: F.lower(o).rlike(MATHS_VALUE) | (F.char_length(F.trim(o)) < 12)),
        "no_duplicate_distractor": F.size(F.array_distinct(wrong)) == F.size(wrong),
        "distractor_text": F.forall(wrong, lambda o: o.rlike("[0-9A-Za-zÀ-ỹ]")),
        "numeric_scale": scaled(options),
    }
    return F.array_compact(F.array(*(F.when(ok, F.lit(None)).otherwise(F.lit(name)) for name, ok in checks.items())))


def _like(words: list[str], x: str) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


_CHECKS = {
    "unique_answer": "NOT list_contains(w, a)",
    "length_balance": "list_min(z) > 0 AND list_max(z) * 10 <= list_min(z) * 35",
    "anti_pattern": f"len(list_filter(w, lambda x: {_like(BANNED, 'x')})) = 0",
    "no_absolute_terms": f"len(list_filter(w, lambda x: {_like(ABSOLUTE, 'x')})) = 0",
    "label_answer": "upper(a) NOT IN ('A', 'B', 'C', 'D')",
    "subsumption": "len(list_filter(w, lambda x: length(x) >= 8 AND length(a) >= 8 AND (contains(x, a) OR contains(a, x)))) = 0",
    "format_consistency": f"NOT regexp_matches(o[1], '{NUMERIC}') OR len(list_filter(o, lambda x: NOT (regexp_matches(lower(x), '{MATHS_VALUE}') OR length(trim(x)) < 12))) = 0",
    "no_duplicate_distractor": "len(list_distinct(w)) = len(w)",
    "distractor_text": "len(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9A-Za-zÀ-ỹ]'))) = 0",
    "numeric_scale": "len(list_filter(v, lambda x: x IS NULL)) > 0 OR len(n) < 2 OR len(list_filter(n, lambda x: CASE WHEN x >= n[len(n) // 2 + 1] THEN x > n[len(n) // 2 + 1] * 1000 ELSE n[len(n) // 2 + 1] > x * 1000 END)) = 0",
}
_ISSUES = (
    _ITEMS
    + """, b AS (SELECT item_id, o, list_transform(o, lambda x: lower(trim(x))) AS b FROM i), c AS (SELECT *, b[1] AS a, b[2:4] AS w, list_transform(o, lambda x: length(trim(x))) AS z,
 list_transform(o, lambda x: try_cast(replace(trim(x), ',', '.') AS DOUBLE)) AS v FROM b), d AS (SELECT *, list_sort(list_transform(list_filter(v, lambda x: x <> 0), lambda x: abs(x))) AS n FROM c),
 e AS (SELECT item_id, o, list_filter(["""
    + ", ".join(f"CASE WHEN NOT ({sql}) THEN '{name}' END" for name, sql in _CHECKS.items())
    + "], lambda x: x IS NOT NULL) AS issues FROM d)"
)


@query(_ISSUES + " SELECT item_id, array_to_string(issues, ',') AS issues, len(issues)::BIGINT AS n FROM e UNION ALL SELECT item_id, 'distractor_count', 1 FROM j WHERE len(o) < 4")
def candidate_issues(spark, sf_dir):
    """What is wrong with each item of all lines; one with fewer than four options isn't looked at further."""
    rows = options_of(read(spark, sf_dir, "lineitem"))
    found = F.when(F.size("options") < 4, F.array(F.lit("distractor_count"))).otherwise(issues(F.col("options")))
    rows = rows.select("item_id", found.alias("issues"))
    return rows.select("item_id", F.array_join("issues", ",").alias("issues"), F.size("issues").cast("long").alias("n"))


@query(_ISSUES + " SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM e) GROUP BY issue")
def iwf_checks(spark, sf_dir):
    """How many items fail each check."""
    rows = items(read(spark, sf_dir, "lineitem")).select(F.explode(issues(F.col("options"))).alias("issue"))
    return rows.groupBy("issue").agg(F.count("*").alias("n"))


SOFT = ["length_balance", "numeric_scale", "no_absolute_terms"]
_SOFT_SQL = "['" + "', '".join(SOFT) + "']"


@query(_ISSUES + f" SELECT len(list_filter(issues, lambda x: NOT list_contains({_SOFT_SQL}, x))) = 0 AS accepted, len(list_filter(issues, lambda x: list_contains({_SOFT_SQL}, x)))::BIGINT AS soft, count(*) AS n FROM e GROUP BY ALL")
def hard_soft_checks(spark, sf_dir):
    """Hard checks decide, soft ones are recorded."""
    soft = F.array(*map(F.lit, SOFT))
    found = issues(F.col("options"))
    rows = items(read(spark, sf_dir, "lineitem")).select((F.size(F.array_except(found, soft)) == 0).alias("accepted"), F.size(F.array_intersect(found, soft)).cast("long").alias("soft"))
    return rows.groupBy("accepted", "soft").agg(F.count("*").alias("n"))


@query(
    _ITEMS
    + r""", r AS (SELECT item_id, list_transform(o, lambda x: trim(regexp_replace(x, '^about | units of it$', '', 'g'))) AS o FROM i)
SELECT item_id, array_to_string(o, '|') AS options, len(list_filter(o, lambda x: length(x) < 1 OR regexp_matches(x, '[,;:(]$'))) = 0 AS sane FROM r"""
)
def option_sanity(spark, sf_dir):
    """Options without filler around a number, and whether all are complete."""
    fixed = F.transform("options", lambda o: F.trim(F.regexp_replace(o, "^about | units of it$", "")))
    rows = items(read(spark, sf_dir, "lineitem")).select("item_id", fixed.alias("o"))
    return rows.select("item_id", F.array_join("o", "|").alias("options"), F.forall("o", lambda o: (F.char_length(o) >= 1) & ~o.rlike("[,;:(]$")).alias("sane"))


@query(
    _ITEMS
    + """, s AS (SELECT item_id, o, list_sort(list_transform(range(4), lambda k: md5(item_id || '|' || k) || '|' || o[k + 1])) AS s FROM i)
SELECT item_id, array_to_string(list_transform(s, lambda x: substr(x, 34)), '|') AS shuffled, chr((64 + list_position(s, md5(item_id || '|0') || '|' || o[1]))::INT) AS answer_key FROM s"""
)
def option_shuffle(spark, sf_dir):
    """Options in an order that a hash of the item decides, and the answer's letter."""
    keyed = F.transform("options", lambda o, k: F.concat(F.md5(F.concat_ws("|", "item_id", k)), F.lit("|"), o))
    rows = items(read(spark, sf_dir, "lineitem")).select("item_id", F.get(keyed, 0).alias("first"), F.array_sort(keyed).alias("s"))
    return rows.select("item_id", F.array_join(F.transform("s", lambda x: F.substr(x, F.lit(34))), "|").alias("shuffled"), F.chr(F.array_position("s", F.col("first")) + 64).alias("answer_key"))


@query(
    """SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'P' THEN 'verifier_failed' WHEN o_totalprice < 20000 THEN 'low_quality' WHEN o_orderpriority = '5-LOW' THEN 'low_clarity' ELSE 'accepted' END AS verdict FROM orders"""
)
def final_gate(spark, sf_dir):
    """The first failing reason of an ordered list; a null score passes."""
    verdict = F.when(F.col("o_orderstatus") == "P", "verifier_failed").when(F.col("o_totalprice") < 20000, "low_quality").when(F.col("o_orderpriority") == "5-LOW", "low_clarity").otherwise("accepted")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), verdict.alias("verdict"))


@query(
    """SELECT o_custkey AS slot, o_orderkey AS item_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) = 1"""
)
def slot_best_candidate(spark, sf_dir):
    """The best candidate of each slot: verified first, then by quality, then the earlier; a map-side minimum, no window."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), (-F.col("o_totalprice")).alias("q"), F.col("o_orderkey").alias("item_id")))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("slot")).agg(best.alias("b")).select("slot", "b.item_id")


TARGET = 3


@query(
    f"""WITH o AS (SELECT o_custkey AS slot, o_orderkey AS item_id, o_orderstatus <> 'P' AND o_totalprice >= 20000 AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt FROM orders),
r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY slot ORDER BY attempt) AS upto FROM o) SELECT slot, item_id, attempt, ok AS accepted FROM r WHERE upto - ok::INT < {TARGET}"""
)
def accept_until_target(spark, sf_dir):
    """Attempts of each slot in order until TARGET are accepted."""
    order = W.partitionBy("slot").orderBy("item_id")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slot"), F.col("o_orderkey").alias("item_id"), F.expr("o_orderstatus <> 'P' and o_totalprice >= 20000").alias("accepted"))
    rows = rows.withColumn("attempt", F.row_number().over(order).cast("long")).withColumn("upto", F.sum(F.col("accepted").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.filter(F.col("upto") - F.col("accepted").cast("int") < TARGET).drop("upto")


@query(
    """SELECT conv_id, turn, regexp_matches(lower(text), '(increase|more|plus).{0,50}(decrease|less|minus)') AS contradiction, contains(text, '?') AS question, try_cast(text AS JSON) IS NOT NULL AS is_json FROM conversations"""
)
def text_predicates(spark, sf_dir):
    """Directional contradiction by co-occurrence, question mark, and whether a text is JSON."""
    text = F.col("text")
    json = F.try_parse_json(text).isNotNull()
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(text).rlike("(increase|more|plus).{0,50}(decrease|less|minus)").alias("contradiction"), F.contains(text, F.lit("?")).alias("question"), json.alias("is_json"))
