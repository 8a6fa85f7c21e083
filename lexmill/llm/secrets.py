"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

All of it is DataFrame functions. Patterns give the base spans. Besides, every long run of letters, digits and the marks
of encoded strings is a candidate: Markov chains of characters give its log-likelihood ratio, and those that are likelier
random by LEAST nats are spans too, unless they overlap a base span.

A string of few different characters is neither, and one that is only a little likelier random at each step is taken for a
name of a kind that the corpus lacks; both are left alone.

All chains are trained from labelled samples. Random strings have a chain for each way of writing them (WRITTEN): the
distinct values of base spans, and DRAWN digests in hexadecimal numbers of either case and in base 64; the likeliest chain
speaks for them. Ordinary: all runs of eight such characters or more, but too short to be candidates, beside the base
spans, once a document. Only counts of pairs of characters, at most 67 x 67 a chain, reach the driver.
"""

from __future__ import annotations

import json
import math
import string

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .text import documents, stored

#: The kinds of base spans in their order, their patterns, and the group that holds the value.
BASE = {
    "assign": ("((?i)password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2),
    "access": ("AKIA[A-Z0-9]{16,}", 0),
    "hex": ("[0-9a-f]{24,}", 0),
}
LEAST_VALUE = 6
#: Characters of candidates, how many a candidate has at least, and a sample of ordinary identifiers.
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
CANDIDATE, SAMPLE = 20, 8
_RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{}}}(?![A-Za-z0-9+/_=-])"
#: Log-likelihood ratio, in nats, from which a candidate is a span: odds of a million to one, and this for each step on
#: average; and the different characters that it has at least.
LEAST, LEAST_STEP, LEAST_DISTINCT = math.log(1e6), 0.4, 8
DRAWN = 2000
#: Ways of writing random strings, by the first pattern that a string matches.
WRITTEN = {"lower": "^[0-9a-f]+$", "upper": "^[0-9A-Z]+$", "mixed": ""}
KINDS = [*BASE, "random"]


def pieces(text: Column, kind: int, pattern: str, group: int) -> Column:
    """kind, at, gap, size and value of a pattern's matches in order: gap characters of text lie before each of them."""
    rule = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, rule, F.lit(0)).alias("match"), F.regexp_extract_all(text, rule, F.lit(group)).alias("value"))
    part = lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.char_length(p.gap).cast("long").alias("gap"), F.char_length(p.match).cast("long").alias("size"), p.value.alias("value"))
    return F.when(text.rlike(pattern), F.transform(F.filter(zipped, lambda p: p.match.isNotNull()), part)).otherwise(F.array())


def found(docs: DataFrame) -> DataFrame:
    """row, doc_id and pieces of all kinds of each row, as a table; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [*BASE.values(), (_RUN.format(f"{CANDIDATE},"), 0)]
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*(pieces(text, k, *rule) for k, rule in enumerate(kinds))).alias("pieces")))


def pairs(runs: DataFrame) -> dict[str, dict[str, int]]:
    """For each value of column label, how often each pair of neighbouring characters occurs in the strings of column run."""
    chars = F.split("run", "")
    each = F.zip_with(F.slice(chars, F.lit(1), F.size(chars) - 1), F.slice(chars, F.lit(2), F.size(chars) - 1), lambda a, b: F.concat(a, b))
    counts = runs.filter(F.char_length("run") > 1).select("label", F.explode(each).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))
    out: dict[str, dict[str, int]] = {}
    for r in counts.collect():
        out.setdefault(r["label"], {})[r["pair"]] = r["n"]
    return out


def chain(n: dict[str, int]) -> list[float]:
    """The logarithms of a chain's transition probabilities for each pair of characters, one being added to each count."""
    of = {a: sum(n.get(a + b, 0) for b in ALPHABET) + len(ALPHABET) for a in ALPHABET}
    return [math.log((n.get(a + b, 0) + 1) / of[a]) for a in ALPHABET for b in ALPHABET]


def ratios(random: dict[str, dict[str, int]], ordinary: dict[str, int]) -> list[list[float]]:
    """For each way of writing random strings, the log ratio of its chain to the ordinary one for each pair of characters."""
    plain = chain(ordinary)
    return [[r - o for r, o in zip(chain(random.get(way, {})), plain, strict=True)] for way in WRITTEN]


def trained(docs: DataFrame, table: DataFrame, drawn: int = DRAWN) -> list[list[float]]:
    """The ratios() of the chains, trained from a frame of documents and its found() table."""
    spark, last = docs.sparkSession, len(BASE)
    values = table.select(F.explode("pieces").alias("p")).filter((F.col("p.kind") < last) & (F.char_length("p.value") >= CANDIDATE)).select(F.regexp_replace("p.value", "[^A-Za-z0-9+/_=-]", "").alias("run")).distinct()
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    made = spark.range(drawn).select(F.explode(F.array(F.rtrim(F.base64(F.unhex(digest)), F.lit("=")), digest, F.upper(digest))).alias("run"))
    way = F.when(F.col("run").rlike(WRITTEN["lower"]), "lower").when(F.col("run").rlike(WRITTEN["upper"]), "upper").otherwise("mixed")
    random = pairs(values.unionByName(made).withColumn("label", way))
    without = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "|".join(pattern for pattern, _ in BASE.values()), " ")
    runs = F.array_distinct(F.regexp_extract_all(without, F.lit(_RUN.format(f"{SAMPLE},{CANDIDATE - 1}")), F.lit(0)))
    plain = docs.select(F.lit("ordinary").alias("label"), F.explode(runs).alias("run"))
    return ratios(random, pairs(plain).get("ordinary", {}))


def likelihood(value: Column, tables: list[list[float]]) -> Column:
    """The log-likelihood ratio of a string of ALPHABET's characters: the highest of the ways of writing that it can be of."""
    at = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def ratio(table: list[float]) -> Column:
        given = F.from_json(F.lit(json.dumps(table)), "array<double>")
        each = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.get(given, a * len(ALPHABET) + b))
        return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)

    return F.greatest(*(F.when(value.rlike(p), ratio(t)) for p, t in zip(WRITTEN.values(), tables, strict=True))) - math.log(len(tables))


def is_random(value: Column, tables: list[list[float]]) -> Column:
    """Whether a candidate is a random string: by its ratio as a whole and a step, and its different characters."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT
    return F.when(varied, likelihood(value, tables) >= F.greatest(F.lit(LEAST), LEAST_STEP * (F.char_length(value) - 1))).otherwise(False)


def secret_spans(table: DataFrame, model: list[list[float]]) -> DataFrame:
    """One row per row of a found() table: row, doc_id, and its spans (start, kind, end) in order, in code points."""
    last = len(BASE)
    each = table.filter(F.size("pieces") > 0).select("row", "doc_id", F.explode("pieces").alias("p")).select("row", "doc_id", "p.*")
    upto = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    good = F.when(F.col("kind") == 0, F.char_length("value") >= LEAST_VALUE).when(F.col("kind") < last, True).otherwise(is_random(F.col("value"), model))
    each = each.withColumn("good", good)
    base, order = F.col("good") & (F.col("kind") < last), W.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & F.coalesce(after >= F.col("end"), F.lit(True))
    each = each.withColumn("good", F.col("good") & ((F.col("kind") < last) | free))
    spans = F.array_sort(F.collect_list(F.when(F.col("good"), F.struct("start", "kind", "end"))))
    some = each.groupBy("row", "doc_id").agg(spans.alias("spans"))
    none = table.filter(F.size("pieces") == 0).select("row", "doc_id", F.array().cast(some.schema["spans"].dataType).alias("spans"))
    return some.unionByName(none)


def named(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    A null or empty text has no spans, and base_sha256 is that of the empty string. Repeated rows, and rows that share a
    doc_id or have none, are scanned each by itself. Without candidates or samples the chains are those of the drawn
    digests and of even odds. Extra columns of docs are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    table = found(docs)
    rows = secret_spans(table, trained(docs, table))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    base = named(F.filter("spans", lambda s: s.kind < len(BASE)))
    return rows.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)), F.sha2(base.cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), count(len(BASE)).alias("n_random"))


def op12_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
