"""File sources and sinks: chunk data sets and results as JSON, front matter, Markdown pages, upserts by key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as S

from lexmill.functions import text as T
from lexmill.functions.shared import ensure_checkpoints
from lexmill.plans.registry import query, read

CHUNK = S.StructType([S.StructField("topic", S.StringType()), S.StructField("pages", S.ArrayType(S.IntegerType())), S.StructField("context", S.StringType()), S.StructField("raw_context", S.StringType()), S.StructField("clean_context", S.VariantType())])
RESULT = "metadata struct<job_id:string,duration_seconds:double,stopped_reason:string,cost:struct<tokens:bigint,calls:bigint>>, questions array<map<string,string>>, rejected array<map<string,string>>, _corrupt_record string"


def dataset_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, topic, pages, context, ...) of data-set files: one object each, chunk ids as keys, metadata left out."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", S.MapType(S.StringType(), S.StringType()))).alias("chunk_id", "json")).filter("chunk_id != 'metadata'")
    return rows.select("chunk_id", F.from_json("json", CHUNK).alias("c")).select("chunk_id", "c.*").filter("context is not null").withColumn("chunk_type", F.coalesce(F.try_variant_get("clean_context", "$.chunk_type", "string"), F.lit("theory")))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result files that can be read, one object each, with what they lack as null; corrupt ones are left out."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.from_json("value", S._parse_datatype_string(RESULT), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows.filter("_corrupt_record is null and (metadata is not null or questions is not null or rejected is not null)").drop("_corrupt_record")


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of the lines between a file's first two rules of three dashes."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)^---(.*?)---", 1)
    lines = whole.select("path", F.explode(F.split(head, "\n")).alias("line")).filter(F.contains("line", F.lit(":")))
    value = F.regexp_replace(T.strip(F.regexp_extract("line", "(?s)^[^:]*:(.*)$", 1)), '^"+|"+$', "")
    return lines.select("path", T.strip(F.substring_index("line", ":", 1)).alias("key"), value.alias("value"))


def instructions(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of files: what follows the front matter, or all of a file without one."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", T.strip(F.regexp_replace("value", r"(?s)^---.*?---", "")).alias("body"))


def written(df: DataFrame, key: str, text: str) -> str:
    """A new folder in the shared one with a file for each row, which holds its text; key tells rows apart and names their folders."""
    ensure_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    df.select(key, text).write.partitionBy(key).option("lineSep", "\n").text(path)
    return path


def written_alike(df: DataFrame, text: str) -> str:
    """Like written(), but in one folder, where names tell nothing: many files cost neither a folder each nor the driver's renaming of each."""
    ensure_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"
    rows = df.select(text).write.option("lineSep", "\n").option("maxRecordsPerFile", 1)
    # tasks rename their own files; the folder is new, and a job that fails leaves one that nothing reads
    rows.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    return path


def markdown_pages(text: Column) -> Column:
    """Pages (page, text): parts between rules of dashes, else from heading to heading; empty parts leave gaps."""
    parts = F.split(text, r"\n-{3,}\n")
    parts = F.when(F.size(parts) > 1, parts).otherwise(F.split(text, r"\n(?=## )"))
    return F.filter(F.transform(parts, lambda p, i: F.struct((i + 1).cast("long").alias("page"), T.strip(p).alias("text"))), lambda p: p.text != "")


@query(
    r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || '-----' || chr(10)) ELSE text END AS t FROM documents),
p AS (SELECT doc_id, unnest(range(len(string_split_regex(t, '\n-{3,}\n')))) + 1 AS page, unnest(string_split_regex(t, '\n-{3,}\n')) AS s FROM d)
SELECT doc_id, page::BIGINT AS page, length(regexp_replace(s, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g'))::BIGINT AS n_chars FROM p WHERE regexp_replace(s, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') <> ''"""
)
def page_split(spark, sf_dir):
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n-----\n"))).otherwise(F.col("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(markdown_pages(text)).alias("p"))
    return rows.select("doc_id", "p.page", F.char_length("p.text").cast("long").alias("n_chars"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of new, and those of old whose key new lacks; written to a new folder it replaces a store at once."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


@query("SELECT doc_id, quality::BIGINT AS quality FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 = 0)")
def store_upsert(spark, sf_dir):
    new = read(spark, sf_dir, "labels").filter("doc_id % 3 = 0").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return upsert(read(spark, sf_dir, "documents").select("doc_id", F.lit(-1).cast("long").alias("quality")), new, "doc_id")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast('[' || props || ']' AS JSON) IS NOT NULL AS parsed FROM events")
def lenient_json(spark, sf_dir):
    """Fields of JSON text; what can't be parsed is null, not an error."""
    json = F.try_parse_json("props")
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(json, "$.k", "bigint").alias("k"), json.isNotNull().alias("parsed"))


#: Rows of a table that make a file, and which files are cut off in the middle.
ROWS = 100
_BROKEN = "(doc_id // {} + length(source)) % 5 = 0".format(ROWS)


@query(
    f"""SELECT 'doc_' || doc_id AS chunk_id, lang AS topic, (1 + doc_id % 9)::BIGINT AS page, length(coalesce(text, ''))::BIGINT AS n_chars, md5(coalesce(text, '')) AS digest, CASE doc_id % 3 WHEN 0 THEN 'exercise' WHEN 1 THEN 'example' ELSE 'theory' END AS chunk_type
FROM documents WHERE NOT ({_BROKEN})"""
)
def chunk_sets(spark, sf_dir):
    """Chunks of data-set files, which are written from the documents first; files that are cut off give none."""
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN 'exercise' WHEN 1 THEN 'example' END")
    clean = F.when(kind.isNotNull(), F.struct(kind.alias("chunk_type")))
    own = F.struct(F.col("lang").alias("topic"), F.array((1 + F.col("doc_id") % 9).cast("int")).alias("pages"), F.coalesce("text", F.lit("")).alias("context"), clean.alias("clean_context"))
    entry = F.concat(F.lit('"doc_'), "doc_id", F.lit('": '), F.to_json(own))
    docs = read(spark, sf_dir, "documents").withColumn("part", F.expr(f"doc_id div {ROWS}"))
    files = docs.groupBy("source", "part").agg(F.concat_ws(", ", F.collect_list(entry)).alias("entries"))
    whole = F.concat(F.lit('{"metadata": {"source": "'), "source", F.lit('"}, '), "entries", F.lit("}"))
    broken = (F.col("part") + F.length("source")) % 5 == 0
    text = F.when(broken, F.substring(whole, F.lit(1), F.expr("char_length(entries) div 2"))).otherwise(whole)
    path = written_alike(files.select(text.alias("text")), "text")
    got = dataset_chunks(spark, path)
    return got.select("chunk_id", "topic", F.get("pages", 0).cast("long").alias("page"), F.char_length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest"), "chunk_type")


@query(
    f"""SELECT 'job' || (o_orderkey // {ROWS}) AS job_id, count(*) FILTER (WHERE o_orderstatus <> 'F') AS accepted, count(*) FILTER (WHERE o_orderstatus = 'F') AS rejected, sum(o_custkey)::BIGINT AS tokens, count(*) AS calls,
 CASE WHEN (o_orderkey // {ROWS}) % 3 = 0 THEN 'cancelled' END AS stopped_reason FROM orders WHERE (o_orderkey // {ROWS}) % 7 <> 0 GROUP BY o_orderkey // {ROWS}"""
)
def result_files(spark, sf_dir):
    """Counts and costs of result files, which are written from the orders first; files that are cut off are left out."""
    orders = read(spark, sf_dir, "orders").withColumn("job", F.expr(f"o_orderkey div {ROWS}"))
    item = F.create_map(F.lit("question_id"), F.concat(F.lit("q"), "o_orderkey"), F.lit("status"), F.col("o_orderstatus"))
    jobs = orders.groupBy("job").agg(F.collect_list(F.when(F.col("o_orderstatus") != "F", item)).alias("questions"), F.collect_list(F.when(F.col("o_orderstatus") == "F", item)).alias("rejected"), F.sum("o_custkey").alias("tokens"), F.count("*").alias("calls"))
    metadata = F.struct(F.concat(F.lit("job"), "job").alias("job_id"), F.when(F.col("job") % 3 == 0, "cancelled").alias("stopped_reason"), F.struct("tokens", "calls").alias("cost"))
    whole = F.to_json(F.struct(metadata.alias("metadata"), "questions", "rejected"))
    text = F.when(F.col("job") % 7 == 0, F.substring(whole, F.lit(1), (F.char_length(whole) / 2).cast("int"))).otherwise(whole)
    got = results(spark, written_alike(jobs.select(text.alias("text")), "text"))
    return got.select("metadata.job_id", F.size("questions").cast("long").alias("accepted"), F.size("rejected").cast("long").alias("rejected"), "metadata.cost.tokens", "metadata.cost.calls", "metadata.stopped_reason")


@query(
    r"""WITH s AS (SELECT replace(p_brand, '#', '_') AS skill, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_brand), f AS (SELECT * FROM s WHERE n % 4 <> 0)
SELECT skill, 'name' AS key, skill AS value FROM f UNION ALL SELECT skill, 'description', 'holds: ' || n || ' parts' FROM f UNION ALL SELECT skill, 'body', CASE WHEN n % 4 <> 0 THEN 'Look at part ' || first || '.' ELSE 'No front matter: ' || n END FROM s"""
)
def skill_files(spark, sf_dir):
    """Front matter and instructions of skill files, which are written from the parts' brands first; some have no front matter."""
    brands = read(spark, sf_dir, "part").groupBy(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("skill")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    head = F.concat(F.lit('---\nname: "'), "skill", F.lit('"\ndescription: holds: '), "n", F.lit(" parts\nno key here\n---\n\nLook at part "), "first", F.lit(".\n"))
    text = F.when(F.col("n") % 4 != 0, head).otherwise(F.concat(F.lit("No front matter: "), "n"))
    path = written(brands.select("skill", text.alias("text")), "skill", "text")
    skill = F.regexp_extract("path", "/skill=([^/]+)/", 1).alias("skill")
    return front_matter(spark, path).select(skill, "key", "value").unionByName(instructions(spark, path).select(skill, F.lit("body").alias("key"), F.col("body").alias("value")))
