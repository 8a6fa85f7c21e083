"""Structured Streaming: throttled status updates and practice sessions with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.functions.shared import ensure_checkpoints
from lexmill.plans.registry import query


def stream(spark, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path) if _folder(spark, path) else spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def _folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def finished(df: DataFrame, mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    """All rows that a query over what is there now gives, kept in the shared folder; conf holds while the query starts."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        sink = df.writeStream.format("parquet").option("path", f"{out}/rows").outputMode("append")
    else:
        sink = df.writeStream.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/rows")).outputMode(mode)
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        sink.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY ALL")
def status_throttle(spark, sf_dir):
    """One update a window and type: the last event in each day of event time."""
    rows = stream(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    return finished(rows.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "last_event"), "complete")


@query("""SELECT user_id AS "user", count(*) AS answered, count(*) FILTER (WHERE event_type <> 'error') AS correct FROM events GROUP BY user_id""")
def session_state(spark, sf_dir):
    """Practice sessions as keyed state: counters that each batch of answers moves on."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        answered, correct = state.get if state.exists else (0, 0)
        for pdf in batches:
            answered, correct = answered + len(pdf), correct + int((pdf["event_type"] != "error").sum())
        state.update((answered, correct))
        yield pd.DataFrame({"user": [key[0]], "answered": [answered], "correct": [correct]})

    kept = stream(spark, sf_dir, "events").select("user_id", "event_type").groupBy("user_id").applyInPandasWithState(step, "user long, answered long, correct long", "answered long, correct long", "append", GroupStateTimeout.NoTimeout)
    return finished(kept).groupBy("user").agg(F.max("answered").alias("answered"), F.max("correct").alias("correct"))
