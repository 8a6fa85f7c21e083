"""Places and running sums within a key that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

#: Numbers of the ordering column that one window sorts: a key's rows are sorted span by span, and spans are then added up.
SPAN = 10_000


def placed(rows: DataFrame, key: str, order: str, span: int = SPAN) -> DataFrame:
    """rows with their place within key, from 1 on, in order of a whole number."""
    return running(rows, key, order, F.lit(1).cast("long"), "place", span)


def running(rows: DataFrame, key: str, order: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """rows with the sum of value up to each of them within key, in order of a whole number that a key has once."""
    upto = W.partitionBy(key, "_span").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_span", F.floor(F.col(order) / span)).withColumn(name, F.sum(value).over(upto))
    spans = rows.groupBy(key, "_span").agg(F.max(F.struct(order, name)).alias("_last")).select(key, "_span", F.col(f"_last.{name}").alias("_all"))
    before = F.coalesce(F.sum("_all").over(W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(key, "_span", before.alias("_before"))
    return rows.join(spans, [key, "_span"]).withColumn(name, F.col(name) + F.col("_before")).drop("_span", "_before")


def lagged(rows: DataFrame, key: str, order: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """rows with the value of the row before each of them within key, in order of a whole number that a key has once; null for the first.

    Spans look back on their own, and their first rows at what the span before ends with.
    """
    own = W.partitionBy(key, "_span").orderBy(order)
    rows = rows.withColumn("_span", F.floor(F.col(order) / span)).withColumn(name, F.lag(value).over(own)).withColumn("_first", F.row_number().over(own) == 1)
    ends = rows.groupBy(key, "_span").agg(F.max_by(value, order).alias("_end"))
    ends = ends.select(key, "_span", F.lag("_end").over(W.partitionBy(key).orderBy("_span")).alias("_edge"))
    return rows.join(ends, [key, "_span"]).withColumn(name, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col(name))).drop("_span", "_first", "_edge")
