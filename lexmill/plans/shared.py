"""Rules that are written once, as SQL expressions, and run by Spark and by the engine that it is compared with.

A rule is a list of steps, each a list of columns that are added to all others. The two engines name a few functions
differently; ``@x: ...`` is a function of x. White space in patterns stands for itself, and no pattern has a backslash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from lexmill.functions.text import MARKED, PLAIN

SPARK = {"@rx(": "regexp_like(", "@size(": "size(", "@each(": "transform(", "@keep(": "filter(", "@both(": "array_intersect(", "@uniq(": "array_distinct(", "@list(": "array(", "@at(": "try_element_at(", "@join(": "array_join(", "@sort(": "array_sort(", "@g": ""}
DUCK = {"@rx(": "regexp_matches(", "@size(": "len(", "@each(": "list_transform(", "@keep(": "list_filter(", "@both(": "list_intersect(", "@uniq(": "list_distinct(", "@list(": "list_value(", "@at(": "list_extract(", "@join(": "array_to_string(", "@sort(": "list_sort(", "@g": ", 'g'"}


def spark_sql(text: str) -> str:
    text = re.sub(r"FOLD\((\w+)\)", lambda m: f"translate(lower({m[1]}), '{MARKED}', '{PLAIN}')", text)
    for a, b in SPARK.items():
        text = text.replace(a, b)
    return re.sub(r"@(\w+): ", r"\1 -> ", text)


def duck_sql(text: str) -> str:
    text = re.sub(r"FOLD\((\w+)\)", r"strip_accents(translate(lower(\1), 'ª²³µ¹ºđſẛ', 'a23μ1odss'))", text)
    for a, b in DUCK.items():
        text = text.replace(a, b)
    return re.sub(r"@(\w+): ", r"lambda \1: ", text)


def with_steps(rows: DataFrame, steps: list[list[str]]) -> DataFrame:
    for step in steps:
        rows = rows.selectExpr("*", *map(spark_sql, step))
    return rows


def steps_sql(source: str, steps: list[list[str]]) -> str:
    for step in steps:
        source = f"SELECT *, {', '.join(map(duck_sql, step))} FROM ({source})"
    return source


def values(rows: list[tuple], names: list[str]) -> str:
    """The rows as a literal table of both engines."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({', '.join(names)})"
