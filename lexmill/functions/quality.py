"""Quality measures of a text unit as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MATHS = r"[=<>^∫√±≤≥]"
CODE = r"printf|scanf|void |return |for \(|while \("


_HIT = "\x01"


def hits(c: Column, pattern: str) -> Column:
    """How often a pattern occurs, counted by a mark for each occurrence; no array of occurrences is made."""
    marked = F.regexp_replace(F.translate(c, _HIT, " "), pattern, _HIT)
    return (F.char_length(marked) - F.char_length(F.translate(marked, _HIT, ""))).cast("long")


def chars(c: Column, some: str) -> Column:
    """How many of a text's characters are among some."""
    return (F.char_length(c) - F.char_length(F.translate(c, some, ""))).cast("long")


def density(c: Column) -> Column:
    """Mathematical marks per 35 characters, in thousandths, 1000 at most."""
    room = F.greatest(F.lit(20), F.floor(F.char_length(c) / 35)).cast("long")
    return F.least(F.lit(1000), F.floor(1000 * chars(c, MATHS[1:-1]) / room)).cast("long")


def noise(c: Column) -> Column:
    """'high', 'medium' or 'low' by the share of marks that aren't part of prose."""
    size = F.greatest(F.char_length(c), F.lit(1)).cast("long")
    odd = chars(c, "#$%&*|~{}[]\\")
    return F.when(F.char_length(c) < 80, "high").when(odd * 100 > size * 8, "high").when(odd * 100 > size * 2, "medium").otherwise("low")


def chunk_type(c: Column) -> Column:
    """'exercise' with three option lines or two question marks, 'example' with its marker, else 'theory'."""
    return (
        F.when((hits(c, r"\n[A-D][.)] ") >= 3) | (chars(c, "?") >= 2), "exercise")
        .when(F.lower(c).rlike("for example|zum beispiel|par exemple|por ejemplo"), "example")
        .otherwise("theory")
    )


def low_quality(c: Column) -> Column:
    """Why a unit is unusable, or null; texts with mathematics are only dropped for their length."""
    size = F.char_length(c).cast("long")
    maths = c.rlike(MATHS)
    return (
        F.when(size < 80, "short")
        .when(maths, F.lit(None))
        .when(chars(c, ".") * 5 > size, "dots")
        .when(hits(c, r"[A-Za-zÀ-ÿ]{2,}") < 18, "few_words")
        .when(hits(c, CODE) >= 8, "code")
        .when(chars(c, "+<=>|~^`$") * 100 > size * 18, "symbols")
        .when(chars(c, "{};=<>+/*[]") * 5 > (size - F.char_length(F.regexp_replace(c, "[A-Za-zÀ-ÿ]+", ""))) * 4, "code")
    )
