"""Normal forms, tokenisers and similarities as Column functions, all of built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: Letters with marks and the letters they decompose to, and marks on their own, which go.
_FOLDED = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower() for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)])}
_FOLDED = {c: base for c, base in _FOLDED.items() if len(base) == 1 and base != c and base.isalnum() and not base.isspace()} | {"đ": "d", "Đ": "d"}
_MARKS = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c))
MARKED, PLAIN = "".join(_FOLDED) + _MARKS, "".join(_FOLDED.values())


def fold(c: Column) -> Column:
    """Lower case without accents, as compatibility decomposition gives it for Latin letters, Vietnamese ones too."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0b\f\r]+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def tokens(c: Column) -> Column:
    """Folded words of three characters or more, in order."""
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]{3,}"), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def overlap(a: Column, b: Column) -> Column:
    """How many members two arrays without repeats share."""
    return F.size(F.array_intersect(a, b)).cast("long")


def run_length(members: Column, order: Column) -> Column:
    """The longest run of elements of order that are in members."""
    step = F.aggregate(
        order,
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("top")),
        lambda s, t: F.struct(
            F.when(F.array_contains(members, t), s.run + 1).otherwise(0).alias("run"),
            F.greatest(s.top, F.when(F.array_contains(members, t), s.run + 1).otherwise(0)).alias("top"),
        ),
        lambda s: s.top,
    )
    return step.cast("long")


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
