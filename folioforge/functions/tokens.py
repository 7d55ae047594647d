"""The plain token counter: white-space separated pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import WHITE_SPACE, strip


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it appears."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(text: Column) -> Column:
    """Pieces between white space; an empty array for blank texts."""
    return _once(strip(text), lambda bare: F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"{WHITE_SPACE}+")))


def count(text: Column) -> Column:
    """Number of pieces, 0 for null; no piece is made for it."""
    n = _once(strip(text), lambda bare: F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(rf"{WHITE_SPACE}+")) + 1))
    return F.coalesce(n, F.lit(0)).cast("bigint")


def first(text: Column, n: Column) -> Column:
    """The first n pieces with single spaces; for a negative n all but the last -n."""

    def cut(parts: Column) -> Column:
        kept = F.when(n >= 0, n).otherwise(F.greatest(F.size(parts) + n, F.lit(0)))
        return F.array_join(F.slice(parts, F.lit(1), kept.cast("int")), " ")

    return _once(pieces(text), cut)
