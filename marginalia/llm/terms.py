"""Keyword normalisation shared by the set and term operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_term(c: Column) -> Column:
    """Lower case, inner white space made one blank, trimmed (Unicode white space)."""
    return F.trim(F.lower(F.regexp_replace(c, r"(?U)\s+", " ")))


def normal_set(c: Column) -> Column:
    """Sorted distinct normalised items of an array; nulls and blanks dropped; null gives an empty array."""
    items = F.transform(F.coalesce(c, F.array().cast("array<string>")), normal_term)
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))))
