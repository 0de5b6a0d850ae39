"""Name keys and token overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def initial_surname(name: Column) -> Column:
    """The first letter and the last word of a plain name."""
    parts = F.split(plain_name(name), " ")
    return F.concat_ws(" ", F.substring(F.element_at(parts, 1), 1, 1), F.element_at(parts, -1))


def overlap_of_shorter(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
