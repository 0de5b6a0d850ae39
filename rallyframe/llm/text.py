"""Words as column expressions: runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
BREAK = r"[\x20\x09-\x0D]+"


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words(text: Column) -> Column:
    """The words of a text; an empty array for null and blank texts."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BREAK))


def count_words(text: Column) -> Column:
    bare = trimmed(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BREAK))).cast("long")
