"""Row rules: reasons for rejection, deduplication, precedence, quarantine and set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_reason(rules: dict[str, Column], ok: str = "ok") -> Column:
    """The first rule that fails, in order, or ``ok``. rules: reason -> condition of failing (null does not fail)."""
    out = F.lit(ok)
    for reason, failing in reversed(rules.items()):
        out = F.when(failing, F.lit(reason)).otherwise(out)
    return out


def all_reasons(rules: dict[str, Column]) -> Column:
    """Every rule that fails, as an array in order."""
    return F.filter(F.array(*[F.when(failing, F.lit(reason)) for reason, failing in rules.items()]), F.isnotnull)


def one_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old rows whose key is not among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def first_capture(frozen: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Frozen rows as they are, and the first incoming row of each key that is not frozen yet."""
    return frozen.unionByName(one_of_each(incoming.join(frozen.select(*keys).distinct(), keys, "left_anti"), keys, order))


def with_conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Adds ``conflict``: whether the key's rows differ in any of the values (nulls count as a value)."""
    differ = lambda c: (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))
    bad = F.lit(False)
    for c in values:
        bad = bad | F.coalesce(differ(c), F.lit(False))
    return df.join(df.groupBy(*keys).agg(bad.alias("conflict")), keys)


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def compared(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(change, n): keys that were added, removed, changed or stayed the same."""
    both = before.select(*keys, F.col(value).alias("__old"), F.lit(1).alias("__a")).join(after.select(*keys, F.col(value).alias("__new"), F.lit(1).alias("__b")), keys, "full")
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    return both.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))
