"""Running sums and numbers over a whole table, by ranges of a value: no task holds more than a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a table is cut into, at quantiles of the value.
PARTS = 64


def dealt(df: DataFrame, value: str, parts: int = PARTS) -> DataFrame:
    """Adds __part: the number of the range that holds the row's value (a number); rows without one are in the first."""
    cuts = df.approxQuantile(value, [k / parts for k in range(1, parts)], 0.16 / parts)
    held = F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(value)) if cuts else F.array()
    return df.withColumn("__part", F.size(held))


def running(df: DataFrame, value: str, sums: list[str], parts: int = PARTS) -> DataFrame:
    """Adds before_<sum> for each column of ``sums``: its sum over all rows with a smaller ``value`` (unique and not null)."""
    rows = dealt(df, value, parts)
    totals = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])  # at most ``parts`` rows
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums])
    own = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums}).join(F.broadcast(starts), "__part")
    return summed.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"__{c}") for c in sums}).drop("__part", *[f"__{c}" for c in sums])


def numbered(df: DataFrame, value: str, then: list[Column], name: str, parts: int = PARTS) -> DataFrame:
    """Adds ``name``: the row's number from 1 by ``value`` (a number, nulls first) and ``then``. Many rows of one value meet in one range."""
    rows = dealt(df, value, parts)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__size"))  # at most ``parts`` rows
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(F.asc_nulls_first(value), *then))
    return rows.withColumn(name, own).join(F.broadcast(starts), "__part").withColumn(name, F.col(name) + F.col("__start")).drop("__part", "__start")
