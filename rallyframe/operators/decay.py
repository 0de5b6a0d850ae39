"""Decayed moments as mergeable sums: rows are summed per key and day, and days combined by prefix; no history is gathered.

A day's sums are weighed up from the start of a slice of days, so that the sums of earlier days are plain running sums;
a slice is so long that weights within it stay far from the limits of doubles. Earlier slices come in as totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half-lives in a slice: weights within one range over 2**400, their squares over 2**800.
SLICE = 400


def daily(df: DataFrame, keys: list[str], day: str, value: Column, name: str = "") -> DataFrame:
    """Per key and day: <name>n, <name>mean and <name>m2 of the values that are not null."""
    return df.groupBy(*keys, day).agg(F.count(value).alias(f"{name}n"), F.avg(value).alias(f"{name}mean"), (F.var_pop(value) * F.count(value)).alias(f"{name}m2"))


def moments_before(days: DataFrame, keys: list[str], day: str, half_lives: dict[str, float], name: str = "", more: list[str] | None = None) -> DataFrame:
    """Adds to each row of ``days`` (a ``daily`` table, one row per key and day) a struct (n, weight, ess, mean, variance) of earlier days for each half-life.

    weight: the sum of 2^(-age / half-life); mean, ess and variance are null without earlier values. Values more than three
    slices old weigh nothing. more: further keys that the day's rows share (one row per key, these and day).
    """
    n, at = F.coalesce(F.col(f"{name}n"), F.lit(0)), F.unix_date(F.col(day))
    every = [*keys, *(more or [])]
    whole = Window.partitionBy(*every)
    # sums are taken around the key's first mean, which no earlier day than its own uses
    center = F.coalesce(F.first(f"{name}mean", ignorenulls=True).over(whole.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    off = F.coalesce(F.col(f"{name}mean") - F.col("__c"), F.lit(0.0))
    out = days.withColumn("__c", center).withColumns({"__n": n.cast("double"), "__x": n * off, "__xx": F.coalesce(F.col(f"{name}m2"), F.lit(0.0)) + n * off * off})
    out = out.withColumn("__before", F.coalesce(F.sum(n).over(whole.orderBy(at).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for label, half_life in half_lives.items():
        length = int(SLICE * half_life)
        part = F.floor(at / length)
        up = F.pow(F.lit(2.0), (at - part * length) / half_life)
        step = 2.0 ** (-length / half_life)
        out = out.withColumns({"__s": part, "__up": up})
        own = Window.partitionBy(*every, "__s").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
        back = lambda k: Window.partitionBy(*every).orderBy("__s").rangeBetween(-k, -k)

        def total(value: Column, power: int) -> Column:
            weighed = value * F.pow(F.col("__up"), F.lit(float(power)))
            sums = [F.coalesce(F.sum(weighed).over(w), F.lit(0.0)) for w in (own, back(1), back(2))]  # noqa: B023
            return sums[0] + sums[1] * step**power + sums[2] * step ** (2 * power)  # noqa: B023

        out = out.withColumns({"__w": total(F.col("__n"), 1), "__ww": total(F.col("__n"), 2), "__wx": total(F.col("__x"), 1), "__wxx": total(F.col("__xx"), 1)})
        shift = F.try_divide("__wx", "__w")
        fields = [
            F.col("__before").alias("n"), (F.col("__w") / F.col("__up")).alias("weight"), F.try_divide(F.col("__w") * F.col("__w"), "__ww").alias("ess"),
            (F.col("__c") + shift).alias("mean"), F.greatest(F.try_divide("__wxx", "__w") - shift * shift, F.when(shift.isNotNull(), F.lit(0.0))).alias("variance"),
        ]
        out = out.withColumn(label, F.struct(*fields))
    return out.drop("__c", "__n", "__x", "__xx", "__before", "__s", "__up", "__w", "__ww", "__wx", "__wxx")


def with_prior(moments: Column, prior: float, weight: float) -> Column:
    """A decayed mean pulled towards a prior of so much weight; the prior itself without values."""
    return (prior * weight + F.coalesce(moments["weight"] * moments["mean"], F.lit(0.0))) / (weight + moments["weight"])
