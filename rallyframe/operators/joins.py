"""As-of, nearest, fail-closed and reciprocal joins, each one shuffle by its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, payload: list[str], tolerance: str, strict: bool = True) -> DataFrame:
    """``left`` with the payload of the latest right row before its time (at or before it unless strict), no older than ``tolerance``.

    Both sides are stacked and the last right row is carried forward in one window, so a key is sorted once and never
    multiplied. tolerance: an interval such as "14 days". Payload columns get the right time beside them.
    """
    pair = F.struct(F.col(right_time).alias("t"), *[F.col(c).alias(c) for c in payload])
    tags = left.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__o"), F.struct(*left.columns).alias("__l"))
    facts = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__o"), pair.alias("__r"))
    both = tags.unionByName(facts, allowMissingColumns=True)
    order = Window.partitionBy(*[f"__k{i}" for i in range(len(by))]).orderBy("__t", "__o", F.col("__r")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__r", F.last("__r", ignorenulls=True).over(order)).where("__l is not null")
    fresh = F.col("__r.t") >= F.col("__t") - F.expr(f"interval {tolerance}")
    return seen.select("__l.*", *[F.when(fresh, F.col(f"__r.{c}")).alias(c) for c in payload], F.when(fresh, F.col("__r.t")).alias("asof_time"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, payload: list[str], tolerance_s: int, tie: str) -> DataFrame:
    """``left`` with the payload of the right row nearest in time within the tolerance; ties go to the earlier, then to the lesser ``tie``.

    Times are cut into steps as long as the tolerance: a left row meets the three steps around it, so the join is on equal
    keys and its rows stay bounded by what lies near.
    """
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    probes = left.withColumn("__row", F.monotonically_increasing_id()).withColumn("__s", seconds(F.col(left_time)))
    probes = probes.withColumn("__step", F.explode(F.array(*[F.floor(F.col("__s") / tolerance_s) + k for k in (-1, 0, 1)])))
    facts = right.select(*by, seconds(F.col(right_time)).alias("__rs"), F.struct(F.col(right_time).alias("t"), F.col(tie).alias("tie"), *payload).alias("__p")).withColumn("__step", F.floor(F.col("__rs") / tolerance_s))
    met = probes.join(facts, [*by, "__step"], "left").withColumn("__d", F.abs(F.col("__s") - F.col("__rs"))).withColumn("__ok", F.col("__d") <= tolerance_s)
    best = met.groupBy("__row").agg(*[F.first(c).alias(c) for c in left.columns], F.min(F.when(F.col("__ok"), F.struct("__d", "__p"))).alias("__best"))
    return best.select(*left.columns, *[F.col(f"__best.__p.{c}").alias(c) for c in payload])


def unique_key_join(left: DataFrame, right: DataFrame, key: Column, right_key: Column, id_col: str) -> DataFrame:
    """``left`` with ``id_col`` of the right row whose key is unique there; keys of several ids link nothing."""
    once = right.select(right_key.alias("__k"), id_col).groupBy("__k").agg(F.min(id_col).alias(id_col), F.max(id_col).alias("__m")).where(f"{id_col} = __m").drop("__m")
    return left.withColumn("__k", key).join(once, "__k", "left").drop("__k")


def mutual_pairs(df: DataFrame, keys: list[str], consistent: Column) -> DataFrame:
    """Adds ``mutual``: whether the key has exactly two rows that are both consistent."""
    w = Window.partitionBy(*keys)
    return df.withColumn("mutual", (F.count("*").over(w) == 2) & F.bool_and(consistent).over(w))
