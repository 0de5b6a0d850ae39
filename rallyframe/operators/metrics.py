"""Aggregated reports: betting metrics, calibration, coverage, trailing windows and event analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.stats import wilson


def betting(df: DataFrame, by: list[str], won: Column, void: Column, stake: Column, odds: Column) -> DataFrame:
    """n, wins, losses, voids, hit_rate with its interval, staked, profit and roi per group; voids neither win nor lose."""
    live = ~void
    profit = F.when(void, F.lit(0.0)).when(won, stake * (odds - 1)).otherwise(-stake)
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(live & won).alias("wins"), F.count_if(live & ~won).alias("losses"), F.count_if(void).alias("voids"),
        F.coalesce(F.sum(F.when(live, stake)), F.lit(0.0)).alias("staked"), F.sum(profit).alias("profit"), F.avg(F.when(live, odds)).alias("avg_odds"),
    )
    decided = F.col("wins") + F.col("losses")
    low, high = wilson(F.col("wins"), decided)
    return out.select(
        *by, "n", "wins", "losses", "voids", F.round(F.try_divide("wins", decided), 6).alias("hit_rate"), F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"),
        F.round("staked", 4).alias("staked"), F.round("profit", 4).alias("profit"), F.round(F.try_divide("profit", "staked"), 6).alias("roi"), F.round("avg_odds", 6).alias("avg_odds"),
    )


def calibration(df: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """Per bin of equal width (the last closed, empty ones absent): bin, n, mean_p and rate."""
    place = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("rate"))


def scores(df: DataFrame, p: Column, y: Column, bins: int = 10) -> DataFrame:
    """One row: n, accuracy at 0.5, Brier score, log loss and expected calibration error; sums per bin are combined."""
    q = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -(y * F.ln(q) + (1 - y) * F.ln(1 - q))
    per = df.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("__b")).agg(
        F.count("*").alias("n"), F.sum(p).alias("p"), F.sum(y).alias("y"), F.count_if((p >= 0.5) == (y == 1)).alias("right"), F.sum((p - y) * (p - y)).alias("brier"), F.sum(loss).alias("loss")
    )
    total = F.sum("n")
    return per.agg(total.alias("n"), F.round(F.sum("right") / total, 6).alias("accuracy"), F.round(F.sum("brier") / total, 6).alias("brier"), F.round(F.sum("loss") / total, 6).alias("log_loss"), F.round(F.sum(F.abs(F.col("p") - F.col("y"))) / total, 6).alias("ece"))


def selective(df: DataFrame, p: Column, y: Column, thresholds: list[float]) -> DataFrame:
    """Per threshold: how many rows are at least that sure, their accuracy and share. One pass, no join."""
    sure = F.greatest(p, 1 - p)
    found = [F.struct(F.lit(t).alias("threshold"), F.count_if(sure >= t).alias("n"), F.count_if((sure >= t) & ((p >= 0.5) == (y == 1))).alias("right"), F.count("*").alias("all")) for t in thresholds]
    rows = df.agg(F.array(*found).alias("r")).select(F.inline("r"))
    return rows.select("threshold", "n", F.round(F.try_divide("right", "n"), 6).alias("accuracy"), F.round(F.try_divide("n", "all"), 6).alias("coverage"))


def one_way(df: DataFrame, dimensions: list[str], y: Column, small: int = 50) -> DataFrame:
    """Each dimension's groups in one pass: dimension, value, n, rate and small_sample."""
    sets = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    rows = df.select(sets.alias("s"), y.alias("__y")).groupBy("s.dimension", "s.value")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("__y"), 6).alias("rate"), (F.count("*") < small).alias("small_sample"))


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, missing): the share of nulls of each column."""
    found = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.round(c, 6).alias("missing")) for c in columns])))


def trailing(df: DataFrame, time: str, now: Column, days: list[int], value: Column) -> DataFrame:
    """Per window of so many days up to ``now``: n and the mean value; each row is counted once per window that holds it."""
    age = F.col("__age")
    aged = df.withColumn("__age", F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(time).cast("timestamp")))
    held = F.explode(F.filter(F.array(*[F.lit(d) for d in days]), lambda d: (age >= 0) & (age <= d * 86400)))
    return aged.select(held.alias("days"), value.alias("__v")).groupBy("days").agg(F.count("*").alias("n"), F.round(F.avg("__v"), 6).alias("mean_value"))
