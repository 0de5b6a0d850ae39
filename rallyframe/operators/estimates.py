"""Estimates before each day: point-weighted rates, count projections, market states, and the report that compares two models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions.stats import shrink
from rallyframe.operators.decay import moments_before


def point_weighted(rows: DataFrame, player: str, tour: str, day: str, rate: str, points: str, half_life: float = 120.0, prior_points: float = 200.0, most: float = 250.0, least_prior: float = 1000.0) -> DataFrame:
    """Per player and day: estimate of the rate from earlier days, each row weighing its points (at most ``most``), decayed, with the tour's earlier rate as a prior of ``prior_points``.

    Null if the tour has fewer than ``least_prior`` earlier points, or under half of the player's earlier rates have usable points
    (1 to 3000, rate within 0 and 1). Sums per day are combined, no history is gathered.
    """
    usable = F.coalesce((F.col(points) > 0) & (F.col(points) <= 3000) & (F.col(rate) >= 0) & (F.col(rate) <= 1), F.lit(False))
    weight = F.when(usable, F.least(F.col(points).cast("double"), F.lit(most)))
    days = rows.groupBy(player, tour, day).agg(F.sum(weight).alias("n"), F.try_divide(F.sum(weight * F.col(rate)), F.sum(weight)).alias("mean"), F.lit(0.0).alias("m2"), F.count(rate).alias("rates"), F.count(weight).alias("counts"))
    days = moments_before(days, [player], day, {"w": half_life}, more=[tour])
    before = Window.partitionBy(player, tour).orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"rates": F.coalesce(F.sum("rates").over(before), F.lit(0)), "counts": F.coalesce(F.sum("counts").over(before), F.lit(0))})
    tours = rows.where(usable).groupBy(tour, day).agg(F.sum(points).alias("p"), F.sum(F.col(points) * F.col(rate)).alias("x"))
    tours = rows.select(tour, day).distinct().join(tours, [tour, day], "left")  # one row a tour and day
    earlier = Window.partitionBy(tour).orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1)
    tours = tours.select(tour, day, F.sum("p").over(earlier).alias("p"), F.sum("x").over(earlier).alias("x"))
    known = days.join(tours, [tour, day])
    mass = F.coalesce(F.col("w.weight") * F.col("w.mean"), F.lit(0.0))
    estimate = (prior_points * F.col("x") / F.col("p") + mass) / (prior_points + F.coalesce(F.col("w.weight"), F.lit(0.0)))
    fits = (F.col("p") >= least_prior) & (F.col("counts") > 0) & (2 * F.col("counts") >= F.col("rates"))
    return known.select(player, tour, day, F.when(fits, estimate).alias("estimate"), "rates", "counts")


def count_projections(sides: DataFrame, player: str, opponent: str, day: str, own: str, allowed: str, half_life: float, influence: float, least: int = 6, strength: float = 7.0, sure: float = 12.0) -> DataFrame:
    """``sides`` (one row for each side of a match) with estimate, variance, samples and opponent_samples from earlier days.

    The side's decayed mean is shrunk towards the mean of all earlier rows; what the opponent allows is shrunk likewise and has
    a share of ``influence``, less with fewer than ``sure`` rows. Null below ``least`` earlier rows of the side.
    """
    mass = lambda v, p: [F.count(v).alias(f"{p}n"), F.avg(v).alias(f"{p}mean"), (F.var_pop(v) * F.count(v)).alias(f"{p}m2")]
    days = sides.groupBy(player, day).agg(*mass(own, "o_"), *mass(allowed, "a_"))
    days = moments_before(moments_before(days, [player], day, {"o": half_life}, "o_"), [player], day, {"a": half_life}, "a_")
    every = sides.groupBy(day).agg(F.count(own).alias("n"), F.sum(own).alias("x"))
    before = Window.orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1)  # one row a day
    base = every.select(day, F.try_divide(F.sum("x").over(before), F.sum("n").over(before)).alias("base"))
    met = sides.join(days.select(player, day, "o"), [player, day]).join(days.select(F.col(player).alias(opponent), day, "a"), [opponent, day], "left").join(base, day)
    n_allowed = F.coalesce(F.col("a.n"), F.lit(0))
    mine = shrink(F.col("o.mean"), F.col("o.n"), F.col("base"), strength)
    theirs = F.when(F.col("a.mean").isNull(), F.col("base")).otherwise(shrink(F.col("a.mean"), n_allowed, F.col("base"), strength))
    share = influence * F.least(F.lit(1.0), n_allowed / sure)
    variance = (1 - share) * (1 - share) * F.col("o.variance") + share * share * F.coalesce(F.col("a.variance"), F.col("o.variance"))
    fits = F.col("o.n") >= least
    return met.withColumns({"estimate": F.when(fits, F.greatest(F.lit(0.0), (1 - share) * mine + share * theirs)), "variance": F.when(fits, F.greatest(F.lit(0.0), variance)), "samples": F.col("o.n"), "opponent_samples": n_allowed}).drop("o", "a", "base")


def market_state(rows: DataFrame, player: str, tour: str, fmt: str, order: list[str], value: str, last: int = 30, least: int = 12) -> DataFrame:
    """Per tour and player: samples (the last ``last`` rows with a value), their mean, and the format baseline of the player's last row (null below ``least`` values)."""
    valued = rows.where(F.col(value).isNotNull())
    base = valued.groupBy(tour, fmt).agg(F.count("*").alias("__n"), F.avg(value).alias("baseline")).select(tour, fmt, F.when(F.col("__n") >= least, F.col("baseline")).alias("baseline"))
    newest = Window.partitionBy(tour, player).orderBy(*[F.desc(c) for c in order])
    top = valued.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= last)
    per = top.groupBy(tour, player).agg(F.count("*").alias("samples"), F.avg(value).alias("mean"), F.max(F.when(F.col("__r") == 1, F.col(fmt))).alias(fmt))
    return per.join(base, [tour, fmt], "left").select(tour, player, "samples", "mean", fmt, "baseline")


def shadow_report(pairs: DataFrame, day: str, y: Column, champion: Column, challenger: Column, least_rows: int, least_days: int) -> DataFrame:
    """One row: n, days, both models' Brier score and log loss, the mean differences with the half width of their normal 95 % interval, and ready.

    Rows without both forecasts or a result are left out. ready: enough rows and days, and neither loss is worse for certain.
    """
    clip = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = lambda p: -(y * F.ln(clip(p)) + (1 - y) * F.ln(1 - clip(p)))
    rows = pairs.where(y.isNotNull() & champion.isNotNull() & challenger.isNotNull())
    rows = rows.select(F.col(day).alias("d"), F.pow(champion - y, F.lit(2.0)).alias("b0"), F.pow(challenger - y, F.lit(2.0)).alias("b1"), loss(champion).alias("l0"), loss(challenger).alias("l1"))
    days = rows.groupBy("d").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("b0", "b1", "l0", "l1")], *[F.sum(F.pow(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(2.0))).alias(f"{c}q") for c in "bl"])
    whole = days.agg(F.sum("n").alias("n"), F.count("*").alias("days"), *[F.sum(c).alias(c) for c in ("b0", "b1", "l0", "l1", "bq", "lq")])
    n = F.col("n")
    diff = lambda c: (F.col(f"{c}1") - F.col(f"{c}0")) / n
    half = lambda c: 1.959963984540054 * F.sqrt(F.greatest(F.col(f"{c}q") / n - diff(c) * diff(c), F.lit(0.0)) / n)
    ready = (n >= least_rows) & (F.col("days") >= least_days) & (diff("b") - half("b") <= 0) & (diff("l") - half("l") <= 0)
    return whole.select(
        F.coalesce("n", F.lit(0)).alias("n"), "days", (F.col("b0") / n).alias("brier"), (F.col("b1") / n).alias("challenger_brier"), (F.col("l0") / n).alias("log_loss"), (F.col("l1") / n).alias("challenger_log_loss"),
        diff("b").alias("brier_difference"), half("b").alias("brier_half_width"), diff("l").alias("log_loss_difference"), half("l").alias("log_loss_half_width"), F.coalesce(ready, F.lit(False)).alias("ready"),
    )
