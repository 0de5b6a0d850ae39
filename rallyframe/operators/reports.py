"""Reports in one or two aggregations: group metrics, comparisons, bootstraps, profiles, audits and gaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions.stats import wilson


def group_metrics(df: DataFrame, by: list[str], p: Column, y: Column, least: int = 50) -> DataFrame:
    """n, accuracy, Brier score and mean confidence of groups with at least ``least`` rows."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(((p >= 0.5) == (y == 1)).cast("double")), 6).alias("accuracy"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg(F.greatest(p, 1 - p)), 6).alias("confidence"))
    return out.where(F.col("n") >= least)


def slices(df: DataFrame, dimensions: list[str], won: Column, stake: Column, odds: Column) -> DataFrame:
    """Bets, hit rate and profit of the whole, of every value of each dimension, and of every combination of the first two."""
    rows = df.withColumns({"__won": won.cast("double"), "__profit": F.when(won, stake * (odds - 1)).otherwise(-stake)})
    sets = [[], *[[d] for d in dimensions], dimensions[:2]]
    out = rows.groupingSets([[F.col(d) for d in s] for s in sets], *dimensions).agg(F.count("*").alias("n"), F.round(F.avg("__won"), 6).alias("hit_rate"), F.round(F.sum("__profit"), 4).alias("profit"), F.grouping_id(*dimensions).alias("level"))
    return out.select(*dimensions, "n", "hit_rate", "profit", F.col("level").cast("int").alias("level"))


def per_side(df: DataFrame, keys: list[str], side: Column, won: Column, valid: Column) -> DataFrame:
    """Points and points won of each side, and points that count for none."""
    def count(which: int, also: Column | None = None) -> Column:
        ok = valid & (side == which)
        return F.count_if(ok if also is None else ok & also)

    return df.groupBy(*keys).agg(count(1).alias("p1_points"), count(1, won).alias("p1_won"), count(2).alias("p2_points"), count(2, won).alias("p2_won"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))


def totals_agree(detail: DataFrame, summary: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Adds agrees to ``summary``: whether every total, computed again from the detail, equals its column (to six places)."""
    made = detail.groupBy(*keys).agg(*[c.alias(f"__{name}") for name, c in totals.items()])
    out = summary.join(made, keys, "left")
    same = F.lit(True)
    for name in totals:
        same = same & F.coalesce(F.abs(F.col(name) - F.col(f"__{name}")) < 1e-6, F.lit(False))
    return out.withColumn("agrees", same).drop(*[f"__{name}" for name in totals])


def most_common(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equal ones that seen first by ``order``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "__first", value)).alias("__b"))
    return best.select(*keys, F.col(f"__b.{value}").alias(value), (-F.col("__b.m")).alias("n"))


def paired_difference(df: DataFrame, by: list[str], a: Column, b: Column, least: int = 30) -> DataFrame:
    """n, mean difference and its normal interval (null below ``least`` rows)."""
    out = df.groupBy(*by).agg(F.count(a - b).alias("n"), F.avg(a - b).alias("m"), F.stddev_samp(a - b).alias("s"))
    half = F.when(F.col("n") >= least, 1.96 * F.col("s") / F.sqrt("n"))
    return out.select(*by, "n", F.round("m", 6).alias("difference"), F.round(F.col("m") - half, 6).alias("low"), F.round(F.col("m") + half, 6).alias("high"))


def cluster_bootstrap(df: DataFrame, cluster: str, a: Column, b: Column, repetitions: int = 200, seed: str = "s") -> DataFrame:
    """One row (clusters, difference, low, high): a mean difference with a bootstrap over whole clusters.

    Rows are summed per cluster first; each cluster then weighs a Poisson(1) number in each repetition, drawn from a digest
    of its name, so reruns agree and no task holds more than its clusters.
    """
    per = df.groupBy(cluster).agg(F.sum(a - b).alias("x"), F.count(a - b).cast("double").alias("n"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("r"), F.col(cluster).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    out = F.lit(0)
    for k in range(8):
        out = F.when(draw >= sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)), F.lit(k + 1)).otherwise(out)
    runs = per.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("w", out).groupBy("r").agg((F.sum(F.col("w") * F.col("x")) / F.sum(F.col("w") * F.col("n"))).alias("d"))
    spread = runs.agg(F.percentile("d", [0.025, 0.975]).alias("q"))
    whole = per.agg(F.count("*").alias("clusters"), (F.sum("x") / F.sum("n")).alias("d"))
    return whole.join(F.broadcast(spread)).select("clusters", F.round("d", 6).alias("difference"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, fingerprint): a digest of a set of rows that no order changes. Rows' digests are summed in two halves, so nothing is gathered."""
    d = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    half = lambda at: F.sum(F.conv(F.substring(d, at, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = df.agg(F.count("*").alias("n"), half(1).alias("a"), half(9).alias("b"))
    return sums.select("n", F.sha2(F.concat_ws("|", "n", "a", "b"), 256).alias("fingerprint"))


def flat_stakes(df: DataFrame, by: list[str], p: Column, won: Column, odds: Column, small: int = 100) -> DataFrame:
    """Published, settled, wins, yield, mean confidence, observed less predicted rate, Brier score and whether the sample is small. won is null while open."""
    y = won.cast("double")
    live = won.isNotNull()
    out = df.groupBy(*by).agg(
        F.count("*").alias("published"), F.count_if(live).alias("settled"), F.count_if(won).alias("wins"), F.avg(F.when(won, odds - 1).when(live, -1.0)).alias("y"),
        F.avg(F.when(live, p)).alias("c"), F.avg(y).alias("o"), F.avg(F.when(live, (p - y) * (p - y))).alias("b"),
    )
    return out.select(*by, "published", "settled", "wins", F.round("y", 6).alias("yield"), F.round("c", 6).alias("confidence"), F.round(F.col("o") - F.col("c"), 6).alias("gap"), F.round("b", 6).alias("brier"), (F.col("settled") < small).alias("small_sample"))


def input_diagnostics(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """Per group and feature: finite rows, least and greatest value, rows that are not 0, population variance, and dead (fewer than two values)."""
    inf = F.lit(float("inf"))
    long = df.unpivot(by, [F.col(c).cast("double").alias(c) for c in features], "feature", "x").where("x is not null").where(~F.isnan("x") & (F.abs("x") < inf))
    out = long.groupBy(*by, "feature").agg(F.count("*").alias("finite"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.count_if(F.col("x") != 0).alias("nonzero"), F.round(F.var_pop("x"), 4).alias("variance"))
    return out.withColumn("dead", F.col("least") == F.col("greatest"))


def profile(df: DataFrame, keys: list[str], value: str, kind: str) -> DataFrame:
    """n, mean, median and 90th percentile (interpolated) of a value, and the entropy in bits of a kind."""
    main = df.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.5), 6).alias("median"), F.round(F.percentile(value, 0.9), 6).alias("p90"))
    kinds = df.groupBy(*keys, kind).agg(F.count("*").alias("c"))
    bits = kinds.groupBy(*keys).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h"))
    return main.join(bits.select(*keys, F.round("h", 6).alias("entropy")), keys)


def what_if(df: DataFrame, won: Column, profit: Column, rules: dict[str, Column]) -> DataFrame:
    """Per rule that keeps rows: removed, losses prevented, wins given up and the change of the yield. One pass."""
    found = []
    for name, keep in rules.items():
        k = F.coalesce(keep, F.lit(False))
        found.append(F.struct(F.lit(name).alias("rule"), F.count_if(~k).alias("removed"), F.count_if(~k & ~won).alias("losses_prevented"), F.count_if(~k & won).alias("wins_given_up"), F.round(F.avg(F.when(k, profit)) - F.avg(profit), 6).alias("yield_change")))
    return df.agg(F.array(*found).alias("r")).select(F.inline("r"))


def funnel(df: DataFrame, value: Column, floors: list[float], gates: dict[str, Column]) -> DataFrame:
    """(floor, gate, left): rows at or above each floor that pass the gates up to each one, in order. One pass."""
    found = []
    for floor in floors:
        passed = value >= floor
        for at, (name, gate) in enumerate({"floor": F.lit(True), **gates}.items()):
            passed = passed & gate
            found.append(F.struct(F.lit(float(floor)).alias("floor"), F.lit(at).alias("place"), F.lit(name).alias("gate"), F.count_if(passed).alias("left")))
    return df.agg(F.array(*found).alias("r")).select(F.inline("r"))


def calendar_gaps(df: DataFrame, day: str) -> DataFrame:
    """Days without rows between the first and the last day."""
    days = df.select(F.to_date(day).alias("day")).distinct()
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("day")).join(days, "day", "left_anti")


def thin_years(df: DataFrame, day: str, share: float = 0.5, least_days: int = 14) -> DataFrame:
    """(year, days, span, suspicious): years of which fewer than ``share`` of the days from first to last have rows, if there are enough."""
    per = df.select(F.to_date(day).alias("d")).distinct().groupBy(F.year("d").alias("year")).agg(F.count("*").alias("days"), (F.date_diff(F.max("d"), F.min("d")) + 1).alias("span"))
    return per.withColumn("suspicious", (F.col("span") >= least_days) & (F.col("days") < share * F.col("span")))


def key_inventory(df: DataFrame, json: str) -> DataFrame:
    """(key, n): how often each key of a JSON object occurs."""
    return df.select(F.explode(F.json_object_keys(json)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def pooled_rates(df: DataFrame, score: Column, y: Column, bins: int = 20, least: int = 60) -> DataFrame:
    """Isotonic calibration: (score, rate) of bins of equal width with enough rows, Beta(2, 2) rates, neighbours pooled until rates rise.

    Counts per bin are at most ``bins`` rows; pooling is the max-min of weighted means, a self-join of those.
    """
    at = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
    per = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.sum(y).alias("y")).where(F.col("n") >= least)
    points = per.agg(F.sort_array(F.collect_list(F.struct("bin", "n", "s", ((F.col("y") + 2) / (F.col("n") + 4)).alias("r")))).alias("p"))
    mean = lambda p, i, j: F.aggregate(F.slice(p, i, j - i + 1), F.lit(0.0), lambda a, x: a + x["n"] * x["r"]) / F.aggregate(F.slice(p, i, j - i + 1), F.lit(0.0), lambda a, x: a + x["n"])
    k = lambda p: F.size(p)
    fitted = F.transform(F.sequence(F.lit(1), k(F.col("p"))), lambda m: F.struct(
        F.element_at("p", m)["bin"].alias("bin"), F.element_at("p", m)["s"].alias("score"),
        F.array_max(F.transform(F.sequence(F.lit(1), m), lambda i: F.array_min(F.transform(F.sequence(m, k(F.col("p"))), lambda j: mean(F.col("p"), i, j))))).alias("rate"),
    ))
    return points.where(F.size("p") > 0).select(F.inline(fitted))


def with_interval(df: DataFrame, by: list[str], won: Column) -> DataFrame:
    """n, wins, rate and its Wilson interval."""
    out = df.groupBy(*by).agg(F.count(won).alias("n"), F.count_if(won).alias("wins"))
    low, high = wilson(F.col("wins"), F.col("n"))
    return out.select(*by, "n", "wins", F.round(F.try_divide("wins", "n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def best_window(df: DataFrame, least: int = 30) -> DataFrame:
    """Of trailing windows (days, n, mean_value) the best mean among those with enough rows, else the one with most rows."""
    enough = F.col("n") >= least
    rank = F.struct(enough.alias("e"), F.when(enough, F.col("mean_value")).otherwise(F.col("n")).alias("v"), (-F.col("days")).alias("d"))
    return df.agg(F.max_by(F.struct("days", "n", "mean_value"), rank).alias("b")).select("b.*")


def signal_split(df: DataFrame, day: str, certified: Column, quote: Column, start: Column) -> DataFrame:
    """Rows with a certified quote before the start, by whole days in 60, 20 and 20 percent of the days."""
    from rallyframe.operators.history import split_by_day

    return split_by_day(df.where(certified & (quote < start)), day, 0.6, 0.2)


def running_positions(df: DataFrame, day: str, order: list[Column], id_col: str) -> DataFrame:
    """Adds place within the day and repeated: whether the id has an earlier place that day."""
    w = Window.partitionBy(day).orderBy(*order)
    placed = df.withColumn("place", F.row_number().over(w))
    return placed.withColumn("repeated", F.row_number().over(Window.partitionBy(day, id_col).orderBy("place")) > 1)
