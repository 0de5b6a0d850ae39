"""Point-in-time features: everything known before the row's day, or before the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before_day(keys: list[str], day: str, days: int | None = None) -> Window:
    """Rows of the key on earlier days (the day itself is out, so same-day rows don't see each other)."""
    start = Window.unboundedPreceding if days is None else -days
    return Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(start, -1)


def form(df: DataFrame, keys: list[str], day: str, value: Column, prior: float = 0.5, weight: float = 4.0) -> DataFrame:
    """Adds n_before and form: the mean of earlier days' values pulled towards the prior."""
    w = before_day(keys, day)
    n, total = F.count(value).over(w), F.coalesce(F.sum(value).over(w), F.lit(0.0))
    return df.withColumn("n_before", n).withColumn("form", F.round((prior * weight + total) / (weight + n), 6))


def recent(df: DataFrame, keys: list[str], day: str, id_col: str, columns: list[str], last: int = 80, horizon: int = 400) -> DataFrame:
    """One row for each key and day at hand: recent, the key's last ``last`` rows of earlier days within ``horizon`` days, as structs (d, i, columns) in order.

    A day's last rows are gathered first (no more of them can count), and a day looks back over as many of the key's days, so
    work is linear in a key's days however many rows they have. What is made of a history is joined back by key and day.
    """
    at = F.unix_date(F.col(day))
    newest = Window.partitionBy(*keys, day).orderBy(F.desc(id_col))
    rows = df.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= last)
    days = rows.groupBy(*keys, day).agg(F.sort_array(F.collect_list(F.struct(at.alias("d"), F.col(id_col).alias("i"), *columns))).alias("__rows"))
    before = F.flatten(F.collect_list("__rows").over(Window.partitionBy(*keys).orderBy(at).rowsBetween(-last, -1)))
    near = F.filter(before, lambda r: r["d"] >= at - horizon)
    return days.withColumn("recent", near).select(*keys, day, F.slice("recent", F.greatest(F.size("recent") - last, F.lit(0)) + 1, F.lit(last)).alias("recent"))


def decayed(history: Column, today: Column, value: str, half_life: float, prior: float | None = None, prior_weight: float = 0.0, only: Callable[[Column], Column] | None = None) -> Column:
    """The mean of a ``recent`` history's values, each weighing 2^(-age / half_life), with a prior of so much weight; null if there is neither.

    Ages count from the row's own day, so no date is too old or too late. only: which rows count.
    """
    rows = F.filter(history, lambda r: r[value].isNotNull() & (F.lit(True) if only is None else only(r)))
    weight = lambda r: F.pow(F.lit(2.0), -(F.unix_date(today) - r["d"]) / half_life)
    start = F.lit(0.0 if prior is None else prior * prior_weight), F.lit(0.0 if prior is None else float(prior_weight))
    total = F.aggregate(rows, start[0], lambda a, r: a + weight(r) * r[value].cast("double"))
    return F.try_divide(total, F.aggregate(rows, start[1], lambda a, r: a + weight(r)))


def decayed_moments(history: Column, today: Column, value: str, half_life: float) -> Column:
    """A struct (n, ess, mean, variance): decayed mean and population variance of a ``recent`` history, and its effective size."""
    rows = F.filter(history, lambda r: r[value].isNotNull())
    weighed = F.transform(rows, lambda r: F.struct(F.pow(F.lit(2.0), -(F.unix_date(today) - r["d"]) / half_life).alias("w"), r[value].cast("double").alias("x")))
    start = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("w", "ww", "wx")])
    add = lambda a, r: F.struct((a["n"] + 1).alias("n"), (a["w"] + r["w"]).alias("w"), (a["ww"] + r["w"] * r["w"]).alias("ww"), (a["wx"] + r["w"] * r["x"]).alias("wx"))

    def finish(a: Column) -> Column:
        mean = F.try_divide(a["wx"], a["w"])  # of the sums, so cheap to repeat for each row
        off = F.aggregate(weighed, F.lit(0.0), lambda total, r: total + r["w"] * (r["x"] - mean) * (r["x"] - mean))
        return F.struct(a["n"].alias("n"), F.try_divide(a["w"] * a["w"], a["ww"]).alias("ess"), mean.alias("mean"), F.try_divide(off, a["w"]).alias("variance"))

    return F.aggregate(weighed, start, add, finish)


def trailing_counts(df: DataFrame, keys: list[str], day: str, windows: list[int], value: Column) -> DataFrame:
    """Adds n_<d> and sum_<d> for each window of so many days before the row's day; a sum is null without values."""
    made = {}
    for d in windows:
        made |= {f"n_{d}": F.count("*").over(before_day(keys, day, d)), f"sum_{d}": F.round(F.sum(value).over(before_day(keys, day, d)), 6)}
    return df.withColumns(made)


def head_to_head(df: DataFrame, a: str, b: str, day: str, a_won: Column, prior: float = 2.0) -> DataFrame:
    """Adds n_met and advantage: a's share of earlier meetings of the pair, whichever side it stood on, less half; Beta(prior, prior)."""
    low, high = F.least(a, b), F.greatest(a, b)
    pair = df.withColumns({"__lo": low, "__hi": high, "__low_won": F.when(F.col(a) <= F.col(b), a_won).otherwise(~a_won).cast("int")})
    w = before_day(["__lo", "__hi"], day)
    n, wins = F.count("__low_won").over(w), F.coalesce(F.sum("__low_won").over(w), F.lit(0))
    share = (wins + prior) / (n + 2 * prior) - 0.5
    return pair.withColumns({"n_met": n, "advantage": F.round(F.when(F.col(a) <= F.col(b), share).otherwise(0.0 - share), 6)}).drop("__lo", "__hi", "__low_won")


def last_known(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds last_<column>: the last value that is not null in earlier rows. Columns that belong together are passed as one struct."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"last_{c}": F.last(c, ignorenulls=True).over(w) for c in columns})


def running_baseline(df: DataFrame, keys: list[str], day: str, value: Column, weight: Column, least: float) -> DataFrame:
    """Adds baseline: the weighted mean of earlier days, null below a total weight of ``least``. Days are summed first, so a key's window has one row a day."""
    per = df.groupBy(*keys, day).agg(F.sum(value * weight).alias("__x"), F.sum(F.when(value.isNotNull(), weight)).alias("__w"))
    w = before_day(keys, day)
    per = per.select(*keys, day, F.round(F.when(F.sum("__w").over(w) >= least, F.sum("__x").over(w) / F.sum("__w").over(w)), 6).alias("baseline"))
    return df.join(per, [*keys, day])


def running_sums(df: DataFrame, keys: list[str], order: list[str], day: str, value: str, name: str) -> DataFrame:
    """Adds <name>n and <name>x: count and sum of the key's values in earlier rows (by ``order``, which ``day`` never contradicts).

    A key's days are summed and run up first; rows are numbered within a day only, so no task holds more than a key's day.
    """
    days = df.groupBy(*keys, day).agg(F.count(value).alias("__n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("__x"))
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, day, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__x").over(before), F.lit(0.0)).alias("__x0"))
    own = Window.partitionBy(*keys, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumns({"__n1": F.count(value).over(own), "__x1": F.coalesce(F.sum(value).over(own), F.lit(0.0))})
    return within.join(days, [*keys, day]).withColumns({f"{name}n": F.col("__n0") + F.col("__n1"), f"{name}x": F.col("__x0") + F.col("__x1")}).drop("__n0", "__x0", "__n1", "__x1")


def row_index(df: DataFrame, surface: str, venue: str, event: str, order: list[str], value: str, day: str, least: tuple[int, int, int] = (20, 5, 3)) -> DataFrame:
    """Adds baseline (of the surface), venue_index and event_index: means of earlier rows, each null below its least number.

    The venue's rows leave the running event out; indexes are differences to the surface's mean. Row by row, not by day; sums
    run over days first (``running_sums``).
    """
    for name, keys in (("__s", [surface]), ("__v", [surface, venue]), ("__e", [surface, venue, event])):
        df = running_sums(df, keys, order, day, value, name)
    (ns, xs), (nv, xv), (ne, xe) = ((F.col(f"{p}n"), F.col(f"{p}x")) for p in ("__s", "__v", "__e"))
    base = F.when(ns >= least[0], xs / ns)
    found = df.withColumns({"baseline": F.round(base, 6), "venue_index": F.round(F.when(nv - ne >= least[1], (xv - xe) / (nv - ne)) - base, 6), "event_index": F.round(F.when(ne >= least[2], xe / ne) - base, 6)})
    return found.drop("__sn", "__sx", "__vn", "__vx", "__en", "__ex")


def first_and_last_quote(quotes: DataFrame, keys: list[str], time: str, start: str, price: str, early: tuple[int, int] = (36, 2), late_minutes: int = 90) -> DataFrame:
    """Per key the earliest price 2 to 36 hours before the start, the latest within 90 minutes of it, and the value of the early one in percent."""
    ahead = F.unix_seconds(F.col(start).cast("timestamp")) - F.unix_seconds(F.col(time).cast("timestamp"))
    first = F.min_by(F.when((ahead <= early[0] * 3600) & (ahead >= early[1] * 3600), F.col(price)), F.when((ahead <= early[0] * 3600) & (ahead >= early[1] * 3600), F.struct(time, price)))
    last = F.max_by(F.when((ahead > 0) & (ahead <= late_minutes * 60), F.col(price)), F.when((ahead > 0) & (ahead <= late_minutes * 60), F.struct(time, price)))
    out = quotes.groupBy(*keys).agg(first.alias("entry"), last.alias("close"))
    return out.withColumn("clv", F.round(100 * (F.try_divide("entry", "close") - 1), 3))


def day_boundary(df: DataFrame, day: str, share: float = 0.55) -> DataFrame:
    """(day, before, rows): the start of a day at which the rows before it come nearest to ``share`` of all; the earlier of two."""
    per = df.groupBy(day).agg(F.count("*").alias("n"))
    counted = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rows", F.sum("n").over(Window.partitionBy()))
    return counted.where("before > 0").select(day, "before", "rows").orderBy(F.abs(F.col("before") - share * F.col("rows")), day).limit(1)


def folds_by_year(df: DataFrame, year: str, least_train: int, least_test: int = 1) -> DataFrame:
    """(fold, train, test): for each year the rows before it and in it, where both suffice. Years are counted first."""
    per = df.groupBy(F.col(year).alias("fold")).agg(F.count("*").alias("test"))
    before = F.coalesce(F.sum("test").over(Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("train", before).where((F.col("train") >= least_train) & (F.col("test") >= least_test)).select("fold", "train", "test")


def evidence(history: Column, today: Column, half_life: float) -> Column:
    """A struct (n, ess, latest_age) of a ``recent`` history."""
    weights = F.transform(history, lambda r: F.pow(F.lit(2.0), -(F.unix_date(today) - r["d"]) / half_life))
    total = lambda f: F.aggregate(weights, F.lit(0.0), lambda a, w: a + f(w))
    return F.struct(F.size(history).cast("long").alias("n"), F.try_divide(total(lambda w: w) * total(lambda w: w), total(lambda w: w * w)).alias("ess"), (F.unix_date(today) - F.array_max(F.transform(history, lambda r: r["d"]))).alias("latest_age"))


def rest_days(df: DataFrame, keys: list[str], day: str, default: int = 14, most: int = 180) -> DataFrame:
    """Adds rest_days since the key's last earlier day, at most ``most``; ``default`` without one."""
    last = F.max(F.col(day)).over(before_day(keys, day))
    return df.withColumn("rest_days", F.when(last.isNull(), F.lit(default)).otherwise(F.least(F.date_diff(F.col(day), last), F.lit(most))))


def running_best(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return df.withColumn("best_so_far", F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def mid_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds mid_rank: 0 for the least value to 1 for the greatest, ties in the middle; 1 for a single row."""
    w = Window.partitionBy(*keys)
    n, ties = F.count("*").over(w), F.count("*").over(Window.partitionBy(*keys, value))
    return df.withColumn("mid_rank", F.round(F.when(n <= 1, F.lit(1.0)).otherwise((F.rank().over(w.orderBy(value)) - 1 + (ties - 1) / 2) / (n - 1)), 6))


def split_by_day(df: DataFrame, day: str, train: float = 0.7, calibration: float = 0.15) -> DataFrame:
    """Adds part: train, calibration or test by whole days. Days are numbered in a table of their own, one row a day."""
    days = df.select(day).distinct().withColumn("__at", F.row_number().over(Window.orderBy(day))).withColumn("__n", F.count("*").over(Window.partitionBy()))
    part = F.when(F.col("__at") <= F.floor(F.col("__n") * train), "train").when(F.col("__at") <= F.floor(F.col("__n") * (train + calibration)), "calibration").otherwise("test")
    return df.join(days.select(day, part.alias("part")), day)
