"""Comparisons of two sets of predictions: ROC-AUC, exact McNemar test, row bootstrap, permutation sensitivity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.ranges import running
from rallyframe.plans.scratch import stash

#: The coefficients of the asymptotic series of ln n! after n ln n - n + ln(2 pi n) / 2, by odd powers of 1 / n.
SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def roc_auc(df: DataFrame, p: Column, y: Column) -> DataFrame:
    """One row (n, positives, auc): the share of pairs of a positive and a negative row with the positive one scored higher, ties half; null with one class only.

    Rows with a null score or label are left out. Scores are counted first, so ties and repeated scores are one row each.
    """
    rows = df.select(p.cast("double").alias("score"), y.cast("int").alias("y")).where("score IS NOT NULL AND y IS NOT NULL")
    per = stash(rows.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")), "scores")
    met = running(per, "score", ["neg"]).agg(
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(F.col("pos").cast("decimal(38,0)") * 2 * F.col("before_neg") + F.col("pos").cast("decimal(38,0)") * F.col("neg")).alias("twice"),
    )
    return met.select("n", "positives", (F.try_divide(F.col("twice").cast("double"), F.col("positives").cast("double") * F.col("negatives") * 2)).alias("auc"))


def log_factorial(n: Column) -> Column:
    """ln n! to about 1e-13: the asymptotic series from 20 on, below it by way of n + 20."""
    n = n.cast("double")
    far = F.when(n < 20, n + 20).otherwise(n)
    series = (far + 0.5) * F.ln(far) - far + F.lit(0.5) * F.ln(2 * F.pi())
    for k, c in enumerate(SERIES):
        series += c / F.pow(far, F.lit(2.0 * k + 1))
    lower = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda total, k: total + F.ln(n + k))
    return F.when(n < 20, series - lower).otherwise(series)


def mcnemar_p(only_a: Column, only_b: Column) -> Column:
    """The exact two-sided p-value of ``only_a`` successes of all discordant rows at one half; 1 without any.

    The tail is summed from its largest term, each next one a ratio of the last.
    """
    n, low = only_a + only_b, F.least(only_a, only_b).cast("long")
    largest = F.exp(log_factorial(n) - log_factorial(low) - log_factorial(n - low) - n * F.ln(F.lit(2.0)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] * k / (n - k + 1)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    # beyond so many terms below a mean of n / 2 they are under 1e-18 of the sum
    steps = F.least(low, F.lit(60) + 12 * F.ceil(F.sqrt(n.cast("double"))))
    down = F.when(steps > 0, F.sequence(low, low - steps + 1, F.lit(-1))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(down, start, add)["sum"] * largest
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.when(only_a == only_b, F.lit(1.0)).otherwise(2 * tail)))


def compared(df: DataFrame, by: list[str], y: Column, new: Column, old: Column) -> DataFrame:
    """Per group: n, the rows that only one of two predictions gets right at one half, and the exact p-value."""
    new_right, old_right = (new >= 0.5) == (y == 1), (old >= 0.5) == (y == 1)
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(new_right & ~old_right).alias("new_only"), F.count_if(old_right & ~new_right).alias("old_only"))
    return counts.withColumn("p_value", mcnemar_p(F.col("new_only"), F.col("old_only")))


def draw_bits(key: Column, rounds: int, seed: int) -> Column:
    """32 bits for each of so many rounds: the digests of the key, eight rounds to a digest, one after the other."""
    return F.unhex(F.concat(*[F.sha2(F.concat_ws(":", F.lit(f"{seed}:{k}"), key.cast("string")), 256) for k in range(-(-rounds // 8))]))


def _poisson_steps() -> list[int]:
    """The least 32-bit numbers that give 1, 2, ... by inverting the cumulative Poisson(1) distribution."""
    below, term, out = 0.0, 0.36787944117144233, []
    for k in range(1, 13):
        below += term
        term /= k
        out.append(math.ceil(below * 2**32))
    return out


def _drawn(batches: Iterator[pd.DataFrame], rounds: int) -> Iterator[pd.DataFrame]:
    """Sums over a task's rows (v, bits), one row a round: values and rows as drawn, and values and rows as they are."""
    steps, x, w, total, n = _poisson_steps(), np.zeros(rounds), np.zeros(rounds, np.int64), 0.0, 0
    for batch in batches:
        values = batch["v"].to_numpy(np.float64)
        bits = np.frombuffer(b"".join(batch["bits"]), ">u4").reshape(len(values), -1)[:, :rounds].astype(np.uint32)
        k = np.zeros(bits.shape, np.uint8)
        for step in steps:
            k += bits >= np.uint32(step)
        x, w, total, n = x + values @ k, w + k.sum(axis=0, dtype=np.int64), total + values.sum(), n + len(values)
    if n:
        yield pd.DataFrame({"round": np.arange(rounds), "x": x, "w": w, "total": total, "n": n})


def row_bootstrap(df: DataFrame, key: Column, value: Column, rounds: int = 200, seed: int = 1) -> DataFrame:
    """One row (n, mean, low, high): the mean of ``value`` and the 2.5 % and 97.5 % points of its bootstrap means.

    Every row draws for itself how often each round takes it (Poisson(1)), so one pass sums all rounds and nothing is
    resampled by place; the draws follow from the row's key and the seed. A task keeps one sum a round, and only these meet.
    """
    rows = df.select(value.cast("double").alias("v"), draw_bits(key, rounds, seed).alias("bits")).where("v IS NOT NULL")
    sums = rows.mapInPandas(lambda it: _drawn(it, rounds), "round int, x double, w long, total double, n long")
    per = sums.groupBy("round").agg(F.sum("x").alias("x"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("m"))
    return per.agg(F.max("n").alias("n"), F.max("m").alias("mean"), F.percentile(F.try_divide("x", "w"), F.lit(0.025)).alias("low"), F.percentile(F.try_divide("x", "w"), F.lit(0.975)).alias("high"))


def numbered(df: DataFrame, group: str, order: list[Column], name: str, slot: Column, slots: int) -> DataFrame:
    """Adds ``name``: the row's number from 0 within its group by slot, then ``order``. A group is numbered slot by slot, so a large one is split."""
    cut = df.withColumn("__slot", F.pmod(slot, F.lit(slots)))
    sizes = cut.groupBy(group, "__slot").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.partitionBy(group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(group, "__slot").orderBy(*order)) - 1
    return cut.withColumn("__own", own).join(sizes.select(F.col(group).alias("__g"), F.col("__slot").alias("__s"), before.alias("__first")), (F.col(group).eqNullSafe(F.col("__g"))) & (F.col("__slot") == F.col("__s"))).withColumn(name, F.col("__first") + F.col("__own")).drop("__slot", "__own", "__g", "__s", "__first")


def permuted(df: DataFrame, group: str, key: str, values: list[str], seed: int = 1, slots: int = 16) -> DataFrame:
    """Adds <value>_permuted: each value of another row of the group, by a permutation that follows from key and seed.

    Two numberings of the same rows, one by a hash of the key and one by a hash of key and value's name, are joined by number.
    """
    mark = lambda name: F.sha2(F.concat_ws(":", F.lit(f"{seed}:{name}"), F.col(key).cast("string")), 256)
    at = lambda m: F.conv(F.substring(m, 1, 7), 16, 10).cast("long")
    out = df
    for name in values:
        own = numbered(out, group, [mark(""), F.col(key)], "__at", at(mark("")), slots)
        other = numbered(df.select(group, key, F.col(name).alias(f"{name}_permuted")), group, [mark(name), F.col(key)], "__from", at(mark(name)), slots)
        other = other.select(F.col(group).alias("__group"), "__from", f"{name}_permuted")
        out = own.join(other, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__at") == F.col("__from"))).drop("__at", "__group", "__from")
    return out
