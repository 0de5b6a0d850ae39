"""Row rules of one table: swaps and mirrors, gates, quarantines, fills and weights; all but weights are narrow expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def swap_sides(df: DataFrame, pairs: list[tuple[str, str]], stats: str | None = None, when: Column | None = None) -> DataFrame:
    """Each pair of columns changes places, and the keys p1_* and p2_* of the map ``stats``; where ``when`` holds (all rows by default). Its own inverse."""
    on = F.lit(True) if when is None else when
    made = {}
    for a, b in pairs:
        made |= {a: F.when(on, F.col(b)).otherwise(F.col(a)), b: F.when(on, F.col(a)).otherwise(F.col(b))}
    if stats:
        other = lambda k: F.when(k.startswith("p1_"), F.concat(F.lit("p2_"), F.substring(k, 4, 1 << 20))).when(k.startswith("p2_"), F.concat(F.lit("p1_"), F.substring(k, 4, 1 << 20))).otherwise(k)
        made[stats] = F.when(on, F.transform_keys(stats, lambda k, v: other(k))).otherwise(F.col(stats))
    return df.withColumns(made)


def mirrored(df: DataFrame, negate: list[str], complement: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Features seen from the other side: differences change sign, probabilities become 1 - x, pairs change places, the rest stays."""
    made = {c: -F.col(c) for c in negate} | {c: 1 - F.col(c) for c in complement}
    for a, b in pairs:
        made |= {a: F.col(b), b: F.col(a)}
    return df.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in df.columns])


def proven(df: DataFrame, value: str, point_in_time: Column, source: Column, as_of: Column, start: Column) -> DataFrame:
    """``value`` only where it is point in time, has a source and is no younger than the start; adds why_not, the first reason against it."""
    reason = F.when(F.col(value).isNull(), "missing").when(~F.coalesce(point_in_time, F.lit(False)), "not_point_in_time").when(F.coalesce(F.trim(source), F.lit("")) == "", "no_source").when(F.coalesce(as_of > start, F.lit(True)), "too_late")
    return df.withColumn("why_not", reason).withColumn(value, F.when(F.col("why_not").isNull(), F.col(value)))


def priced_well(p: Column, odds: Column, least_odds: float, least_edge: float, least_value: float, inclusive: bool = False) -> Column:
    """Whether odds, edge (p - 1 / odds) and expected value (p * odds - 1) pass; null never does. inclusive: the value may equal its bound."""
    value = p * odds - 1
    ok = (odds >= least_odds) & (p - F.try_divide(F.lit(1.0), odds) >= least_edge) & ((value >= least_value) if inclusive else (value > least_value))
    return F.coalesce(ok, F.lit(False))


def candidate(p: Column, depth: Column, samples: list[Column], least_p: float, least_depth: float, least_sample: int) -> Column:
    """Whether probability, depth and the smallest sample suffice; missing numbers count as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (zero(p) >= least_p) & (zero(depth) >= least_depth) & (F.least(*[zero(s) for s in samples]) >= least_sample)


def integrity_flags(p: Column, odds: Column, quoted: Column, start: Column, evidence: Column, high: float = 0.8, inverted: float = 3.0, least_evidence: int = 5) -> Column:
    """The reasons to set a row apart: a price that contradicts the probability, a quote after the start, confidence without evidence."""
    rules = {"price_inversion": (p >= high) & (odds >= inverted), "post_start_quote": quoted >= start, "unsubstantiated": (p >= high) & (F.coalesce(evidence, F.lit(0)) < least_evidence)}
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), F.isnotnull)


def visible(df: DataFrame, start: str, now: Column, zone: str, day_starts: int = 6, stale_after_h: int = 24, captured: str | None = None) -> DataFrame:
    """Future rows of the same local day and of the same business day (which starts at hour ``day_starts``); adds stale by the time captured."""
    local = lambda c: F.from_utc_timestamp(c.cast("timestamp"), zone)
    business = lambda c: F.to_date(local(c) - F.expr(f"interval {day_starts} hours"))
    t = F.col(start)
    kept = df.where((t > now) & (F.to_date(local(t)) == F.to_date(local(now))) & (business(t) == business(now)))
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(captured or start).cast("timestamp"))
    return kept.withColumn("stale", age > stale_after_h * 3600)


def fill_missing(old: Column, new: Column) -> Column:
    """A map with the entries of ``new`` whose key is missing or null in ``old``; nothing that is there changes."""
    kept = F.map_filter(old, lambda k, v: v.isNotNull())
    return F.map_concat(kept, F.map_filter(new, lambda k, v: v.isNotNull() & ~F.map_contains_key(kept, k)))


def complemented(own: Column, other: Column) -> Column:
    """A rate, or 1 less the other side's rate where that is known and lies in 0 to 1."""
    return F.coalesce(own, F.when(other.between(0, 1), 1 - other))


def sample_weights(df: DataFrame, day: str, today: Column, half_life: float) -> DataFrame:
    """Adds weight: 2^(-age / half_life) over its mean, and ess: the effective number of rows. The sums are one row, joined back."""
    raw = F.pow(F.lit(2.0), -F.date_diff(today, F.col(day)) / half_life)
    sums = df.agg(F.avg(raw).alias("__m"), (F.sum(raw) * F.sum(raw) / F.sum(raw * raw)).alias("ess"))
    return df.join(F.broadcast(sums)).withColumn("weight", raw / F.col("__m")).drop("__m")


def quarantined(df: DataFrame, key: str) -> DataFrame:
    """Adds repeated: whether the key occurs more than once (null keys never do)."""
    again = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
    return df.join(again, key, "left").withColumn("repeated", F.col("__n").isNotNull()).drop("__n")


def settled_once(df: DataFrame, event: str, captured: str, id_col: str) -> DataFrame:
    """Adds kept: whether the row is its event's earliest; the others stay for the record."""
    first = F.row_number().over(Window.partitionBy(event).orderBy(captured, id_col))
    return df.withColumn("kept", first == 1)


def bounded_price(p: Column, low_p: float, high_p: float, high_price: float, low_price: float) -> Column:
    """A price that falls in a line from ``high_price`` at ``low_p`` to ``low_price`` at ``high_p`` and stays there outside."""
    share = (F.greatest(F.least(p, F.lit(high_p)), F.lit(low_p)) - low_p) / (high_p - low_p)
    return high_price + share * (low_price - high_price)


def stepped(x: Column, steps: list[tuple[float, float]], beyond: float) -> Column:
    """The value of the first step whose upper bound is above x, else ``beyond``."""
    out = F.lit(beyond)
    for bound, value in reversed(steps):
        out = F.when(x < bound, F.lit(value)).otherwise(out)
    return F.when(x.isNotNull(), out)


def only_value(value: Column) -> Column:
    """An aggregate: the one value of a group; null if it has several or none."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def banded(x: Column, edges: list[float]) -> Column:
    """The number of the bin [edge, next edge) that holds x, the last closed; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        top = (x <= edges[k + 1]) if k == len(edges) - 2 else (x < edges[k + 1])
        out = F.when((x >= edges[k]) & top, F.lit(k)).otherwise(out)
    return out


def anchored(p: Column, fair: Column, weight: float) -> Column:
    """A market's fair probability and a model's, mixed as logits."""
    logit = lambda q: F.ln(F.greatest(F.least(q, F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least(q, F.lit(1 - 1e-6)), F.lit(1e-6))))
    return 1 / (1 + F.exp(-(weight * logit(fair) + (1 - weight) * logit(p))))


def platt(p: Column, slope: float) -> Column:
    """A probability calibrated on its logit without an intercept, so that p and 1 - p stay complements."""
    return 1 / (1 + F.pow(F.try_divide(1 - p, p), F.lit(slope)))


def interpolated(x: Column, points: list[tuple[float, float]]) -> Column:
    """The line through points (x ascending), flat outside."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x < points[0][0], F.lit(float(points[0][1]))).otherwise(out)


def tree_score(row: dict[str, Column], tree: dict) -> Column:
    """One decision tree as an expression: {"leaf": y} or {"feature", "threshold", "missing_left", "left", "right"}."""
    if "leaf" in tree:
        return F.lit(float(tree["leaf"]))
    x = row[tree["feature"]]
    left, right = tree_score(row, tree["left"]), tree_score(row, tree["right"])
    return F.when(F.coalesce(x <= tree["threshold"], F.lit(bool(tree.get("missing_left", False)))), left).otherwise(right)


def model_score(row: dict[str, Column], model: dict) -> Column:
    """Trees summed and a linear part, mixed as logits and made a probability. model: trees, linear (name -> weight), intercept, blend."""
    trees = sum((tree_score(row, t) for t in model["trees"]), F.lit(0.0))
    linear = sum((w * F.coalesce(row[c], F.lit(0.0)) for c, w in model["linear"].items()), F.lit(float(model["intercept"])))
    return 1 / (1 + F.exp(-(model["blend"] * trees + (1 - model["blend"]) * linear)))
