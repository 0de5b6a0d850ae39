"""Upkeep of stored rows: projections, enrichment within tolerances, consistency of parts and totals, pruning, settlement, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stored(df: DataFrame, lower: list[str], texts: list[str], nested: list[str]) -> DataFrame:
    """Rows as they are stored: ``lower`` trimmed and in lower case, missing ``texts`` as empty ones, ``nested`` as JSON with ``{}`` for null. Other columns stay."""
    made = {c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in lower}
    made |= {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts}
    made |= {c: F.coalesce(F.to_json(F.col(c)), F.lit("{}")) for c in nested}
    return df.withColumns(made)


def enriched(canonical: DataFrame, incoming: DataFrame, key: str, tolerances: dict[str, float]) -> DataFrame:
    """``canonical`` with its null cells filled from ``incoming`` (one row a key), and filled and conflicts: how many cells of a row were filled, and how many differ by more than their column's tolerance.

    A cell that is there stays, also where the incoming one is more precise; values that are not finite count as missing.
    """
    sound = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    new = incoming.groupBy(key).agg(*[F.first(sound(F.col(c).cast("double")), True).alias(f"__{c}") for c in tolerances])
    met = canonical.join(new, key, "left")
    own = {c: sound(F.col(c).cast("double")) for c in tolerances}
    count = lambda conditions: sum((F.when(x, 1).otherwise(0) for x in conditions), F.lit(0))
    filled = count(own[c].isNull() & F.col(f"__{c}").isNotNull() for c in tolerances)
    conflicts = count(F.abs(own[c] - F.col(f"__{c}")) > t for c, t in tolerances.items())
    return met.withColumns({"filled": filled, "conflicts": conflicts} | {f"__own_{c}": v for c, v in own.items()}).select(
        *[c for c in canonical.columns if c not in tolerances], *[F.coalesce(f"__own_{c}", f"__{c}").alias(c) for c in tolerances], "filled", "conflicts"
    )


def consistent(parts: DataFrame, totals: DataFrame, keys: list[str], counts: list[str], whole: str) -> DataFrame:
    """(keys, parts, reason): whether the parts of each key add up. Reasons: part (a part's ``counts`` do not sum to its ``whole``), total (the sums differ from the key's total row), no_total, null where all is consistent.

    Negative or missing numbers make a part inconsistent.
    """
    wrong = F.lit(False)
    for c in (*counts, whole):
        wrong = wrong | F.col(c).isNull() | (F.col(c) < 0)
    wrong = wrong | (sum((F.col(c) for c in counts), F.lit(0)) != F.col(whole))
    sums = parts.groupBy(*keys).agg(F.count("*").alias("parts"), F.max(F.coalesce(wrong, F.lit(True))).alias("__wrong"), *[F.sum(c).alias(f"__{c}") for c in (*counts, whole)])
    met = sums.join(totals.select(*keys, F.lit(True).alias("__there"), *[F.col(c).alias(f"__t_{c}") for c in (*counts, whole)]), keys, "left")
    same = F.lit(True)
    for c in (*counts, whole):
        same = same & F.col(f"__{c}").eqNullSafe(F.col(f"__t_{c}"))
    return met.select(*keys, "parts", F.when(F.col("__wrong"), "part").when(F.col("__there").isNull(), "no_total").when(~same, "total").alias("reason"))


def day_projection(rows: DataFrame, items: str, day: Column, excluded: DataFrame, id_field: str) -> DataFrame:
    """The items (an array of structs) of rows, one row each with the row's other columns, of one day and not excluded by id. day: a condition over the item ``item``."""
    each = rows.select(*[c for c in rows.columns if c != items], F.explode(items).alias("item")).where(day)
    return each.withColumn("__id", F.col(f"item.{id_field}")).join(excluded.select(F.col(id_field).alias("__id")).distinct(), "__id", "left_anti").drop("__id")


def overridden(rows: DataFrame, leaders: DataFrame, key: str, columns: list[str], time: str) -> DataFrame:
    """``rows`` with ``columns`` replaced by the latest leader's of the key that are not null, and bridged (whether a leader was found)."""
    last = leaders.groupBy(key).agg(F.max(F.struct(F.col(time).alias("t"), *[F.col(c).alias(c) for c in columns])).alias("__l"))
    met = rows.join(last, key, "left")
    return met.withColumns({"bridged": F.col("__l").isNotNull()} | {c: F.coalesce(F.col(f"__l.{c}"), F.col(c)) for c in columns}).drop("__l")


def pruned(rows: DataFrame, kind: str, time: str, now: Column, hours: dict[str, int], other: int) -> tuple[DataFrame, DataFrame]:
    """Rows within the lifetime of their kind (``other`` for kinds not named; rows without a time are dropped), and (kind, kept, dropped)."""
    life = F.coalesce(*[F.when(F.col(kind) == k, F.lit(h)) for k, h in hours.items()], F.lit(other))
    fresh = F.coalesce(F.unix_seconds(F.col(time).cast("timestamp")) >= F.unix_seconds(now.cast("timestamp")) - life * 3600, F.lit(False))
    return rows.where(fresh), rows.groupBy(kind).agg(F.count_if(fresh).alias("kept"), F.count_if(~fresh).alias("dropped"))


def settled_pairs(pending: DataFrame, results: DataFrame, key: str, time: str, pick: str, hours: int) -> DataFrame:
    """``pending`` with status and correct: a pair of picks settles by the one result of its event within so many hours of its time.

    Statuses: settled, ambiguous (results that differ), void (the result has no winner), pending (none in time). Results are
    reduced to one row an event before they are joined; those out of time for the row do not count.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    near = pending.select(key, F.col(time).alias("__t")).distinct().join(results.select(key, F.col(time).alias("__r"), "winner"), key).where(F.abs(seconds("__t") - seconds("__r")) <= hours * 3600)
    one = near.groupBy(key, "__t").agg(F.count_distinct(F.coalesce("winner", F.lit(""))).alias("__k"), F.max("winner").alias("__w"))
    met = pending.withColumn("__t", F.col(time)).join(one, [key, "__t"], "left")
    status = F.when(F.col("__k").isNull(), "pending").when(F.col("__k") > 1, "ambiguous").when(F.col("__w").isNull(), "void").otherwise("settled")
    return met.withColumns({"status": status, "correct": F.when(status == "settled", F.col(pick) == F.col("__w"))}).drop("__t", "__k", "__w")


def audited(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations, passed): how many rows break each condition; a null condition is a violation. One pass for all checks."""
    counts = df.agg(*[F.count_if(~F.coalesce(holds, F.lit(False))).alias(name) for name, holds in checks.items()])
    found = counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in checks])))
    return found.withColumn("passed", F.col("violations") == 0)


def form_of_events(events: DataFrame, player: str, time: str, id_col: str, completed: Column, won: Column, last: int = 35) -> DataFrame:
    """Per player: n, wins and share of the last ``last`` completed events; events that come twice count once."""
    done = events.where(completed).dropDuplicates([player, id_col])
    newest = Window.partitionBy(player).orderBy(F.desc(time), F.desc(id_col))
    top = done.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= last)
    return top.groupBy(player).agg(F.count("*").alias("n"), F.count_if(won).alias("wins"), F.round(F.avg(won.cast("int")), 6).alias("share"))


def variant_scores(df: DataFrame, by: list[str], y: Column, variants: dict[str, Column], least: int) -> DataFrame:
    """Per variant of a forecast and group: n, brier, log_loss and gap (mean forecast less rate), for groups of at least ``least`` rows; rows lacking any variant or y are left out of all."""
    whole = y.isNotNull()
    for p in variants.values():
        whole = whole & p.isNotNull()
    each = df.where(whole).select(*by, y.alias("__y"), F.inline(F.array(*[F.struct(F.lit(name).alias("variant"), p.cast("double").alias("__p")) for name, p in variants.items()])))
    p, own = F.greatest(F.least(F.col("__p"), F.lit(1 - 1e-15)), F.lit(1e-15)), F.col("__y")
    out = each.groupBy(*by, "variant").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("__p") - own) * (F.col("__p") - own)), 6).alias("brier"), F.round(F.avg(-(own * F.ln(p) + (1 - own) * F.ln(1 - p))), 6).alias("log_loss"), F.round(F.avg("__p") - F.avg(own), 6).alias("gap")
    )
    return out.where(F.col("n") >= least)


def names_alike(a: Column, b: Column, generic: list[str], least: float = 0.86) -> Column:
    """Whether two event names are alike once generic words are left out: one's words are all among the other's, or their texts differ in few letters (1 - edits / length of the longer). Names of generic words only are like nothing."""
    def words(t: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]+", " ")), " "), lambda w: (w != "") & ~w.isin(generic)))

    one, two = words(a), words(b)
    subset = (F.size(F.array_except(one, two)) == 0) | (F.size(F.array_except(two, one)) == 0)
    x, y = F.array_join(one, " "), F.array_join(two, " ")
    return (F.size(one) > 0) & (F.size(two) > 0) & (subset | (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)) >= least))
