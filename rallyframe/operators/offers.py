"""Published offers: KPI scans, daily snapshots with digests, feeds, accounting audits, rolling counts and rules over markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kpis(rows: DataFrame, identity: list[str], issued: str, time: str, now: Column, days: list[int], categories: dict[str, Column], outcome: Column, odds: Column) -> DataFrame:
    """Per category and period: wins, losses, voids, sample, hit_rate, avg_odds, staked, profit and roi.

    outcome: win, loss, void or null (pending: left out). days: periods back from ``now``; a further period ``all`` has every
    row. Of rows of one identity the earliest issued counts (one never issued last), within each category and period. Stakes
    are one unit where odds are above 1. One pass: each row goes to the categories and periods that hold it.
    """
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) / 86_400_000_000
    held = F.array_compact(F.array(F.lit("all"), *[F.when((age <= d) & (age >= 0), F.lit(str(d))) for d in days]))
    named = F.array_compact(F.array(*[F.when(fits, F.lit(name)) for name, fits in categories.items()]))
    each = rows.where(outcome.isNotNull()).select(*identity, F.col(issued).alias("__issued"), outcome.alias("__o"), odds.cast("double").alias("__q"), F.explode(named).alias("category"), held.alias("__held"))
    each = each.withColumn("period", F.explode("__held"))
    first = F.min(F.struct(F.col("__issued").isNull().alias("never"), F.col("__issued").alias("at"), F.col("__o").alias("o"), F.col("__q").alias("q")))
    unique = each.groupBy("category", "period", *identity).agg(first.alias("f")).select("category", "period", "f.o", "f.q")
    decided, priced = F.col("o").isin("win", "loss"), F.coalesce(F.col("q") > 1, F.lit(False))
    gain = F.when(decided & priced, F.when(F.col("o") == "win", F.col("q") - 1).otherwise(-1.0))
    out = unique.groupBy("category", "period").agg(
        F.count_if(F.col("o") == "win").alias("wins"), F.count_if(F.col("o") == "loss").alias("losses"), F.count_if(F.col("o") == "void").alias("voids"),
        F.avg(F.when(decided & priced, F.col("q"))).alias("avg_odds"), F.count(gain).alias("staked"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("profit"),
    )
    sample = F.col("wins") + F.col("losses")
    return out.withColumns({"sample": sample, "hit_rate": F.try_divide("wins", sample), "roi": F.try_divide("profit", "staked")})


def betting_day(time: Column, zone: str, start_hour: int) -> Column:
    """The day that holds a UTC time where days begin at ``start_hour`` of a zone's clock."""
    local = F.from_utc_timestamp(time, zone)
    return F.to_date(local - F.make_interval(hours=F.lit(start_hour)))


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def offer_digests(rows: DataFrame, day: str, section: str, columns: list[str]) -> DataFrame:
    """Per day and section: n and a digest of the set of rows, whatever their order: 256 bits made of sums of the parts of the rows' own digests, so no section is gathered. Repeated rows count as often as they come."""
    mark = row_digest(columns)
    parts = [F.sum(F.conv(F.substring(mark, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"p{k}") for k in range(8)]
    per = rows.groupBy(day, section).agg(F.count("*").alias("n"), *parts)
    return per.select(day, section, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[f"p{k}" for k in range(8)]), 256).alias("digest"))


def feed(upcoming: DataFrame, ledger: DataFrame, key: str, time: str, now: Column, horizon_hours: int, payload: list[str]) -> DataFrame:
    """One row for each served event: key, part (upcoming, live or result), time and its payload as JSON, the ledger's outcome in it.

    upcoming rows are served from now to the horizon; rows of the ledger without an outcome that have begun are live; settled ones are results.
    An event in both is served once, from the ledger once it has begun.
    """
    ahead = (F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) / 3600
    book = ledger.select(key, F.col("outcome").alias("__outcome"), F.lit(True).alias("__in"))
    met = upcoming.join(book, key, "left")
    part = F.when(F.col("__outcome").isNotNull(), "result").when((ahead > 0) & (ahead <= horizon_hours), "upcoming").when((ahead <= 0) & F.col("__in"), "live")
    rows = met.withColumn("part", part).where("part is not null")
    return rows.select(key, "part", F.col(time), F.to_json(F.struct(*payload, F.col("__outcome").alias("outcome"))).alias("payload"))


def accounting_audit(rows: DataFrame, key: str, issued: str, start: str, outcome: str, odds: str, stake: str, profit: str, tolerance: float = 1e-9) -> DataFrame:
    """(status, n, profit): what an audit of settled publications finds, each key once.

    Statuses: missing_key, conflicting (a key with different contents), unissued, late (not issued before the start), void, pending,
    unpriced (no odds above 1), mismatch (stake not 1, or profit not what odds and outcome give), verified. Further rows of a
    key that are identical count as identical_duplicate.
    """
    whole = F.xxhash64(*[c for c in (issued, start, outcome, odds, stake, profit)])
    content = F.struct(*[F.col(c).alias(n) for c, n in ((issued, "i"), (start, "s"), (outcome, "o"), (odds, "q"), (stake, "k"), (profit, "p"))])
    per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), F.count_distinct(whole).alias("__k"), F.min(content).alias("r"))
    expected = F.when(F.col("r.o") == "win", F.col("r.q") - 1).otherwise(-1.0)
    sound = F.coalesce((F.col("r.k") == 1) & (F.abs(F.col("r.p") - expected) <= tolerance), F.lit(False))
    status = (
        F.when(F.col("__k") > 1, "conflicting").when(F.col("r.i").isNull(), "unissued").when(~F.coalesce(F.col("r.i") < F.col("r.s"), F.lit(False)), "late").when(F.col("r.o") == "void", "void")
        .when(~F.coalesce(F.col("r.o").isin("win", "loss"), F.lit(False)), "pending").when(~F.coalesce(F.col("r.q") > 1, F.lit(False)), "unpriced").when(~sound, "mismatch").otherwise("verified")
    )
    judged = per.select(status.alias("status"), F.when(F.col("__k") == 1, F.col("__n") - 1).otherwise(0).alias("again"), F.when(status == "verified", expected).alias("gain"))
    named = judged.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("gain"), F.lit(0.0)).alias("profit"))
    extra = judged.agg(F.sum("again").alias("n")).where("n > 0").select(F.lit("identical_duplicate").alias("status"), "n", F.lit(0.0).alias("profit"))
    lost = rows.where(F.col(key).isNull()).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("missing_key").alias("status"), "n", F.lit(0.0).alias("profit"))
    return named.unionByName(extra).unionByName(lost)


def rolling_days(events: DataFrame, user: str, event_id: str, day: Column, today: Column, windows: list[int]) -> DataFrame:
    """Per user: how many different events lie within the last d days up to today, for each window d (1: today only). An event sent twice counts once."""
    once = events.select(user, event_id, day.alias("__d")).where(F.col(user).isNotNull()).dropDuplicates([event_id])
    age = F.date_diff(today, F.col("__d"))
    return once.groupBy(user).agg(*[F.count_if((age >= 0) & (age < d)).alias(f"days_{d}") for d in windows])


def due(marker_time: Column, attempts: Column, now: Column, cooldown_hours: list[int]) -> Column:
    """Whether a retry is due: never tried, or the cooldown after so many attempts (the last one for more) has passed."""
    waits = F.lit(cooldown_hours)
    wait = F.get(waits, F.least(F.greatest(F.coalesce(attempts, F.lit(1)), F.lit(1)), F.lit(len(cooldown_hours))) - 1)
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(marker_time.cast("timestamp"))) / 3600
    return F.when(marker_time.isNull(), True).otherwise(age >= wait)


def successors(snapshots: DataFrame, key: str, order: list[str], version: str, digest: str) -> DataFrame:
    """Adds verdict to each snapshot in order of arrival: accepted (newer than all before it), repeated (the newest version so far with the same digest), conflict (with another), regressed (an older version).

    A rejected snapshot changes nothing for later ones: what counts is the greatest version so far and its first digest.
    """
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(version).over(before)
    first = F.max_by(F.col(digest), F.struct(F.col(version), -F.col("__at"))).over(before)
    numbered = snapshots.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    verdict = F.when(top.isNull() | (F.col(version) > top), "accepted").when(F.col(version) < top, "regressed").when(F.col(digest).eqNullSafe(first), "repeated").otherwise("conflict")
    return numbered.withColumn("verdict", verdict).drop("__at")


def lifecycle(users: DataFrame, actions: DataFrame, user: str, last_seen: str, today: Column, steps: list[tuple[str, int]]) -> DataFrame:
    """(user, action, idle_days): the furthest step whose days a user has been idle for, unless ``actions`` (user, action, since) has it since they were last seen."""
    idle = F.date_diff(today, F.col(last_seen))
    step = F.coalesce(*[F.when(idle >= d, F.lit(name)) for name, d in sorted(steps, key=lambda s: -s[1])])
    found = users.select(user, F.col(last_seen).alias("__seen"), idle.alias("idle_days"), step.alias("action")).where("action is not null")
    done = actions.groupBy(user, "action").agg(F.max("since").alias("__since"))
    return found.join(done, [user, "action"], "left").where(F.col("__since").isNull() | (F.col("__since") < F.col("__seen"))).select(user, "action", "idle_days")
