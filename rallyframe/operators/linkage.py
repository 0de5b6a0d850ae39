"""Linking and merging tables: validated joins, scored candidates, canonical merges, interval joins and conservation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions.text import plain_name
from rallyframe.operators.ranges import numbered
from rallyframe.plans.scratch import sized_join

#: The side on which a row meets the others of its group in ``pairs_in_bucket``.
LEFT, RIGHT, BOTH = 1, 2, 3


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that fails when a key repeats on either side, and never multiplies rows."""
    for side in (left, right):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{keys} repeat")
    return left.join(right, keys, "left")


def routed(new: DataFrame, known: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``new`` with route: new (no such key), matched (equal values) or conflict. known: one row a key."""
    have = known.select(*keys, F.struct(*values).alias("__k"))
    same = F.struct(*values).eqNullSafe(F.col("__k"))
    return new.join(have, keys, "left").withColumn("route", F.when(F.col("__k").isNull(), "new").when(same, "matched").otherwise("conflict")).drop("__k")


def stream_parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(side, n): keys of the first only, of the second only, and of both, repeats counted."""
    counts = a.select(*keys, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*keys, F.lit(0).alias("x"), F.lit(1).alias("y"))).groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    parts = F.array(F.struct(F.lit("first").alias("side"), F.greatest(F.col("x") - F.col("y"), F.lit(0)).alias("n")), F.struct(F.lit("second").alias("side"), F.greatest(F.col("y") - F.col("x"), F.lit(0)).alias("n")), F.struct(F.lit("both").alias("side"), F.least("x", "y").alias("n")))
    return counts.select(F.inline(parts)).groupBy("side").agg(F.sum("n").alias("n"))


def possible_duplicates(new: DataFrame, known: DataFrame, by: list[str], a: str, b: str, time: str, hours: int) -> DataFrame:
    """Rows of ``new`` whose unordered pair has a row in ``known`` within so many hours. Times are cut into steps of that length, so rows meet on equal keys."""
    step = hours * 3600
    pair = lambda df: [F.least(df[a], df[b]), F.greatest(df[a], df[b])]
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    own = seconds(known[time])
    near = known.select(*[known[c].alias(f"__{c}") for c in by], *[c.alias(n) for c, n in zip(pair(known), ("__lo", "__hi"), strict=True)], own.alias("__t"), F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(own / step) + k)).alias("__at"))
    same = [new[c] == F.col(f"__{c}") for c in by] + [c == F.col(n) for c, n in zip(pair(new), ("__lo", "__hi"), strict=True)]
    met = [*same, F.floor(seconds(new[time]) / step) == F.col("__at"), F.abs(seconds(new[time]) - F.col("__t")) <= step]
    return new.join(near, met, "left_semi")


def shifted_season(left: DataFrame, right: DataFrame, keys: list[str], year: str, payload: list[str], back: int = 1) -> DataFrame:
    """``left`` with the payload of the season ``back`` years before its own."""
    moved = right.select(*keys, (F.col(year) + back).alias(year), *payload)
    return left.join(moved, [*keys, year], "left")


def crosswalk(names: DataFrame, known: DataFrame, name: str, known_name: str, id_col: str) -> DataFrame:
    """``names`` with ``id_col`` and how: by the exact plain name, else by first letter and last word; keys of several ids link nothing."""
    full = plain_name(F.col(known_name))
    initial = lambda c: F.concat_ws(" ", F.substring(c, 1, 1), F.element_at(F.split(c, " "), -1))
    once = lambda key: known.select(key.alias("__k"), id_col).groupBy("__k").agg(F.min(id_col).alias("__id"), F.max(id_col).alias("__m")).where("__id = __m").drop("__m")
    exact, loose = once(full).withColumnRenamed("__id", "__exact"), once(initial(full)).withColumnRenamed("__id", "__loose")
    own = plain_name(F.col(name))
    out = names.withColumn("__k", own).join(exact, "__k", "left").drop("__k").withColumn("__k", initial(own)).join(loose, "__k", "left").drop("__k")
    how = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__loose").isNotNull(), "initial")
    return out.withColumns({id_col: F.coalesce("__exact", "__loose"), "how": how}).drop("__exact", "__loose")


def scored_link(left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, score: Column, least: float, margin: float = 0.0) -> DataFrame:
    """(left_id, right_id, score): the best candidate within a block, where it is good enough, better than the next by more
    than ``margin``, and wanted by this left row alone. score reads the columns of both sides; blocks are small by their keys."""
    met = left.join(right, block).withColumn("score", score).where(F.col("score") >= least).select(left_id, right_id, "score")
    best = met.groupBy(left_id).agg(F.max(F.struct("score", right_id)).alias("__b"))
    near = met.join(best, left_id).groupBy(left_id).agg(F.first("__b").alias("__b"), F.count_if(F.col("__b.score") - F.col("score") <= margin).alias("__near"))
    sole = near.where("__near = 1").select(left_id, F.col(f"__b.{right_id}").alias(right_id), "__b.score")
    alone = sole.groupBy(right_id).agg(F.count("*").alias("__n")).where("__n = 1")
    return sole.join(alone, right_id, "left_semi").select(left_id, right_id, "score")


def merged(old: DataFrame, new: DataFrame, keys: list[str], newest: list[str], fill: list[str]) -> DataFrame:
    """One row a key: of ``newest`` columns the new value if there is one, of ``fill`` columns the old one unless it is missing. One row a key on either side."""
    a, b = old.select(*keys, F.struct(*newest, *fill).alias("__o")), new.select(*keys, F.struct(*newest, *fill).alias("__n"))
    both = a.join(b, keys, "full")
    pick = lambda first, second, c: F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c)
    origin = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "old").otherwise("merged")
    return both.select(*keys, *[pick("__n", "__o", c) for c in newest], *[pick("__o", "__n", c) for c in fill], origin.alias("origin"))


def interval_link(quotes: DataFrame, picks: DataFrame, by: list[str], quote_time: str, start: str, pick_id: str, seconds: int) -> DataFrame:
    """``quotes`` with the one pick of the same key whose start lies within so many seconds after or before; those with several or none drop out, as do quotes after the start."""
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    left = quotes.select(*by, F.struct(*quotes.columns).alias("__row"), F.monotonically_increasing_id().alias("__id"), at(quote_time).alias("__q")).withColumn("__at", F.floor(F.col("__q") / seconds))
    steps = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(at(start) / seconds) + k))
    right = picks.select(*by, F.col(pick_id).alias("__p"), at(start).alias("__s"), steps.alias("__at"))
    near = left.join(right, [*by, "__at"]).where(F.abs(F.col("__q") - F.col("__s")) <= seconds)
    sole = near.groupBy("__id").agg(F.first("__row").alias("__row"), F.first("__q").alias("__q"), F.min("__p").alias(pick_id), F.max("__p").alias("__m"), F.min("__s").alias("__s"))
    return sole.where(f"{pick_id} = __m and __q < __s").select("__row.*", pick_id)


def conserved(before: DataFrame, after: DataFrame, id_col: str, identity: list[str]) -> DataFrame:
    """One row (lost, changed, added): ids that went, whose identity changed, and that came."""
    a, b = before.select(id_col, F.struct(*identity).alias("__a")), after.select(id_col, F.struct(*identity).alias("__b"))
    both = a.join(b, id_col, "full")
    return both.agg(F.count_if(F.col("__b").isNull()).alias("lost"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__a") != F.col("__b"))).alias("changed"), F.count_if(F.col("__a").isNull()).alias("added"))


def mapped(df: DataFrame, small: DataFrame, key: str, value: str, default: Column, most: int = 1_000_000) -> DataFrame:
    """``df`` with a looked-up value; the lookup is broadcast if it has at most ``most`` rows, by count."""
    n = small.limit(most + 1).count()
    return df.join(F.broadcast(small) if n <= most else small, key, "left").withColumn(value, F.coalesce(value, default))


def pairs_in_bucket(df: DataFrame, bucket: list[str], id_col: str, order: str, within: float, block: int = 4096, most: int = 65_536) -> DataFrame:
    """(a, b): rows of one bucket whose ``order`` values differ by at most ``within``, each pair once.

    Values are cut into steps, so only neighbours meet: a row is left in its own step, right there and in the step before.
    Steps with many pairs are dealt to parts; two parts meet in a group of their own, and one step's parts meet each other
    once, not both ways. Parts have ``block`` to ``most`` rows, as many as leave some groups to a task, so the rows sent grow
    with the table and not with its pairs. Steps are counted at once. A group's rows of one value are one list of ids.
    """
    cell, x = [*bucket, "__at"], F.col(order)
    # a little wider than asked for, so that no rounding takes two values within reach two steps apart
    step = F.floor(x / ((within or 1.0) * 1.000001))
    rows = df.where((F.abs(x) < float("inf")) & F.col(id_col).isNotNull()).select(*bucket, F.col(id_col).alias("__id"), x.alias("__x"), step.alias("__at"))
    twice = lambda side: side.withColumn("__by", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__at", F.col("__at") - F.col("__by"))
    total = lambda by, name: F.sum(F.when(F.col("__by") == by, F.col("__n")).otherwise(0)).alias(name)
    sizes = twice(rows.groupBy(*cell).agg(F.count("*").alias("__n"))).groupBy(*cell).agg(total(0, "__own"), total(1, "__after")).where("__own > 0")
    met = F.sum(F.col("__own") * (F.col("__own") / 2.0 + F.col("__after")))
    n, pairs, steps = sizes.agg(F.coalesce(F.sum("__own"), F.lit(0)), F.coalesce(met, F.lit(0.0)), F.count("*")).first()
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = min(max(block, (pairs / (8 * spread)) ** 0.5), most)
    parts = lambda c: F.greatest(F.round(F.col(c) / size), F.lit(1)).cast("int").alias(c)
    dealt = sized_join(twice(rows), sizes.select(*cell, parts("__own"), parts("__after")), cell, "inner", steps)
    # right parts are the step's own and those of the step after, the first of which has the number of the last own one
    part = lambda c: F.pmod(F.xxhash64("__id"), F.col(c)).cast("int")
    own, last, end = F.col("__by") == 0, F.col("__own") - 1, F.col("__own") + F.col("__after") - 2
    dealt = dealt.withColumn("__q", F.when(own, part("__own")).otherwise(last + part("__after")))
    # a right row goes to all parts of the step up to its own, which are numbered from 0; as a left row to those of larger numbers, written below 0
    q, k, keys = F.col("__q"), F.col("__k"), [*cell, "p", "q"]
    larger = F.when(own & (q < end), F.sequence(-q - 1, -end, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    side = F.when(k < 0, LEFT).when(own & (k == q), BOTH).otherwise(RIGHT)
    spread_out = dealt.withColumn("__k", F.explode(F.concat(F.sequence(F.lit(0), F.least(q, last)), larger)))
    placed = spread_out.select(*cell, F.when(k < 0, q).otherwise(k).alias("p"), F.when(k < 0, -k).otherwise(q).alias("q"), side.alias("__side"), "__id", "__x")
    # sorted, rows that are sent take less disk; a count of its own, as the pairs are many and the rows few: Spark would merge tasks by the rows' size
    tasks = max(spread, int((2 * n + 2 * pairs / size) // 1_000_000) + 1)
    sent = placed.sortWithinPartitions(*keys, "__x", "__id").repartition(tasks, *keys)
    ids = lambda which, name: F.array_sort(F.collect_list(F.when(which, F.col("__id")))).alias(name)
    # one table for both sides of the join, with the same columns read, so rows are sent once
    at = F.col("__side")
    lists = sent.groupBy(*keys, "__x").agg(ids(at != RIGHT, "__lefts"), ids(at == RIGHT, "__rights"), ids(at == BOTH, "__both"))
    left = lists.select(*keys, "__x", F.explode("__lefts").alias("a"))
    kinds = F.array(*[F.struct(F.lit(same).alias("__same"), F.col(c).alias("__ids")) for same, c in ((False, "__rights"), (True, "__both"))])
    cut = F.when(F.size("__ids") > 0, F.transform(F.sequence(F.lit(1), F.size("__ids"), F.lit(64)), lambda k: F.slice("__ids", k, 64)))
    right = lists.select(*keys, F.col("__x").alias("__y"), F.inline(kinds)).select(*keys, "__y", "__same", F.explode(cut).alias("__ids"))
    near = right.join(left.hint("shuffle_hash"), keys).where((F.abs(F.col("__x") - F.col("__y")) <= within) & (~F.col("__same") | (F.col("__x") <= F.col("__y"))))
    # not merged into fewer tasks: it only parts the join from what follows, else all pairs of a slice are held before one goes on
    apart = near.select("a", "__ids", (F.col("__same") & (F.col("__x") == F.col("__y"))).alias("__tie")).coalesce(tasks)
    spelled = apart.select("a", F.explode("__ids").alias("b"), "__tie").where((F.col("a") != F.col("b")) & (~F.col("__tie") | (F.col("a") < F.col("b"))))
    return spelled.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def unique_across(df: DataFrame, id_col: str, part: str) -> DataFrame:
    """(id, parts): ids that occur in several parts."""
    return df.groupBy(id_col).agg(F.min(part).alias("first_part"), F.max(part).alias("last_part")).where("first_part <> last_part")


def reconciled(ledger: DataFrame, predictions: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """A ledger (key, pick, issued, status, won) with new predictions and results.

    The earliest prediction of a key is frozen; keys whose frozen pick and a later prediction differ are marked conflict;
    results settle what is open and correct what was settled otherwise. Rows keep their pick for good.
    """
    first = predictions.groupBy(key).agg(F.min_by("pick", F.struct("issued", "pick")).alias("__pick"), F.min("issued").alias("__issued"), F.min("pick").alias("__low"), F.max("pick").alias("__high"))
    both = ledger.join(first, key, "full").join(results.select(key, F.col("winner").alias("__winner")), key, "left")
    pick = F.coalesce("pick", "__pick")
    clash = F.coalesce((F.col("__low") != pick) | (F.col("__high") != pick), F.lit(False))
    won = F.when(F.col("__winner").isNotNull(), F.col("__winner") == pick).otherwise(F.col("won"))
    status = F.when(clash, "conflict").when(F.col("__winner").isNull(), F.coalesce("status", F.lit("open"))).when(F.col("won").isNotNull() & (F.col("won") != won), "corrected").otherwise("settled")
    return both.select(key, pick.alias("pick"), F.coalesce("issued", "__issued").alias("issued"), status.alias("status"), won.alias("won"))


def carried_forward(today: DataFrame, before: DataFrame, key: str, place: str) -> DataFrame:
    """Rows issued before keep their place and content; new rows follow them in their own order; nothing shrinks."""
    fresh = today.join(before.select(key), key, "left_anti")
    top = before.agg(F.coalesce(F.max(place), F.lit(0)).alias("__top"))
    moved = numbered(fresh, place, [F.col(key)], "__r").join(F.broadcast(top)).withColumn(place, F.col("__top") + F.col("__r"))  # one row
    return before.unionByName(moved.select(*before.columns))


def confirmed_only(rows: DataFrame, manifest: DataFrame, parts: list[str]) -> DataFrame:
    """Rows whose digest of ``parts`` is in the manifest (column digest)."""
    keyed = rows.withColumn("digest", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]), 256))
    return keyed.join(manifest.select("digest"), "digest", "left_semi")


def merged_outcomes(canonical: DataFrame, ledger: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, how): the canonical outcome; the ledger's where there is no canonical row; null where they differ."""
    both = canonical.select(key, F.col(value).alias("__c"), F.lit(True).alias("__in")).join(ledger.select(key, F.col(value).alias("__l"), F.lit(True).alias("__has")), key, "full")
    clash = F.coalesce(F.col("__in") & F.col("__has") & (F.col("__c") != F.col("__l")), F.lit(False))
    how = F.when(clash, "conflict").when(F.col("__in").isNull(), "ledger").otherwise("canonical")
    return both.select(key, F.when(clash, F.lit(None)).when(F.col("__in").isNull(), F.col("__l")).otherwise(F.col("__c")).alias(value), how.alias("how"))


def without_tombstones(df: DataFrame, tombstones: DataFrame, key: str, time: str, now: Column, hours: int) -> DataFrame:
    """Rows younger than so many hours whose key was not deleted; what was deleted does not come back."""
    young = F.unix_seconds(F.col(time).cast("timestamp")) >= F.unix_seconds(now.cast("timestamp")) - hours * 3600
    return df.where(young).join(tombstones.select(key), key, "left_anti")


def latest_status(snapshots: DataFrame, key: str, time: str, status: str, terminal: list[str]) -> DataFrame:
    """(key, status, since): the latest terminal status, else the latest one; a late live status never undoes a terminal one."""
    over = F.col(status).isin(terminal)
    at = F.struct(over.alias("t"), F.col(time).alias("at"), F.col(status).alias("s"))
    return snapshots.groupBy(key).agg(F.max(at).alias("__m")).select(key, F.col("__m.s").alias(status), F.col("__m.at").alias("since"))
