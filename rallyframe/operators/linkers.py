"""Linking by scored evidence with vetoes and gates, and what guards a canonical table: collisions, trusted batches, ladders, overlays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Evidence:
    """A named condition over both rows (columns s_* of the source, m_* of the match) and the points it gives; null counts as false."""

    name: str
    holds: Column
    points: int = 0


def gated_link(sources: DataFrame, matches: DataFrame, source_id: str, match_id: str, blocks: list[str], day: str, window: tuple[Column, Column], evidence: list[Evidence], veto: Column, accept: Callable[[Column, dict[str, Column]], Column], widest: int) -> DataFrame:
    """One row for each source: source_id, match_id (where linked), score, evidence (of the best candidate) and reason.

    Candidates share the ``blocks`` columns, and the match's day lies in ``window``, two numbers of days after the source's day
    (columns over s_*; at most ``widest`` days from it either way). A candidate with the veto is none; the others score the
    points of their evidence, and ``accept`` (of the score and each evidence by name) says which may link. The best accepted one
    links if no other has its score and no other source comes to the same match. Reasons: linked, contested (another source
    comes to the match), tied, rejected (candidates, none accepted), vetoed (vetoed ones only), unmatched, unusable (no day or block).

    Both sides are dealt to slots of ``widest`` days and a source looks into three, so a block meets only its own time.
    """
    s = sources.select(*[F.col(c).alias(f"s_{c}") for c in sources.columns])
    m = matches.select(*[F.col(c).alias(f"m_{c}") for c in matches.columns])
    at = lambda side: F.unix_date(F.to_date(F.col(f"{side}_{day}")))
    usable = F.lit(True)
    for c in (day, *blocks):
        usable = usable & F.col(f"s_{c}").isNotNull()
    mine = s.where(usable).withColumn("__slot", F.explode(F.array(*[F.floor(at("s") / widest) + d for d in (-1, 0, 1)])))
    theirs = m.withColumn("__slot", F.floor(at("m") / widest))
    same = F.col("__slot") == F.col("__their")
    for c in blocks:
        same = same & (F.col(f"s_{c}") == F.col(f"m_{c}"))
    delta = at("m") - at("s")
    near = mine.join(theirs.withColumnRenamed("__slot", "__their"), same).where((delta >= window[0]) & (delta <= window[1]))
    held = {e.name: F.coalesce(e.holds, F.lit(False)) for e in evidence}
    score = F.lit(0)
    for e in evidence:
        score = score + F.when(held[e.name], F.lit(e.points)).otherwise(F.lit(0))
    names = F.array_compact(F.array(*[F.when(held[e.name], F.lit(e.name)) for e in evidence]))
    judged = near.select(F.col(f"s_{source_id}").alias(source_id), F.col(f"m_{match_id}").alias(match_id), score.alias("score"), names.alias("evidence"), F.coalesce(veto, F.lit(False)).alias("veto"), F.coalesce(accept(score, held), F.lit(False)).alias("accepted"))
    judged = judged.withColumn("rank", F.when(F.col("veto"), 0).when(F.col("accepted"), 2).otherwise(1))
    best = judged.groupBy(source_id).agg(F.max(F.struct("rank", "score")).alias("top")).select(source_id, "top.rank", "top.score")
    top = judged.join(best, [source_id, "rank", "score"]).groupBy(source_id, "rank", "score").agg(F.count_distinct(match_id).alias("k"), F.min(F.struct(match_id, "evidence")).alias("b"))
    top = top.select(source_id, "rank", "score", "k", F.col(f"b.{match_id}").alias(match_id), "b.evidence")
    claims = top.where("rank = 2 AND k = 1").groupBy(match_id).agg(F.count("*").alias("claims"))
    out = s.select(F.col(f"s_{source_id}").alias(source_id), usable.alias("usable")).join(top.join(claims, match_id, "left"), source_id, "left")
    reason = (
        F.when(~F.col("usable"), "unusable").when(F.col("rank").isNull(), "unmatched").when(F.col("rank") == 0, "vetoed").when(F.col("rank") == 1, "rejected")
        .when(F.col("k") > 1, "tied").when(F.col("claims") > 1, "contested").otherwise("linked")
    )
    return out.select(source_id, F.when(reason == "linked", F.col(match_id)).alias(match_id), "score", "evidence", reason.alias("reason"))


def distinct_collisions(df: DataFrame, key: str, proofs: list[str], label: str) -> DataFrame:
    """``df`` with resolved_id and collision (none, split or unresolved).

    Rows that share ``key`` are split, each with an id of key and ``label``, only if every one of ``proofs`` (label among them)
    is there in all of them and different in each; else all keep the shared key. Counted per key by the different values.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("__n"), F.least(*[F.count_distinct(c) for c in proofs]).alias("__least"), F.least(*[F.count(c) for c in proofs]).alias("__there"))
    met = df.join(counts, key)
    proven = (F.col("__least") == F.col("__n")) & (F.col("__there") == F.col("__n"))
    kind = F.when(F.col("__n") == 1, "none").when(proven, "split").otherwise("unresolved")
    split = F.substring(F.sha2(F.concat_ws("|", F.lit("collision"), F.col(key).cast("string"), F.col(label).cast("string")), 256), 1, 24)
    return met.withColumns({"collision": kind, "resolved_id": F.when(kind == "split", split).otherwise(F.col(key).cast("string"))}).drop("__n", "__least", "__there")


def trusted_batch(existing: DataFrame, incoming: DataFrame, key: str, frozen: list[str], fills: list[str]) -> tuple[DataFrame, DataFrame]:
    """The merged table (key, frozen and fills) and a verdict for each incoming key: (key, verdict).

    Verdicts: duplicate (the key comes with different contents), identity_changed (a frozen column differs from the existing
    row's), known_elsewhere (another existing key has these frozen columns), filled (a null cell of the existing row gets a
    value), conflict (a filled cell would change: it stays), unchanged, new. Only new rows and null cells are taken.
    """
    columns = [key, *frozen, *fills]
    whole = F.struct(*columns)
    per = incoming.select(*columns).where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(F.xxhash64(whole)).alias("__k"), F.min(whole).alias("__row"))
    rows = per.select(key, "__k", *[F.col(f"__row.{c}").alias(f"__{c}") for c in columns[1:]])
    have = existing.select(*columns, F.lit(True).alias("__have"))
    met = rows.join(have, key, "left")
    elsewhere = existing.select(*[F.col(c).alias(f"__{c}") for c in frozen], F.col(key).alias("__other"))
    named = elsewhere.groupBy(*[f"__{c}" for c in frozen]).agg(F.lit(True).alias("__named"))
    met = met.join(named, [f"__{c}" for c in frozen], "left")
    changed, fill, clash = F.lit(False), F.lit(False), F.lit(False)
    for c in frozen:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    for c in fills:
        fill = fill | (F.col(c).isNull() & F.col(f"__{c}").isNotNull())
        clash = clash | F.coalesce(F.col(c) != F.col(f"__{c}"), F.lit(False))
    old = F.coalesce("__have", F.lit(False))
    verdict = (
        F.when(F.col("__k") > 1, "duplicate").when(old & changed, "identity_changed").when(~old & F.coalesce("__named", F.lit(False)), "known_elsewhere").when(~old, "new")
        .when(clash, "conflict").when(fill, "filled").otherwise("unchanged")
    )
    verdicts = met.select(key, verdict.alias("verdict"), *[F.col(f"__{c}") for c in columns[1:]])
    fresh = verdicts.where("verdict = 'new'").select(key, *[F.col(f"__{c}").alias(c) for c in columns[1:]])
    patch = verdicts.where("verdict in ('filled', 'conflict')").select(key, *[F.col(f"__{c}") for c in fills])
    merged = existing.select(*columns).join(patch, key, "left").select(key, *frozen, *[F.coalesce(c, f"__{c}").alias(c) for c in fills])
    return merged.unionByName(fresh), verdicts.select(key, "verdict")


def first_compatible(df: DataFrame, id_col: str, candidates: str, gazetteer: DataFrame, name: str, compatible: Column) -> DataFrame:
    """One row for each id: the gazetteer's row of the first candidate (an ordered array of names) that names exactly one compatible place; its position, or null columns and how many were ambiguous.

    compatible: a condition over the row and the gazetteer's columns. Candidates meet the gazetteer by name; nothing is collected.
    """
    each = df.select("*", F.posexplode_outer(candidates).alias("position", "__name"))
    met = each.join(gazetteer.withColumnRenamed(name, "__name"), "__name", "left").withColumn("__fits", F.coalesce(compatible, F.lit(False)))
    places = [c for c in gazetteer.columns if c != name]
    per = met.groupBy(id_col, "position").agg(F.count_if("__fits").alias("n"), F.first(F.when(F.col("__fits"), F.struct(F.col("__name").alias(name), *places)), True).alias("place"))
    best = per.groupBy(id_col).agg(F.min(F.when(F.col("n") == 1, F.struct("position", "place"))).alias("b"), F.count_if(F.col("n") > 1).alias("ambiguous"))
    return best.select(id_col, F.col("b.position").alias("position"), *[F.col(f"b.place.{c}").alias(c) for c in (name, *places)], "ambiguous")


def overlaid(frozen: DataFrame, statuses: DataFrame, key: str, time: str, columns: list[str], final: Column) -> DataFrame:
    """``frozen`` with its columns as the latest status has them, and overlay (frozen, live or settled).

    A status with ``final`` beats any later one without; of final ones the last counts, so corrections arrive. Null status
    cells leave the frozen ones. Statuses are reduced to one a key before they are joined.
    """
    last = statuses.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.coalesce(final, F.lit(False)).alias("f"), F.col(time).alias("t"), *[F.col(c).alias(c) for c in columns])).alias("__o"))
    met = frozen.join(last, key, "left")
    how = F.when(F.col("__o").isNull(), "frozen").when(F.col("__o.f"), "settled").otherwise("live")
    return met.withColumns({"overlay": how} | {c: F.coalesce(F.col(f"__o.{c}"), F.col(c)) for c in columns}).drop("__o")


def modal(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key and column: the most frequent value (the least of several), how often it occurs, and how many different ones there are.

    One pass for all columns: values are counted before any meet.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(*keys, each.alias("v")).where("v.value is not null").groupBy(*keys, "v.column", "v.value").agg(F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("less"), F.col("value")))
    return counts.groupBy(*keys, "column").agg(top.alias("t"), F.count("*").alias("different")).select(*keys, "column", F.col("t.value").alias("value"), (-F.col("t.less")).alias("n"), "different")


def player_dimension(sightings: DataFrame, player: str, name: str, country: str, order: list[str], profiles: DataFrame, most_aliases: int = 20) -> DataFrame:
    """One row for each player seen: player, name (the latest), aliases (the most frequent names, in order of the alphabet), country, birth_date, hand, seen.

    profiles: (player, name, country, birth_date, hand), one row each; their name is an alias, their country goes before the modal one.
    """
    seen = sightings.where(F.col(player).isNotNull())
    latest = seen.groupBy(player).agg(F.count("*").alias("seen"), F.max(F.when(F.col(name) != "", F.struct(*order, F.col(name).alias("n")))).alias("l"))
    own = profiles.select(F.col(player), F.col(name).alias("__p_name"), F.col(country).alias("__p_country"), "birth_date", "hand")
    names = seen.where(F.col(name) != "").groupBy(player, name).agg(F.count("*").alias("k"))
    names = names.unionByName(own.where("__p_name != ''").select(player, F.col("__p_name").alias(name), F.lit(1 << 40).alias("k"))).groupBy(player, name).agg(F.max("k").alias("k"))
    listed = names.withColumn("r", F.row_number().over(Window.partitionBy(player).orderBy(F.desc("k"), name))).where(F.col("r") <= most_aliases)
    aliases = listed.groupBy(player).agg(F.array_sort(F.collect_list(name)).alias("aliases"))
    home = modal(seen.where(F.col(country) != ""), [player], [country]).select(player, F.col("value").alias("__home"))
    out = latest.join(aliases, player, "left").join(home, player, "left").join(own, player, "left")
    return out.select(player, F.col("l.n").alias(name), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("__p_country", "__home").alias(country), "birth_date", "hand", "seen")
