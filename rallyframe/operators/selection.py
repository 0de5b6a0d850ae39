"""Ranking and selection: top rows per group, threshold cascades, exclusive sections, fixed samples and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Adds place (from 1) and keeps the first n rows of each key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def cascade(df: DataFrame, keys: list[str], value: Column, thresholds: list[float], target: int) -> DataFrame:
    """Rows at or above the highest threshold that leaves at least ``target`` of their key, else the lowest one. Adds threshold."""
    levels = sorted(thresholds, reverse=True)
    counts = df.groupBy(*keys).agg(*[F.count_if(value >= t).alias(f"__{k}") for k, t in enumerate(levels)])
    chosen = F.coalesce(*[F.when(F.col(f"__{k}") >= target, F.lit(t)) for k, t in enumerate(levels)], F.lit(levels[-1]))
    return df.join(counts.select(*keys, chosen.alias("threshold")), keys).where(value >= F.col("threshold"))


def _contenders(df: DataFrame, day: str, tiers: list[Column], order: list[Column], most: int) -> DataFrame:
    """Rows that are among a day's best ``most`` of some section, by tier (null: does not fit) and ``order``; the others can have no place.

    All sections are ranked in one pass, and each task passes on a day's best rows only.
    """
    fits = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), tier.alias("tier")) for k, tier in enumerate(tiers)]), lambda s: s["tier"].isNotNull())
    each = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__s", F.explode(fits))
    best = each.withColumn("__best", F.row_number().over(Window.partitionBy(day, "__s.k").orderBy("__s.tier", *order))).where(F.col("__best") <= most)
    return best.dropDuplicates(["__row"]).drop("__row", "__s", "__best")


def exclusive_sections(df: DataFrame, identity: str, day: str, sections: list[tuple[str, Column, int]], order: list[Column]) -> DataFrame:
    """Sections in order of priority take their best rows up to a limit a day; a row taken is out for later ones. Adds section and place.

    Only the contenders, at most the sum of all limits for each section and day, are ranked section by section.
    """
    taken = _contenders(df, day, [F.when(fits, F.lit(0)) for _, fits, _ in sections], order, sum(limit for _, _, limit in sections))
    taken = taken.withColumns({"section": F.lit(None).cast("string"), "place": F.lit(None).cast("int")})
    for name, fits, limit in sections:
        free = F.col("section").isNull() & F.coalesce(fits, F.lit(False))
        taken = taken.withColumn("__free", free).withColumn("__rank", F.row_number().over(Window.partitionBy(day, "__free").orderBy(*order)))
        now = F.col("__free") & (F.col("__rank") <= limit)
        taken = taken.withColumns({"section": F.when(now, F.lit(name)).otherwise(F.col("section")), "place": F.when(now, F.col("__rank")).otherwise(F.col("place"))})
    return taken.where("section is not null").drop("__free", "__rank")


def fixed_sample(df: DataFrame, keys: list[str], parts: list[Column], k: int) -> DataFrame:
    """k rows of each key in the order of a SHA-256 of the parts: random-looking and the same on every run."""
    ticket = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return top_n(df.withColumn("__ticket", ticket), keys, [F.col("__ticket")], k).drop("__ticket")


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) in a total order."""
    return df.orderBy(*order).offset(size * number).limit(size)


def ranked(df: DataFrame, keys: list[str], columns: list[str], last: list[Column]) -> DataFrame:
    """Adds place within the key: by each column from high to low, missing numbers as 0, then by ``last``."""
    order = [F.desc(F.coalesce(F.col(c), F.lit(0))) for c in columns]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *last)))


def first_tier(tiers: list[Column]) -> Column:
    """The number of the first tier whose condition holds; null if none does."""
    return F.coalesce(*[F.when(fits, F.lit(k)) for k, fits in enumerate(tiers)], F.lit(None).cast("int"))


def filled(df: DataFrame, keys: list[str], core: Column, fallback: Column, order: list[Column], least: int) -> DataFrame:
    """All core rows of a key and, if they are fewer than ``least``, its best fallback rows up to that number. Adds source and place."""
    kind = F.when(core, 0).when(fallback, 1)
    rows = df.withColumn("__kind", kind).where("__kind is not null")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__kind", *order))
    return rows.withColumn("place", place).where((F.col("__kind") == 0) | (F.col("place") <= least)).withColumn("source", F.when(F.col("__kind") == 0, "core").otherwise("fallback")).drop("__kind")


def one_per_event(df: DataFrame, keys: list[str], event: str, tier: Column, order: list[Column], target: int) -> DataFrame:
    """The best row of each event, then the first ``target`` of a key by tier and order. Adds tier and place."""
    rows = df.withColumn("tier", tier).where("tier is not null")
    best = rows.withColumn("__e", F.row_number().over(Window.partitionBy(*keys, event).orderBy("tier", *order))).where("__e = 1").drop("__e")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("tier", *order))).where(F.col("place") <= target)


def sections(df: DataFrame, identity: str, day: str, rules: list[tuple[str, Column, list[Column], int]], order: list[Column], fallback: Column | None = None, least: int = 0) -> DataFrame:
    """The section selector: rules (name, gate, tiers, limit) in order of priority, one section a row; the last one is filled from ``fallback`` to ``least``.

    Only contenders, for each section and day at most the sum of all limits, are kept; each round then gives those still free
    their place in one section.
    """
    fitting = [F.when(gate, first_tier(tiers)) for _, gate, tiers, _ in rules]
    spares = [] if fallback is None else [F.when(fallback & fitting[-1].isNull(), F.lit(0))]
    left = _contenders(df, day, [*fitting, *spares], order, sum(limit for *_, limit in rules) + least)
    left = left.withColumns({f"__s{k}": tier for k, tier in enumerate(fitting)}).withColumn("section", F.lit(None).cast("string")).withColumn("place", F.lit(None).cast("int"))
    for k, (name, _, _, limit) in enumerate(rules):
        fits = F.col("section").isNull() & F.col(f"__s{k}").isNotNull()
        if fallback is not None and k == len(rules) - 1:
            spare = F.col("section").isNull() & F.col(f"__s{k}").isNull() & fallback
            rank = F.row_number().over(Window.partitionBy(day, fits | spare).orderBy(F.coalesce(F.col(f"__s{k}"), F.lit(1 << 20)), *order))
            taken = (fits & (rank <= limit)) | (spare & (rank <= least))
        else:
            rank = F.row_number().over(Window.partitionBy(day, fits).orderBy(f"__s{k}", *order))
            taken = fits & (rank <= limit)
        left = left.withColumns({"__rank": rank}).withColumn("__taken", taken if fallback is None or k < len(rules) - 1 else (fits & (F.col("__rank") <= limit)) | (spare & (F.col("__rank") <= least)))
        left = left.withColumns({"section": F.when(F.col("__taken"), F.lit(name)).otherwise(F.col("section")), "place": F.when(F.col("__taken"), F.col("__rank")).otherwise(F.col("place"))})
    return left.where("section is not null").drop("__rank", "__taken", *[f"__s{k}" for k in range(len(rules))])


def newest(df: DataFrame, time: str, id_col: str, n: int) -> DataFrame:
    """The newest n rows, ids breaking ties."""
    return df.orderBy(F.desc(time), F.desc(id_col)).limit(n)


def daily_anchor(df: DataFrame, time: str, id_col: str, hour: int = 6) -> DataFrame:
    """(day, id): the earliest row of each day at or after an hour."""
    rows = df.where(F.hour(time) >= hour)
    return rows.groupBy(F.to_date(time).alias("day")).agg(F.min_by(id_col, F.struct(time, id_col)).alias(id_col))


def equal_capacity(df: DataFrame, day: str, first: Column, second: Column, order_first: list[Column], order_second: list[Column], won: Column) -> DataFrame:
    """Two selections compared on days where both have rows, each cut to the smaller number: day, n, wins_first, wins_second."""
    rows = df.withColumns({"__a": F.coalesce(first, F.lit(False)), "__b": F.coalesce(second, F.lit(False)), "__w": won})
    rows = rows.withColumns({
        "__pa": F.row_number().over(Window.partitionBy(day, "__a").orderBy(*order_first)), "__pb": F.row_number().over(Window.partitionBy(day, "__b").orderBy(*order_second)),
        "__na": F.count_if("__a").over(Window.partitionBy(day)), "__nb": F.count_if("__b").over(Window.partitionBy(day)),
    })
    rows = rows.withColumn("__n", F.least("__na", "__nb")).where("__n > 0")
    return rows.groupBy(day).agg(F.first("__n").alias("n"), F.count_if(F.col("__a") & (F.col("__pa") <= F.col("__n")) & F.col("__w")).alias("wins_first"), F.count_if(F.col("__b") & (F.col("__pb") <= F.col("__n")) & F.col("__w")).alias("wins_second"))


def text_search(df: DataFrame, name: Column, asked: str, weight: str, id_col: str, n: int) -> DataFrame:
    """The n best rows whose normalised name holds what is asked: exact ones first, then prefixes, then by weight and name. Adds place and ambiguous (the best two share a name)."""
    found = df.withColumn("__n", name).where(F.col("__n").contains(asked))
    kind = F.when(F.col("__n") == asked, 0).when(F.col("__n").startswith(asked), 1).otherwise(2)
    top = found.withColumn("__k", kind).orderBy("__k", F.desc(weight), "__n", id_col).limit(n)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy("__k", F.desc(weight), "__n", id_col)))  # n rows
    return placed.withColumn("ambiguous", F.count("*").over(Window.partitionBy("__n")) > 1).drop("__n", "__k")


def budgeted(df: DataFrame, priority: Column, hours_ahead: Column, edges: list[float], order: list[Column], budget: int) -> DataFrame:
    """Rows up to a budget: priority rows, then one of each band of hours ahead in turn, then the rest. Adds band."""
    band = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        band = F.when(hours_ahead <= edges[k], F.lit(k)).otherwise(band)
    rows = df.withColumns({"band": F.when(priority, -1).otherwise(band), "__t": F.lit(0)})
    turn = F.row_number().over(Window.partitionBy("band").orderBy(*order))
    late = (F.col("band") == len(edges)).cast("int")
    return rows.withColumn("__t", turn).orderBy((F.col("band") >= 0).cast("int"), late, F.when(F.col("band") >= 0, F.col("__t")).otherwise(0), "band", *order).limit(budget).drop("__t")
