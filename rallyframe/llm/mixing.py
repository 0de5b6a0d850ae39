"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected ``target / size`` times. The documents of a source stand in one fixed
order (slot, size, id, hash of the row); the prefix sums of their expected copies, shifted by one random offset per
source, cross an integer boundary once for every copy that is emitted. As the order runs through the sizes of
each slot, the words taken come out near the target.

Prefix sums are split over ``SLOTS`` slots per source: counts per slot give each slot's start, row numbers within
a slot the rest, so no source, however large, meets in one task.

Defined cases: a null source is a source of its own, last in order; null and blank texts have size 0 and are
copied as often as others of their source; an empty table gives an empty table; rows that repeat an id are
separate documents; rows without an id come first in the order of their slot; input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.llm.text import count_words

#: Parts into which the order of each source is split.
SLOTS = 1024


def offset_of(seed: int, source: Column) -> Column:
    """The source's random offset in [0, 1): 32 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), source))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def slot_of(id_: Column, size: Column) -> Column:
    """A row's slot: six hex digits of a digest of its id and size, modulo ``SLOTS``."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), size.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 6), 16, 10).cast("long"), F.lit(SLOTS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source (columns __nul, __src, source_size): its target.

    Weights repeat over the sources by code point, null last. Sources share ``share`` of all sizes; a target stops
    at ``cap`` times the size and the rest is shared again, which ends at one level: sort by cap per weight and take
    the first source that the level leaves uncapped. Input is one row per source.
    """
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy("__nul", "__src")) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("__w", F.get(cycle, F.pmod("__rank", F.lit(len(weights))))).withColumn("__cap", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (
        F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("__level", level).withColumn("__at", F.row_number().over(order))
    first = F.min_by(F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level")), F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__at"))).over(whole)
    return levels.withColumn("target", F.coalesce(F.least("__cap", first * F.col("__w")), F.col("__cap"))).select("__nul", "__src", "source_size", "target")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 11,
) -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix holds each document. size: words of ``text`` by default."""
    own = ["size", "source_size", "target", "copies"]
    rows = (
        docs.withColumn("__size", (count_words(F.col("text")) if size is None else size).cast("long"))
        .withColumn("__nul", F.col(source_col).isNull())
        .withColumn("__src", F.coalesce(F.col(source_col), F.lit("")))
        .withColumn("__slot", slot_of(F.col(id_col), F.col("__size")))
        .drop(*own)
    )
    slots = rows.groupBy("__nul", "__src", "__slot").agg(F.count("*").alias("__n"), F.sum("__size").alias("__words"))
    goal = targets(slots.groupBy("__nul", "__src").agg(F.sum("__words").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("__nul", "__src").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n", "__words").join(goal, ["__nul", "__src"])
    # rows alike in size and id stand in the order of a hash of all that can be hashed
    tie = F.xxhash64(*[c for c, kind in docs.dtypes if c not in own and "map<" not in kind and "variant" not in kind])
    within = Window.partitionBy("__nul", "__src", "__slot").orderBy("__size", id_col, tie)
    at = F.col("__before") + F.col("__at")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("__rate") * at + F.col("__u")) - F.floor(F.col("__rate") * (at - 1) + F.col("__u"))
    return (
        rows.withColumn("__at", F.row_number().over(within))
        .join(slots, ["__nul", "__src", "__slot"])
        .withColumn("__rate", rate)
        .withColumn("__u", offset_of(seed, F.concat(F.col("__nul").cast("string"), F.col("__src"))))
        .select(*[c for c in docs.columns if c not in own], F.col("__size").alias("size"), "source_size", "target", crossed.cast("long").alias("copies"))
    )


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as often as it was taken."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns)
