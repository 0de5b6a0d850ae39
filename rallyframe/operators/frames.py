"""Point-in-time snapshots of matches and the training frame made of them.

A match has two sides. Everything a side's features need is summed per player and day, and per player, surface and day,
before any window: one shuffle of the sides by player, of the meetings by pair and of the surfaces' days. A player's
windows then run over days, however many rows a day has. Rows of a match's own day are in none of its features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions.stats import odd_digest
from rallyframe.operators.decay import moments_before, with_prior

#: Features of a side, in the frame as differences of the first side's and the second's.
SIDE = ["n_before", "win_rate", "form_30", "form_120", "surface_n", "surface_form_180", "rest_days", "played_7", "played_28", "stat_mean", "stat_120", "best_stat"]


@dataclass(frozen=True)
class Matches:
    """Column names of a table of matches: its id (one column), day, surface, both sides' players and stats, and whether the first side won."""

    id: str
    day: str
    surface: str
    players: tuple[str, str]
    stats: tuple[str, str]
    first_won: str


def sides(matches: DataFrame, of: Matches) -> DataFrame:
    """Two rows for each match: id, day, surface, side (0 or 1), player, won, stat."""

    def side(at: int) -> Column:
        won = F.col(of.first_won) if at == 0 else ~F.col(of.first_won)
        return F.struct(F.lit(at).alias("side"), F.col(of.players[at]).alias("player"), won.cast("double").alias("won"), F.col(of.stats[at]).cast("double").alias("stat"))

    rows = matches.select(F.col(of.id).alias("id"), F.col(of.day).alias("day"), F.col(of.surface).alias("surface"), F.explode(F.array(side(0), side(1))).alias("s"))
    return rows.select("id", "day", "surface", "s.*").where("player IS NOT NULL AND day IS NOT NULL")


def _player_days(long: DataFrame, rest: tuple[int, int]) -> DataFrame:
    """Features of each player before each of their days."""
    mass = lambda v, name: [F.count(v).alias(f"{name}n"), F.avg(v).alias(f"{name}mean"), (F.var_pop(v) * F.count(v)).alias(f"{name}m2")]
    days = long.groupBy("player", "day").agg(F.count("*").alias("rows"), *mass("won", "won_"), *mass("stat", "stat_"), F.max("stat").alias("top"))
    days = moments_before(days, ["player"], "day", {"w30": 30.0, "w120": 120.0}, "won_")
    days = moments_before(days, ["player"], "day", {"s120": 120.0}, "stat_")
    at = F.unix_date("day")
    frame = lambda n=None: Window.partitionBy("player").orderBy(at).rangeBetween(Window.unboundedPreceding if n is None else -n, -1)
    total = lambda c, n=None: F.coalesce(F.sum(c).over(frame(n)), F.lit(0))
    played, wins, n_stat = total("rows"), total(F.col("won_n") * F.col("won_mean")), total("stat_n")
    last = F.max(at).over(frame())
    return days.select(
        "player", "day", played.alias("n_before"), ((2.0 + wins) / (4.0 + total("won_n"))).alias("win_rate"),
        with_prior(F.col("w30"), 0.5, 4.0).alias("form_30"), with_prior(F.col("w120"), 0.5, 4.0).alias("form_120"),
        F.when(last.isNull(), F.lit(rest[0])).otherwise(F.least(at - last, F.lit(rest[1]))).alias("rest_days"),
        total("rows", 7).alias("played_7"), total("rows", 28).alias("played_28"),
        F.try_divide(total(F.col("stat_n") * F.col("stat_mean")), n_stat).alias("stat_mean"), F.col("s120.mean").alias("stat_120"), F.max("top").over(frame()).alias("best_stat"),
    )


def _surface_days(long: DataFrame) -> DataFrame:
    """Decayed form of each player on each surface before each of their days there."""
    days = long.groupBy("player", "surface", "day").agg(F.count("won").alias("n"), F.avg("won").alias("mean"), (F.var_pop("won") * F.count("won")).alias("m2"))
    days = moments_before(days, ["player"], "day", {"w": 180.0}, more=["surface"])
    return days.select("player", "surface", "day", F.col("w.n").alias("surface_n"), with_prior(F.col("w"), 0.5, 4.0).alias("surface_form_180"))


def _meetings(matches: DataFrame, of: Matches) -> DataFrame:
    """(low, high, day, n_met, low_wins): what a pair has played before each of its days."""
    low_won = F.when(F.col(of.players[0]) <= F.col(of.players[1]), F.col(of.first_won)).otherwise(~F.col(of.first_won)).cast("int")
    days = matches.groupBy(F.least(*of.players).alias("low"), F.greatest(*of.players).alias("high"), F.col(of.day).alias("day")).agg(F.count(low_won).alias("m"), F.sum(low_won).alias("w"))
    before = Window.partitionBy("low", "high").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select("low", "high", "day", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("n_met"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("low_wins"))


def snapshot(matches: DataFrame, of: Matches, rest: tuple[int, int] = (14, 180)) -> DataFrame:
    """One row for each match (id) with two different players: day, surface, players, first_won, each side's ``SIDE`` features as a struct (first, second), n_met and h2h (the first side's share of earlier meetings less half, Beta(2, 2))."""
    whole = matches.where(F.col(of.players[0]) != F.col(of.players[1]))
    long = sides(whole, of)
    known = long.join(_player_days(long, rest), ["player", "day"]).join(_surface_days(long), ["player", "surface", "day"], "left")
    both = known.groupBy("id").agg(*[F.first(F.when(F.col("side") == at, F.struct(*SIDE)), True).alias(name) for at, name in ((0, "first"), (1, "second"))])
    base = whole.select(F.col(of.id).alias("id"), F.col(of.day).alias("day"), F.col(of.surface).alias("surface"), F.col(of.players[0]).alias("first_player"), F.col(of.players[1]).alias("second_player"), F.col(of.first_won).alias("first_won"))
    base = base.withColumns({"low": F.least("first_player", "second_player"), "high": F.greatest("first_player", "second_player")})
    out = base.join(both, "id").join(_meetings(whole, of), ["low", "high", "day"])
    share = (F.col("low_wins") + 2.0) / (F.col("n_met") + 4.0) - 0.5
    return out.withColumn("h2h", F.when(F.col("first_player") <= F.col("second_player"), share).otherwise(0.0 - share)).drop("low", "high", "low_wins")


def training_frame(matches: DataFrame, of: Matches, least: int = 1) -> DataFrame:
    """One row for each match with a result and ``least`` earlier matches of both sides: id, day, swapped, label, d_<feature> and n_met, h2h.

    A fixed coin of the match's id decides whether sides change places, so that a label follows from no order in the source;
    differences and h2h turn with it. label: whether the side that stands first then won.
    """
    rows = snapshot(matches.where(F.col(of.first_won).isNotNull()), of).where((F.col("first.n_before") >= least) & (F.col("second.n_before") >= least))
    sign = F.when(F.col("swapped"), -1.0).otherwise(1.0)
    turned = rows.withColumn("swapped", odd_digest(F.col("id")))
    differences = [(sign * (F.col(f"first.{f}") - F.col(f"second.{f}"))).alias(f"d_{f}") for f in SIDE]
    return turned.select("id", "day", "swapped", (F.col("first_won") != F.col("swapped")).cast("int").alias("label"), *differences, "n_met", (sign * F.col("h2h")).alias("h2h"))
