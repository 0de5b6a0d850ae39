"""Match formats and results as column expressions: typed rows of provider JSON, scores, best-of, void reasons and grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a termination text and the reason they stand for, first match counts.
VOID_WORDS = {"walkover": "walkover", "w/o": "walkover", "retired": "retired", "ret.": "retired", "default": "default", "abandon": "abandoned", "cancel": "cancelled", "postpone": "postponed"}
#: Words that name a grand slam, and parts of an event that are no main draw.
SLAMS = ["australian open", "roland garros", "french open", "wimbledon", "us open"]
NO_MAIN_DRAW = ["qualif", "junior", "legend", "exhibition", "doubles"]

SET = "struct<a:int,b:int,t:int>"


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.lit(words), lambda w: F.contains(text, w))


def best_of(explicit: Column, tour: Column, event: Column, stage: Column, sets: Column) -> Column:
    """A struct (best_of, how): the provider's 3 or 5; 5 where four sets were played; else by tour: ATP slams' main draws 5, other known tours 3; null if unknown."""
    tour, context = F.lower(F.coalesce(tour, F.lit(""))), F.lower(F.concat_ws(" ", event, stage))
    made = lambda n, how: F.struct(F.lit(n).cast("int").alias("best_of"), F.lit(how).alias("how"))
    slam = _any(context, SLAMS) & ~_any(context, NO_MAIN_DRAW)
    return (
        F.when(explicit.isin(3, 5), F.struct(explicit.cast("int").alias("best_of"), F.lit("provider").alias("how"))).when(sets >= 4, made(5, "sets"))
        .when(tour.startswith("wta") | tour.startswith("itf") | F.contains(tour, F.lit("challenger")), made(3, "tour")).when(tour.startswith("atp") & slam, made(5, "slam")).when(tour.startswith("atp"), made(3, "tour"))
        .otherwise(made(None, "unknown"))
    )


def score(text: Column) -> Column:
    """A score such as ``6-4 3-6 7-6(5)`` as a struct (sets: an array of (a, b, t), t the loser's points of a tie-break; sets_a, sets_b, games, error).

    A set is complete at 6 games with two more than the other side, at 7-5 or at 7-6. error: empty, malformed (a part is no
    set) or incomplete (some set is not complete); the counts hold complete sets only, games all of them.
    """
    bare = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.split(bare, r"[\s,]+"), lambda p: p != "")
    cut = F.transform(parts, lambda p: F.when(p.rlike(r"^\d{1,2}[-:]\d{1,2}(?:\(\d{1,2}\))?$"), F.split(p, r"[^0-9]+")))
    number = lambda p, k: F.get(p, F.lit(k)).try_cast("int")
    sets = F.transform(cut, lambda p: F.struct(number(p, 0).alias("a"), number(p, 1).alias("b"), number(p, 2).alias("t")))
    # a lambda's variable is worked out once, a column wherever it is named
    return F.get(F.transform(F.array(sets), _counted), F.lit(0))


def _counted(sets: Column) -> Column:
    """The struct that ``score`` returns, of an array of (a, b, t)."""
    high, low = (lambda s: F.greatest(s["a"], s["b"])), (lambda s: F.least(s["a"], s["b"]))
    complete = lambda s: ((high(s) == 6) & (low(s) <= 4)) | ((high(s) == 7) & low(s).isin(5, 6))
    won = lambda own, other: F.size(F.filter(sets, lambda s: complete(s) & (s[own] > s[other])))
    games = F.aggregate(sets, F.lit(0), lambda n, s: n + F.coalesce(s["a"] + s["b"], F.lit(0)))
    error = F.when(F.size(sets) == 0, "empty").when(F.exists(sets, lambda s: s["a"].isNull()), "malformed").when(~F.forall(sets, complete), "incomplete")
    whole = (F.size(sets) > 0) & F.forall(sets, lambda s: s["a"].isNotNull())
    return F.struct(F.when(whole, sets).alias("sets"), *[F.when(whole, v).alias(n) for n, v in (("sets_a", won("a", "b")), ("sets_b", won("b", "a")), ("games", games))], error.alias("error"))


def void_reason(status: Column, description: Column, sets_a: Column, sets_b: Column, best: Column, won: Column) -> Column:
    """Why a result does not count: the first void word in the texts; ``incomplete`` where there is a winner whom no side's sets bear out; null otherwise."""
    text = F.lower(F.replace(F.concat_ws(" | ", status, description), F.lit("_"), F.lit(" ")))
    named = F.coalesce(*[F.when(F.contains(text, F.lit(word)), F.lit(reason)) for word, reason in VOID_WORDS.items()])
    short = won.isNotNull() & (F.greatest(sets_a, sets_b) < F.when(best == 5, 3).otherwise(2))
    return F.coalesce(named, F.when(F.coalesce(short, F.lit(False)), "incomplete"))


def graded(market: Column, side: Column, line: Column, void: Column, winner: Column, games: Column) -> Column:
    """win, loss, void or pending of a pick: ``winner`` (side a or b), or ``over`` and ``under`` a line of games; a line that is met is void."""
    total = F.when(games.isNull() | line.isNull(), "pending").when(games == line, "void").when((games > line) == (side == "over"), "win").otherwise("loss")
    return F.when(void.isNotNull(), "void").when(market == "winner", F.when(winner.isNull(), "pending").when(winner == side, "win").otherwise("loss")).when(market == "games", total).otherwise("pending")


#: The parts of a provider's event that are read.
EVENT = "id string, home struct<id:string,name:string>, away struct<id:string,name:string>, status struct<type:string,description:string>, tournament struct<name:string,tour:string>, round string, start long, bestOf int, winner string, score string"


def typed_events(raw: DataFrame, json: str) -> DataFrame:
    """Provider events (a JSON text a row) as typed match rows: match_id, scheduled_at, tour, tournament, sides, best_of, result, reject.

    reject: malformed (no JSON object or no id), no_sides (an id missing or both the same), no_start; such rows have null cells.
    winner is a or b by the id that the provider gives; sets and games come from the score; void says why a result does not count.
    """
    e = F.from_json(F.col(json), EVENT)
    rows = raw.withColumn("__e", e)
    at = lambda path: F.col(f"__e.{path}")
    a, b = F.trim(at("home.id")), F.trim(at("away.id"))
    reject = F.when(F.coalesce(at("id"), F.lit("")) == "", "malformed").when(F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin("") | (a == b), "no_sides").when(at("start").isNull(), "no_start")
    rows = rows.withColumns({"__reject": reject, "__s": score(at("score"))})
    rows = rows.withColumn("__f", best_of(at("bestOf"), at("tournament.tour"), at("tournament.name"), at("round"), F.size("__s.sets")))
    winner = F.when(at("winner") == a, "a").when(at("winner") == b, "b")
    void = void_reason(at("status.type"), at("status.description"), F.col("__s.sets_a"), F.col("__s.sets_b"), F.col("__f.best_of"), winner)
    made = {
        "match_id": at("id"), "scheduled_at": F.timestamp_seconds(at("start")), "tour": F.lower(F.coalesce(at("tournament.tour"), F.lit(""))), "tournament": F.coalesce(at("tournament.name"), F.lit("")), "player_a": a, "player_b": b,
        "best_of": F.col("__f.best_of"), "format_source": F.col("__f.how"), "status": F.lower(F.coalesce(at("status.type"), F.lit("unknown"))), "winner": winner, "sets_a": F.col("__s.sets_a"), "sets_b": F.col("__s.sets_b"), "games": F.col("__s.games"), "void": void,
    }
    return rows.select(*[c for c in raw.columns if c != json], *[F.when(F.col("__reject").isNull(), v).alias(c) for c, v in made.items()], F.col("__reject").alias("reject"))
