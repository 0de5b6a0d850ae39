"""Parsing and mapping of single values: numbers, enums, times, odds, bands and JSON, without row-at-a-time code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A number in a text: blanks, a percent sign and digit groups are dropped; null if nothing numeric is left, or it is not finite."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text.cast("string")), "%$", ""), "(?<=[0-9])[, ](?=[0-9]{3}([^0-9]|$))", "")
    found = bare.try_cast("double")
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)


def enum(text: Column, names: dict[str, list[str]], other: str = "unknown") -> Column:
    """The name whose list holds the lower-cased text."""
    bare, out = F.lower(F.trim(text)), F.lit(other)
    for name, own in reversed(names.items()):
        out = F.when(bare.isin(own), F.lit(name)).otherwise(out)
    return out


def utc_time(text: Column) -> Column:
    """A time from ISO text with or without an offset, or from seconds since 1970; null if it is neither."""
    return F.coalesce(F.when(F.rlike(text, F.lit(r"^\d{9,11}$")), F.timestamp_seconds(text.try_cast("long"))), text.try_cast("timestamp"))


def decimal_odds(text: Column) -> Column:
    """Decimal odds from "2.5", "6/4" or American "+150" and "-200"; null at or below 1."""
    bare = F.trim(text)
    a, b = F.regexp_extract(bare, r"^(\d+)/(\d+)$", 1).try_cast("double"), F.regexp_extract(bare, r"^(\d+)/(\d+)$", 2).try_cast("double")
    american = F.regexp_extract(bare, r"^[+-]\d{3,}$", 0).try_cast("double")
    found = F.coalesce(1 + F.try_divide(a, b), F.when(american > 0, 1 + american / 100).when(american < 0, 1 + 100 / -american), bare.try_cast("double"))
    return F.when(found > 1, found)


def whitelisted(json: Column, keys: list[str]) -> Column:
    """A JSON object with these keys only, as text; keys that are missing stay missing."""
    return F.to_json(F.struct(*[F.get_json_object(json, f"$.{k}").alias(k) for k in keys]))


def redacted(value: Column, entitled: Column, mask: Column | None = None) -> Column:
    """The value for those entitled, else null or the mask."""
    return F.when(F.coalesce(entitled, F.lit(False)), value).otherwise(F.lit(None) if mask is None else mask)


def folded(name: Column) -> Column:
    """Lower case with common accented Latin letters as plain ones, everything else as one blank."""
    accented, plain = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžčćđřěůłńśźżąęğış", "aaaaaaceeeeiiiinoooooouuuuyyszccdreulnszzaegis"
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(name, F.lit(""))), accented, plain), "[^a-z0-9]+", " "))


def games(tape: Column) -> Column:
    """Counts of each side's points in a tape of S and R, A and D (points of the server and the returner) as a struct (server, returner, total)."""
    count = lambda letters: F.length(F.regexp_replace(F.coalesce(tape, F.lit("")), f"[^{letters}]", ""))
    return F.struct(count("SA").alias("server"), count("RD").alias("returner"), count("SARD").alias("total"))


def overround(odds: list[Column]) -> Column:
    """The margin in a book of decimal odds; null if any is missing."""
    total = F.lit(0.0)
    for o in odds:
        total = total + F.try_divide(F.lit(1.0), o)
    return total - 1


def elo_factor(played: Column, most: float = 32.0, least: float = 12.0, fall: float = 0.16) -> Column:
    """How far one match moves a rating: it falls with the logarithm of the matches played; below none counts as none."""
    return F.greatest(F.lit(least), F.least(F.lit(most), most / (1 + fall * F.ln(1 + F.greatest(played, F.lit(0))))))


def elo_update(own: Column, expected: Column, won: Column, played: Column, weight: Column | float = 1.0) -> Column:
    """A rating after one match of so much weight."""
    return own + elo_factor(played) * weight * (won.cast("double") - expected)


def pooled(own: Column, overall: Column, n: Column, strength: float = 8.0) -> Column:
    """A rating on a surface pulled towards the overall one: n / (n + strength)."""
    share = n / (n + strength)
    return share * own + (1 - share) * overall
