"""Column arithmetic for rates, odds and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 97.5 % point of the normal distribution, the earth's mean radius in km.
Z, EARTH_KM = 1.959963984540054, 6371.0088


def wilson(wins: Column, n: Column) -> tuple[Column, Column]:
    """Both ends of the Wilson interval, within 0 and 1; null if n is 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = wins / n
    mid, half = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return F.greatest((mid - half) / (1 + Z * Z / n), F.when(n.isNotNull(), F.lit(0.0))), F.least((mid + half) / (1 + Z * Z / n), F.when(n.isNotNull(), F.lit(1.0)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def logit(p: Column, edge: float = 1e-6) -> Column:
    p = clamp(p, edge, 1 - edge)
    return F.ln(p / (1 - p))


def shrink(rate: Column, n: Column, baseline: Column, strength: float) -> Column:
    """A rate pulled towards its baseline by ``strength`` pseudo-observations."""
    return (rate * n + baseline * strength) / (n + strength)


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds - 1


def fair_pair(a: Column, b: Column) -> Column:
    """The first side's probability without the margin in decimal odds of both."""
    return (1 / a) / (1 / a + 1 / b)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def elo_expected(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def odd_digest(key: Column) -> Column:
    """Whether the 16th hex digit of a key's SHA-256 is odd: a fixed coin for each key."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 16, 1), 16, 10).cast("int") % 2 == 1
