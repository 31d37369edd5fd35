"""Scalar functions as expressions, without UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "clean_station_name", "parse_coordinate", "to_number", "day_number", "day_of_year_sin", "day_of_year_cos", "geodesic_km",
    "inverse_kernel", "exponential_kernel", "scrub", "is_temporal", "CORRECTIONS", "TEMPORAL_PREFIXES",
]

#: Spellings that differ between the files of stations and of contributors.
CORRECTIONS = {"parmanpur": "paramanpur", "bamnidih": "bamnidhi"}
#: Prefixes of columns that are calendar features and not stations.
TEMPORAL_PREFIXES = ("day_of_year_", "month_", "week_of_year_")
#: WGS-84.
_A, _F = 6378137.0, 1 / 298.257223563
_B = _A * (1 - _F)


def is_temporal(name: str) -> bool:
    return name.startswith(TEMPORAL_PREFIXES)


def clean_station_name(name: Column) -> Column:
    """Lower case without quotes and white space, spelling corrected. Null is the name ``none``."""
    bare = F.regexp_replace(F.lower(F.coalesce(name.cast("string"), F.lit("none"))), "['\"`]|\\s+", "")
    corrected = bare
    for wrong, right in CORRECTIONS.items():
        corrected = F.when(bare == wrong, right).otherwise(corrected)
    return corrected


def parse_coordinate(text: Column, is_latitude: bool = True, strict: bool = False) -> Column:
    """Decimal degrees of a number or of degrees, minutes, seconds with an optional hemisphere letter.

    With a letter the sign of the degrees doesn't count, only S (latitude) or W (longitude) is negative.
    Nothing numeric or out of bounds: null, or an error if ``strict``."""
    raw = text.cast("string")
    limit = 90 if is_latitude else 180
    spaced = F.regexp_replace(raw, "[o°'\"`]", " ")
    numbers = F.regexp_extract_all(spaced, F.lit(r"(-?\d+\.?\d*)"), 1)
    part = lambda k: F.coalesce(F.get(numbers, F.lit(k)).cast("double"), F.lit(0.0))
    letter = F.upper(F.regexp_extract(raw, "([NSEWnsew])", 1))
    size = F.abs(part(0)) + part(1) / 60 + part(2) / 3600
    negative = F.when(letter != "", letter == F.lit("S" if is_latitude else "W")).otherwise(part(0) < 0)
    value = F.when(F.size(numbers) > 0, F.when(negative, -size).otherwise(size))
    found = F.when(value.between(-limit, limit), value)
    if not strict:
        return found
    problem = F.raise_error(F.concat(F.lit("not a coordinate: "), F.coalesce(raw, F.lit("null"))))
    return F.when(found.isNotNull(), found).otherwise(problem.cast("double"))


def to_number(text: Column) -> Column:
    """A double, or null where the text is none or not a number."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def day_number(date: Column) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def _angle(date: Column) -> Column:
    return F.lit(2.0) * F.pi() * F.dayofyear(date) / F.lit(366.0)


def day_of_year_sin(date: Column) -> Column:
    return F.sin(_angle(date))


def day_of_year_cos(date: Column) -> Column:
    return F.cos(_angle(date))


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 50) -> Column:
    """Length of the shortest line on the WGS-84 ellipsoid; null for unknown places.

    Vincenty's inverse formula, and the azimuth's bisection for the pairs near antipodes for which it doesn't converge."""
    u1, u2 = F.atan(F.tan(F.radians(lat1)) * (1 - _F)), F.atan(F.tan(F.radians(lat2)) * (1 - _F))
    turn = F.pmod(F.radians(lon2) - F.radians(lon1), F.lit(2 * math.pi))
    gap = F.least(turn, 2 * math.pi - turn)

    def orbit(c: Column, lam: Column) -> dict[str, Column]:
        s = F.sqrt(F.pow(c["cu2"] * F.sin(lam), 2) + F.pow(c["cu1"] * c["su2"] - c["su1"] * c["cu2"] * F.cos(lam), 2))
        k = c["su1"] * c["su2"] + c["cu1"] * c["cu2"] * F.cos(lam)
        sin_a = F.when(s == 0, F.lit(0.0)).otherwise(c["cu1"] * c["cu2"] * F.sin(lam) / F.when(s != 0, s))
        cos2a = 1 - sin_a * sin_a
        mid = F.when(cos2a == 0, F.lit(0.0)).otherwise(k - 2 * c["su1"] * c["su2"] / F.when(cos2a != 0, cos2a))
        return {"s": s, "k": k, "sigma": F.atan2(s, k), "sin_a": sin_a, "cos2a": cos2a, "mid": mid}

    def step(c: Column, _: Column) -> Column:
        o = F.transform(F.array(F.struct(*[v.alias(k) for k, v in orbit(c, c["lam"]).items()])), lambda o: _next(c, o))
        return F.get(o, F.lit(0))

    def _next(c: Column, o: Column) -> Column:
        big = _F / 16 * o["cos2a"] * (4 + _F * (4 - 3 * o["cos2a"]))
        lam = c["gap"] + (1 - big) * _F * o["sin_a"] * (o["sigma"] + big * o["s"] * (o["mid"] + big * o["k"] * (-1 + 2 * o["mid"] * o["mid"])))
        return F.struct(*[c[k].alias(k) for k in ("su1", "cu1", "su2", "cu2", "gap")], lam.alias("lam"), F.abs(lam - c["lam"]).alias("moved"))

    def finish(c: Column) -> Column:
        def length(o: Column) -> Column:
            usq = o["cos2a"] * (_A * _A - _B * _B) / (_B * _B)
            a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
            b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
            m, s, k = o["mid"], o["s"], o["k"]
            turn = b * s * (m + b / 4 * (k * (-1 + 2 * m * m) - b / 6 * m * (-3 + 4 * s * s) * (-3 + 4 * m * m)))
            return _B * a * (o["sigma"] - turn) / 1000

        settled = (c["moved"] < 1e-11) & ~F.isnan(c["lam"]) & (F.abs(c["lam"]) <= math.pi)
        vincenty = F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in orbit(c, c["lam"]).items()])), length), F.lit(0))
        return F.when(settled, vincenty).otherwise(_antipodal_km(u1, u2, gap))

    fixed = F.struct(F.sin(u1).alias("su1"), F.cos(u1).alias("cu1"), F.sin(u2).alias("su2"), F.cos(u2).alias("cu2"), gap.alias("gap"), gap.alias("lam"), (gap * 0).alias("moved"))
    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), fixed, step, finish))


def _integral(of: Callable[[Column], Column], low: Column, high: Column) -> Column:
    """Gauss and Legendre's rule of 16 points; what is integrated here is far smoother."""
    nodes, weights = np.polynomial.legendre.leggauss(16)
    half, middle = (high - low) / 2, (high + low) / 2
    return half * sum((float(w) * of(middle + half * float(x)) for x, w in zip(nodes, weights)), F.lit(0.0))


def _antipodal_km(u1: Column, u2: Column, gap: Column) -> Column:
    """The geodesic between reduced latitudes, ``gap`` apart in longitude, by bisection of its first azimuth (Karney, 2013): the
    longitude it reaches grows with the azimuth once the place farther from the equator comes first and lies in the south."""
    first, second = F.when(F.abs(u1) >= F.abs(u2), u1).otherwise(u2), F.when(F.abs(u1) >= F.abs(u2), u2).otherwise(u1)
    second = F.when(first > 0, -second).otherwise(second)
    first = F.least(-F.abs(first), F.lit(-1e-300))  # on the equator, too, just south of it
    bend = (_A * _A - _B * _B) / (_B * _B)

    def line(c: Column, azimuth: Column) -> dict[str, Column]:
        sin_a0 = F.sin(azimuth) * c["cos1"]
        cos2 = F.sqrt(F.greatest(F.pow(F.cos(azimuth) * c["cos1"], 2) + (c["cos2"] * c["cos2"] - c["cos1"] * c["cos1"]), F.lit(0.0)))
        return {"sin_a0": sin_a0, "k2": bend * (1 - sin_a0 * sin_a0), "low": F.atan2(c["sin1"], F.cos(azimuth) * c["cos1"]), "high": F.atan2(c["sin2"], cos2)}

    def on(c: Column, azimuth: Column, then: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in line(c, azimuth).items()])), then), F.lit(0))

    def reached(o: Column) -> Column:
        omega = lambda sigma: F.atan2(o["sin_a0"] * F.sin(sigma), F.cos(sigma))
        lag = _integral(lambda s: (2 - _F) / (1 + (1 - _F) * F.sqrt(1 + o["k2"] * F.pow(F.sin(s), 2))), o["low"], o["high"])
        return omega(o["high"]) - omega(o["low"]) - _F * o["sin_a0"] * lag

    def halve(c: Column, _: Column) -> Column:
        middle = (c["from"] + c["to"]) / 2
        short = on(c, middle, reached) < c["gap"]
        return F.struct(*[c[k].alias(k) for k in ("sin1", "cos1", "sin2", "cos2", "gap")], F.when(short, middle).otherwise(c["from"]).alias("from"), F.when(short, c["to"]).otherwise(middle).alias("to"))

    length = lambda o: _B / 1000 * _integral(lambda s: F.sqrt(1 + o["k2"] * F.pow(F.sin(s), 2)), o["low"], o["high"])
    begun = F.struct(F.sin(first).alias("sin1"), F.cos(first).alias("cos1"), F.sin(second).alias("sin2"), F.cos(second).alias("cos2"), gap.alias("gap"), F.lit(0.0).alias("from"), F.lit(math.pi).alias("to"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), begun, halve, lambda c: on(c, (c["from"] + c["to"]) / 2, length))


def inverse_kernel(km: Column) -> Column:
    return 1 / (km + 1e-9)


def exponential_kernel(km: Column, rate: float = 0.1) -> Column:
    return F.exp(-rate * km)


def scrub(value: Column) -> Column:
    """0 for null, NaN and infinity."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))
