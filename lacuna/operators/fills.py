"""Deterministic fills. Every one adds a column to the panel and reads only readings, never filled values.

``keys`` name the series (station; or scenario and station). A series has a row a day, null if missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEASON_DAYS, MIN_YEARS = 15, 2
KEYS = ("station",)


def series_mean(keys=KEYS, value: str = "value") -> Column:
    """Mean reading of the series; 0 without any."""
    return F.coalesce(F.avg(value).over(Window.partitionBy(*keys)), F.lit(0.0))


def column_mean(keys=KEYS, value: str = "value") -> Column:
    return F.coalesce(F.col(value), series_mean(keys, value))


def historical_mean(keys=KEYS, value: str = "value", date: str = "date", min_years: int = MIN_YEARS) -> Column:
    """Mean of the same day of the year in earlier years if there are ``min_years`` readings, else the series' mean."""
    earlier = Window.partitionBy(*keys, F.dayofyear(date)).orderBy(F.year(date)).rangeBetween(Window.unboundedPreceding, -1)
    past = F.when(F.count(value).over(earlier) >= min_years, F.avg(value).over(earlier))
    return F.coalesce(F.col(value), past, series_mean(keys, value))


def seasonal_mean(keys=KEYS, value: str = "value", dn: str = "dn", days: int = SEASON_DAYS) -> Column:
    """Mean of the readings within ``days`` on either side, else the series' mean."""
    near = Window.partitionBy(*keys).orderBy(dn).rangeBetween(-days, days)
    return F.coalesce(F.col(value), F.avg(value).over(near), series_mean(keys, value))


def linear_time(keys=KEYS, value: str = "value", dn: str = "dn") -> Column:
    """On the line, by days, between the neighbouring readings; at the ends the nearest. Null without any reading."""
    up = Window.partitionBy(*keys).orderBy(dn).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc(dn)).rowsBetween(Window.unboundedPreceding, 0)  # growing frames only: the other kind is read anew for each row
    reading = F.when(F.col(value).isNotNull(), F.struct(F.col(dn).alias("d"), F.col(value).alias("v")))
    left, right = F.last(reading, True).over(up), F.last(reading, True).over(down)
    before, after, d0, d1 = left["v"], right["v"], left["d"], right["d"]
    between = before + (after - before) * (F.col(dn) - d0) / F.when(d1 > d0, d1 - d0)
    return F.coalesce(F.col(value), between, before, after)


METHODS = {"column_mean": column_mean, "historical_mean": historical_mean, "seasonal_mean": seasonal_mean, "linear_time": linear_time}
#: Ways to start the iterative forests from.
INITIAL = ("column_mean", "historical_mean", "seasonal_mean")


def fill(panel: DataFrame, method: str, keys=KEYS, out: str = "filled", **options) -> DataFrame:
    """``panel`` with the filled values and ``was_missing``."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return panel.withColumn("was_missing", F.col("value").isNull()).withColumn(out, METHODS[method](keys, **options))


def initialise(panel: DataFrame, method: str = "column_mean", keys=KEYS, min_years: int = MIN_YEARS) -> DataFrame:
    """No null remains: a series without readings becomes 0."""
    if method not in INITIAL:
        raise ValueError(f"unknown initialisation: {method}")
    return fill(panel, method, keys, **({"min_years": min_years} if method == "historical_mean" else {}))
