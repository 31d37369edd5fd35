"""Completeness of panels, window search, slices."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import day_number, day_of_year_cos, day_of_year_sin


def to_long(wide: DataFrame, stations: list[str]) -> DataFrame:
    """Columns to rows; NaN becomes null."""
    kept = wide.select("date", *[F.col(f"`{s}`").cast("double").alias(s) for s in stations])
    long = kept.unpivot(["date"], [F.col(f"`{s}`") for s in stations], "station", "value")
    return long.select("station", "date", day_number(F.col("date")).alias("dn"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def to_wide(panel: DataFrame, stations: list[str], value: str = "value") -> DataFrame:
    """Rows to columns, with the calendar features."""
    wide = panel.groupBy("date").pivot("station", stations).agg(F.first(value, True))
    return with_calendar(wide)


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumn("day_of_year_sin", day_of_year_sin(F.col("date"))).withColumn("day_of_year_cos", day_of_year_cos(F.col("date")))


def row_completeness(panel: DataFrame) -> DataFrame:
    """Readings a date."""
    return panel.groupBy("date", "dn").agg(F.count("value").alias("n_readings"))


def null_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("station").agg(F.count_if(F.col("value").isNull()).alias("n_missing"), F.count("*").alias("n_rows"))


def year_completeness(panel: DataFrame, years: int = 1, min_percent: float = 0.0) -> DataFrame:
    """Share of readings in each run of ``years`` whole years, in percent."""
    by_year = panel.groupBy(F.year("date").alias("year")).agg(F.count("value").alias("n"), F.count("*").alias("cells"))
    run = Window.orderBy("year").rangeBetween(0, years - 1)  # a row a year
    share = 100.0 * F.sum("n").over(run) / F.sum("cells").over(run)
    whole = by_year.select(F.col("year").alias("first_year"), (F.col("year") + years - 1).alias("last_year"), share.alias("percent"), F.count("*").over(run).alias("there"))
    return whole.where((F.col("there") == years) & (F.col("percent") >= min_percent)).drop("there")


def between(panel: DataFrame, start, end) -> DataFrame:
    """Both ends included."""
    return panel.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def outside(panel: DataFrame, start, end) -> DataFrame:
    return panel.where(~F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


#: Days whose counts are summed together.
BLOCK = 256


def running_counts(panel: DataFrame) -> DataFrame:
    """(date, dn, before, until): readings of all days before a date, and with it; as ``days_before`` and ``days_until`` the days themselves.

    Two levels: sums within blocks of ``BLOCK`` days, a task a block, and the sums of the blocks before, a number a block."""
    daily = row_completeness(panel).withColumn("block", F.floor(F.col("dn") / BLOCK).cast("int"))
    totals = F.array_sort(F.collect_list(F.struct("block", "n", "days")))  # a block each
    earlier = lambda c: F.aggregate(F.filter("all", lambda x: x["block"] < c["block"]), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("days")), lambda t, x: F.struct((t["n"] + x["n"]).alias("n"), (t["days"] + x["days"]).alias("days")))
    blocks = daily.groupBy("block").agg(F.sum("n_readings").alias("n"), F.count("*").alias("days")).agg(totals.alias("all"))
    begun = blocks.select("all", F.explode("all").alias("c")).select(F.col("c.block").alias("block"), earlier(F.col("c")).alias("begun"))
    own = Window.partitionBy("block").orderBy("dn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = daily.withColumn("n", F.sum("n_readings").over(own)).withColumn("days", F.count("*").over(own)).join(begun, "block")
    until, days = F.col("n") + F.col("begun.n"), F.col("days") + F.col("begun.days")
    return summed.select("date", "dn", (until - F.col("n_readings")).alias("before"), until.alias("until"), (days - 1).alias("days_before"), days.alias("days_until"))


def windows(panel: DataFrame, days: int) -> DataFrame:
    """Score of the window of ``days`` days that ends at each date; only windows without an absent date.

    The score is a difference of two running counts, which the window's first and last day meet by an equi-join."""
    counts = running_counts(panel)
    first = counts.select(F.col("date").alias("start_date"), (F.col("dn") + (days - 1)).alias("last_dn"), "before", "days_before")
    last = counts.select(F.col("date").alias("end_date"), F.col("dn").alias("last_dn"), "until", "days_until")
    return first.join(last, "last_dn").where(F.col("days_until") - F.col("days_before") >= days).select("start_date", "end_date", (F.col("until") - F.col("before")).alias("score"))


def best_window(panel: DataFrame, days: int) -> DataFrame:
    """The window of most readings; the earliest of equals. No row without a whole window."""
    return windows(panel, days).orderBy(F.desc("score"), "end_date").limit(1)


def find_best_window(panel: DataFrame, start, end, days: int) -> tuple[datetime.date, datetime.date]:
    part = between(panel, start, end)
    found = best_window(part, days).first()
    if found is None:
        raise ValueError(f"no data from {start} to {end}" if part.isEmpty() else f"no whole window of {days} days")
    return found["start_date"], found["end_date"]
