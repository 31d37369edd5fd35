"""Scaling statistics and nearest-neighbour fill: donors are days of a seed block.

Days are rows of what their stations read. Blocks of asked days meet blocks of donor days, both of ``BLOCK``
days of the calendar, and three masked matrix products give all distances of two blocks; the best of each
block are compared again from differences, and merged. What is exchanged are days (as often as there are
blocks on the other side) and the ``k`` best a block of each missing reading, never pairs of days."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import with_calendar

NEIGHBOURS = 5
#: Days of a block.
BLOCK = 512
#: Above the rounding errors of the matrix products; distances so near to the k-th best are compared again.
MARGIN = 1e-6
DIGITS = 8


def scale_stats(seed: DataFrame) -> DataFrame:
    """(station, mean, scale) of the seed with its gaps filled by the mean: population deviation, 1 where that is 0; mean 0 without readings."""
    filled = seed.withColumn("x", F.coalesce("value", F.avg("value").over(Window.partitionBy("station")), F.lit(0.0)))
    stats = filled.groupBy("station").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
    return stats.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))


def scaled(panel: DataFrame, stats: DataFrame, everything_missing: bool = True) -> DataFrame:
    """``panel`` with z; with ``everything_missing`` a station without any reading in it counts as its seed mean (z = 0)."""
    joined = panel.join(F.broadcast(stats), "station")  # a row a station
    z = (F.col("value") - F.col("mean")) / F.col("scale")
    if everything_missing:
        z = F.when(F.count("value").over(Window.partitionBy("station")) == 0, (F.coalesce("value", "mean") - F.col("mean")) / F.col("scale")).otherwise(z)
    return joined.withColumn("z", z)


def _dense(days: pa.Table, width: int) -> np.ndarray:
    """Days as rows of readings; NaN is missing."""
    out = np.full((len(days), width), np.nan)
    lists = days["c"].combine_chunks()
    row = np.repeat(np.arange(len(days)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    out[row, flat.field("k").to_numpy()] = flat.field("z").to_numpy()
    return out


def _nearest(width: int, stations: int, k: int):
    """The ``k`` nearest donors of a block for each missing reading of a block of asked days."""

    def run(asked: pa.Table, donors: pa.Table) -> pa.Table:
        a, b = _dense(asked, width), _dense(donors, width)
        a_dn, b_dn = asked["dn"].to_numpy(), donors["donor"].to_numpy()
        a_has, b_has = ~np.isnan(a), ~np.isnan(b)
        a0, b0 = np.where(a_has, a, 0.0), np.where(b_has, b, 0.0)
        common = a_has.astype(float) @ b_has.T.astype(float)
        squares = (a0 * a0) @ b_has.T.astype(float) + a_has.astype(float) @ (b0 * b0).T - 2.0 * (a0 @ b0.T)
        with np.errstate(all="ignore"):
            near = np.where(common > 0, np.sqrt(np.maximum(squares, 0.0) * (width / common)), np.inf)
        found: list[tuple] = []
        short = asked["short"].to_pylist()
        for s in range(stations):
            rows, held = np.array([r for r, x in enumerate(short) if s in x], int), np.flatnonzero(b_has[:, s])
            if not len(rows) or not len(held):
                continue
            own = near[np.ix_(rows, held)]
            limit = np.partition(own, min(k, len(held)) - 1, 1)[:, min(k, len(held)) - 1] + MARGIN
            for r, line, most in zip(rows, own, limit):
                at = held[(line <= most) & np.isfinite(line)]
                both = a_has[r] & b_has[at]
                exact = np.sqrt(width / both.sum(1) * (np.where(both, a0[r] - b0[at], 0.0) ** 2).sum(1))
                exact = np.round(exact, DIGITS)
                for j in np.lexsort((b_dn[at], exact))[:k]:
                    found.append((s, int(a_dn[r]), float(exact[j]), int(b_dn[at[j]]), float(b[at[j], s])))
        columns = list(zip(*found)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64()))], ["k", "dn", "distance", "donor", "z"])

    return run


def _days(cells: DataFrame, index: DataFrame, panel: DataFrame, scale_by: DataFrame | None, stations: int) -> DataFrame:
    """(dn, c: readings (k, z), short: stations without one) of the days of ``cells`` (station, dn, z); with ``scale_by`` two scaled calendar columns more."""
    own = cells.join(F.broadcast(index), "station").groupBy("dn").agg(F.collect_list(F.when(F.col("z").isNotNull(), F.struct("k", "z"))).alias("c"), F.collect_list(F.when(F.col("z").isNull(), F.col("k"))).alias("short"))  # stations of a day
    if scale_by is None:
        return own
    names = ("day_of_year_sin", "day_of_year_cos")
    days = with_calendar(panel.select("date", "dn").distinct()).join(own, "dn").crossJoin(F.broadcast(scale_by))  # one row
    scale = lambda n: F.when(F.col(f"{n}_scale") > 0, F.col(f"{n}_scale")).otherwise(1.0)
    more = F.array(*[F.struct(F.lit(stations + j).alias("k"), ((F.col(n) - F.col(f"{n}_mean")) / scale(n)).alias("z")) for j, n in enumerate(names)])
    return days.select("dn", F.concat("c", more).alias("c"), "short")


def knn_fill(seed: DataFrame, panel: DataFrame, k: int = NEIGHBOURS, calendar: bool = False) -> DataFrame:
    """``panel`` with ``filled``: the mean of the k nearest seed days that have the station, else the seed's mean.

    Distance: root of the summed squares over common stations, scaled up by stations / common ones; ties by date.
    With ``calendar`` the two scaled calendar columns count as stations that every day has."""
    stats = scale_stats(seed)
    names = [r["station"] for r in stats.select("station").orderBy("station").collect()]  # a row a station
    if not names:
        return panel.select("*", F.col("value").isNull().alias("was_missing"), F.col("value").cast("double").alias("filled"))
    index = seed.sparkSession.createDataFrame(pa.table([pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string())], ["k", "station"]))
    width, scale_by = len(names), None
    if calendar:
        width += 2
        days = with_calendar(seed.select("date", "dn").distinct())
        scale_by = days.agg(*[f(n).alias(f"{n}_{what}") for n in ("day_of_year_sin", "day_of_year_cos") for what, f in (("mean", F.avg), ("scale", F.stddev_pop))])
    donors = _days(scaled(seed, stats), index, seed, scale_by, len(names)).select(F.col("dn").alias("donor"), F.col("c").alias("c"))
    asked = _days(scaled(panel, stats), index, panel, scale_by, len(names)).where(F.size("short") > 0)
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    ends = lambda p: p.agg(F.min(block("dn")), F.max(block("dn"))).first()
    (i0, i1), (j0, j1) = ends(panel), ends(seed)
    if i0 is None or j0 is None:
        i0 = i1 = j0 = j1 = 0
    left = asked.withColumn("i", block("dn")).withColumn("j", F.explode(F.sequence(F.lit(j0), F.lit(j1))))
    right = donors.withColumn("j", block("donor")).withColumn("i", F.explode(F.sequence(F.lit(i0), F.lit(i1))))
    tasks = min(4 * (i1 - i0 + 1) * (j1 - j0 + 1), 20_000)
    near = left.repartition(tasks, "i", "j").groupBy("i", "j").cogroup(right.repartition(tasks, "i", "j").groupBy("i", "j")).applyInArrow(_nearest(width, len(names), k), "k int, dn int, distance double, donor int, z double")
    best = near.groupBy("k", "dn").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "donor", "z"))), 1, k).alias("best"))  # k of each block of donors
    mean = F.aggregate("best", F.lit(0.0), lambda t, x: t + x["z"]) / F.size("best")
    found = best.join(F.broadcast(index), "k").select("station", "dn", mean.alias("near_z"))
    z = F.coalesce("z", "near_z", F.lit(0.0))
    joined = scaled(panel, stats).join(found, ["station", "dn"], "left")
    return joined.select(*panel.columns, F.col("value").isNull().alias("was_missing"), F.coalesce("value", z * F.col("scale") + F.col("mean")).alias("filled"))
