"""Artificial gaps.

Plans order candidates by an MD5 of (seed, station, place), so that every engine draws the same gaps; no
state is shared between stations. :func:`numpy_gaps` and :func:`numpy_points` draw what NumPy's legacy generator
does, one generator over all stations in order: numbers of rows go to one task, which draws; nothing else does.
A plan has a row a gap or point; :func:`apply_plan` masks a panel with it.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def positions(panel: DataFrame) -> DataFrame:
    """``panel`` with the place of each row in its station's series, and the series' length."""
    own = Window.partitionBy("station")
    return panel.withColumn("pos", F.row_number().over(own.orderBy("dn")) - 1).withColumn("n_rows", F.count("*").over(own))


def _order(station: Column, place: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), station, F.lit("|"), place.cast("string")))


def point_gaps(panel: DataFrame, days_a_year: float, seed: int = SEED) -> DataFrame:
    """(station, pos): single days, ``days_a_year`` in 365, one at least; all of a series if that is as long."""
    ranked = positions(panel).withColumn("rank", F.row_number().over(Window.partitionBy("station").orderBy(_order(F.col("station"), F.col("pos"), seed), "pos")))
    wanted = F.floor(F.col("n_rows") * F.lit(days_a_year / 365.0))
    wanted = F.when((wanted == 0) & F.lit(days_a_year > 0), 1).otherwise(wanted)
    return ranked.where(F.col("rank") <= wanted).select("station", "pos")


def _greedy(starts: Column, length: int, count: Column) -> Column:
    """The first ``count`` starts that don't overlap those before."""
    nothing = F.array().cast("array<int>")
    return F.aggregate(starts, nothing, lambda got, s: F.when((F.size(got) < count) & ~F.exists(got, lambda g: F.abs(g - s) < length), F.concat(got, F.array(s))).otherwise(got))


def _contiguous(panel: DataFrame, length: int, count: Column, seed: int) -> DataFrame:
    sizes = panel.groupBy("station").agg(F.count("*").cast("int").alias("n_rows"))
    if length <= 0:
        return sizes.select("station", F.lit(0).alias("start"), F.lit(0).alias("stop")).where("false")
    starts = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n_rows") - length), lambda s: F.struct(_order(F.col("station"), s, seed).alias("h"), s.alias("s")))), lambda x: x["s"])
    chosen = F.when(F.col("n_rows") <= length, F.array(F.lit(0))).otherwise(_greedy(starts, length, count))
    return sizes.select("station", "n_rows", F.explode(chosen).alias("start")).select("station", "start", F.least(F.col("start") + length, F.col("n_rows")).alias("stop"))


def contiguous_gaps(panel: DataFrame, length: int, count: int = 5, seed: int = SEED) -> DataFrame:
    """(station, start, stop): at most ``count`` gaps that don't overlap; the whole series if it isn't longer than one."""
    return _contiguous(panel, length, F.least(F.lit(count), F.floor(F.col("n_rows") / length).cast("int")), seed)


def contiguous_gaps_by_percent(panel: DataFrame, length: int, percent: float, seed: int = SEED) -> DataFrame:
    """As many gaps as make up ``percent`` of the series, one at least if that is over 0."""
    count = F.floor(F.col("n_rows") * F.lit(percent / 100.0) / length).cast("int")
    return _contiguous(panel, length, F.when((count == 0) & F.lit(percent > 0), 1).otherwise(count), seed)


def apply_plan(panel: DataFrame, plan: DataFrame) -> DataFrame:
    """``panel`` with true_value, is_gap, and null where the plan says so. A gap is spread over its days: an equi-join, no range join."""
    days = plan.select("station", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")) if "start" in plan.columns else plan
    marked = positions(panel).join(days.withColumn("is_gap", F.lit(True)), ["station", "pos"], "left")
    is_gap = F.coalesce("is_gap", F.lit(False))
    return marked.select(*[c for c in panel.columns if c != "value"], F.col("value").alias("true_value"), is_gap.alias("is_gap"), F.when(~is_gap, F.col("value")).alias("value"))


def legacy_starts(n_rows: dict[str, int], length: int, percent: float | None = None, count: int = 5, seed: int = SEED) -> list[tuple[str, int, int]]:
    """(station, start, stop) as drawn by NumPy's legacy generator, shared by the stations in the given order."""
    return _legacy(np.random.RandomState(seed), list(n_rows.items()), length, percent, count)


def _legacy(rng: np.random.RandomState, rows: list[tuple[str, int]], length: int, percent: float | None, count: int) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for station, n in rows:
        if length <= 0:
            continue
        if length >= n:
            out.append((station, 0, n))
            continue
        wanted = min(count, n // length) if percent is None else max(math.floor(n * (percent / 100.0) / length), int(percent > 0))
        starts = np.arange(n - length + 1)
        rng.shuffle(starts)
        free, taken = np.ones(n, bool), 0
        for s in starts.tolist():
            if taken == wanted:
                break
            if free[s : s + length].all():
                free[s : s + length] = False
                out.append((station, s, s + length))
                taken += 1
    return out


def _drawn(panel: DataFrame, draw, schema: str) -> DataFrame:
    """``draw`` of (station, n_rows) in order of the stations' names, in one task."""
    sizes = panel.groupBy("station").agg(F.count("*").cast("int").alias("n_rows"))  # a row a station
    return sizes.repartition(1).sortWithinPartitions("station").mapInArrow(draw, schema)


def numpy_gaps(panel: DataFrame, lengths: tuple[int, ...], percent: float | None = None, count: int = 5, seed: int = SEED) -> DataFrame:
    """(gap_length, station, start, stop) as NumPy's legacy generator draws them by shuffling all starts of each station, lengths one after the other.

    ``percent`` of a series, or at most ``count`` gaps that don't overlap; the whole series if it isn't longer than a gap."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["station"], r["n_rows"]) for b in batches for r in b.to_pylist()]
        rng = np.random.RandomState(seed)
        for length in lengths:
            found = _legacy(rng, rows, length, percent, count)
            columns = list(zip(*found)) or [()] * 3
            yield pa.record_batch([pa.array([length] * len(found), pa.int32()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["gap_length", "station", "start", "stop"])

    return _drawn(panel, draw, "gap_length int, station string, start int, stop int")


def numpy_points(panel: DataFrame, days_a_year: tuple[float, ...], seed: int = SEED) -> DataFrame:
    """(days_a_year, station, pos) as NumPy's legacy generator chooses days without replacement, one number a year after the other."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["station"], r["n_rows"]) for b in batches for r in b.to_pylist()]
        rng = np.random.RandomState(seed)
        for rate in days_a_year:
            for station, n in rows:
                wanted = int(n * (rate / 365.0)) or int(rate > 0)
                places = np.arange(n) if wanted >= n else rng.choice(n, wanted, replace=False)
                yield pa.record_batch([pa.array([float(rate)] * len(places)), pa.array([station] * len(places), pa.string()), pa.array(places.astype(np.int32))], ["days_a_year", "station", "pos"])

    return _drawn(panel, draw, "days_a_year double, station string, pos int")
