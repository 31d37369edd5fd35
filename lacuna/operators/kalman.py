"""Seasonal ARMA fill: (1,0,1)x(1,0,1,7) in state-space form, by a Kalman filter over many stations at once.

A station's days are one row of arrays (bounded by the calendar). A task filters the stations of its Arrow
batch side by side: states are (9 x lanes), covariances (9 x 9 x lanes), and a lane is a station with one point
of its simplex, so a step of the search costs one pass over the days for all stations and points. Missing
days are filled by the one-step-ahead prediction, days in order of date; where no likelihood can be had (no
reading after the first nine days), by the mean of the station, 0 without any reading."""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEASON = 7
STATES = SEASON + 2
#: Stations of a task: so many cost little more than one, since a step's time is that of its calls; more would wait for their slowest search.
STATIONS = 9
START, STEP = (0.5, 0.1, 0.3, 0.1), 0.2


def polynomials(params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (lanes x 9) of past values and of shocks, (1 - aB)(1 - AB^7) and (1 + bB)(1 + CB^7), of (lanes x 4) a, b, A, C."""
    a, b, sa, sb = np.asarray(params, float).T
    ar, shock = np.zeros((len(a), STATES)), np.zeros((len(a), STATES))
    ar[:, 0], ar[:, SEASON - 1], ar[:, SEASON] = a, sa, -a * sa
    shock[:, 0], shock[:, 1], shock[:, SEASON], shock[:, SEASON + 1] = 1.0, b, sb, b * sb
    return ar, shock


def _in_order(days: np.ndarray) -> np.ndarray:
    """Sums of the lanes, added day after day whatever the number of lanes."""
    return np.cumsum(days, 0)[-1] if len(days) else np.zeros(days.shape[1])


def filter_lanes(y: np.ndarray, params: np.ndarray, predictions: bool = False, gains: list | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Concentrated log-likelihoods of the lanes' series (days x lanes; NaN is missing) and one-step-ahead predictions. ``gains`` gets each day's gains."""
    ar, shock = (np.ascontiguousarray(x.T) for x in polynomials(params))
    lanes = ar.shape[1]
    noise = shock[:, None] * shock
    state, cov = np.zeros((STATES, lanes)), np.repeat((np.eye(STATES) * 1e6)[:, :, None], lanes, 2)
    known = ~np.isnan(y)
    whole = known.all(1)
    out = np.empty(y.shape) if predictions else None
    shocks, spreads = np.zeros(y.shape), np.ones(y.shape)
    moved, taken, next_state, left = np.empty_like(cov), np.empty_like(cov), np.empty_like(state), ar[:, None]
    with np.errstate(all="ignore"):
        for t in range(len(y)):
            expected = state[0]
            if out is not None:
                out[t] = expected
            row = cov[0].copy()
            f = row[0]
            gain = row / f
            v = y[t] - expected
            if not whole[t]:
                seen = known[t]
                gain[:, ~seen], v = 0.0, np.where(seen, v, 0.0)
            if gains is not None:
                gains.append(gain.T.copy())
            shocks[t], spreads[t] = v, f
            state = state + gain * v
            np.multiply(gain[:, None], row, out=taken)
            cov -= taken
            np.multiply(ar, state[0], out=next_state)
            next_state[:-1] += state[1:]
            state, next_state = next_state, state
            np.multiply(left, cov[0], out=moved)
            moved[:-1] += cov[1:]
            np.multiply(moved[:, :1], ar, out=cov)
            cov[:, :-1] += moved[:, 1:]
            cov += noise
        counted = slice(STATES, None)
        n = known[counted].sum(0)
        total, logs = (_in_order(x) for x in (shocks[counted] * shocks[counted] / spreads[counted], np.where(known[counted], np.log(spreads[counted]), 0.0)))
        found = -0.5 * (n * np.log(total / n) + logs)
    good = (n > 0) & (total > 0) & np.isfinite(found) & (np.abs(state[0]) < 1e12)
    return np.where(good, found, -np.inf), out


def search(y: np.ndarray, evaluations: int) -> np.ndarray:
    """The (stations x 4) parameters of greatest likelihood for series (days x stations): Nelder and Mead's simplex, all stations side by side.

    A station's search ends after ``evaluations`` (as one after the other would count them) or once its values are within 1e-8 of each other, relatively."""
    stations, size = y.shape[1], len(START)
    points = np.tile(np.array(START), (stations, size + 1, 1))
    points[:, 1:] += STEP * np.eye(size)

    def cost(open_: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """-likelihood of (stations x points x 4)."""
        k = asked.shape[1]
        return -filter_lanes(np.repeat(y[:, open_], k, 1), asked.reshape(-1, size))[0].reshape(-1, k)

    open_ = np.arange(stations)
    values = cost(open_, points)
    used = np.full(stations, size + 1)
    while True:
        order = np.argsort(values, 1, kind="stable")
        points, values = np.take_along_axis(points, order[:, :, None], 1), np.take_along_axis(values, order, 1)
        with np.errstate(invalid="ignore"):
            settled = ~(values[:, -1] - values[:, 0] > 1e-8 * np.abs(values[:, 0]))
        open_ = np.flatnonzero((used < evaluations) & ~settled)
        if not len(open_):
            return points[:, 0]
        p, v = points[open_], values[open_]
        centre, worst = p[:, :-1].mean(1), p[:, -1]
        tried = np.stack([centre + c * (worst - centre) for c in (-1.0, -2.0, 0.5)], 1)  # reflected, expanded, contracted
        found = cost(open_, tried)
        r, e, c = found.T
        better, poor = r < v[:, 0], r >= v[:, -2]
        expand, contract = better & (e < r), ~better & poor & (c < np.minimum(r, v[:, -1]))
        shrink = ~better & poor & ~contract & (r >= v[:, -1])
        which = np.where(expand, 1, np.where(contract, 2, 0))
        lane = np.arange(len(open_))
        new_p, new_v = tried[lane, which], found[lane, which]
        stay = ~shrink
        points[open_[stay], -1], values[open_[stay], -1] = new_p[stay], new_v[stay]
        used[open_] += 1 + (better | (poor & ~better))
        if shrink.any():
            own = open_[shrink]
            points[own, 1:] = points[own, :1] + 0.5 * (points[own, 1:] - points[own, :1])
            values[own, 1:] = cost(own, points[own, 1:])
            used[own] += size


def fill_lanes(y: np.ndarray, evaluations: int, params: tuple[float, ...] | None = None) -> np.ndarray:
    """Series (days x stations) without gaps."""
    known = ~np.isnan(y)
    mean = np.where(known, y, 0.0).sum(0) / np.maximum(known.sum(0), 1)
    best = np.tile(np.asarray(params, float), (y.shape[1], 1)) if params is not None else search(y, evaluations)
    likelihood, predicted = filter_lanes(y, best, True)
    usable = np.isfinite(predicted).all(0) & (np.isfinite(likelihood) if params is None else True)
    return np.where(known, y, np.where(usable, predicted, mean))


def filter_series(y: np.ndarray, params: np.ndarray) -> tuple[float, np.ndarray]:
    """Likelihood and predictions of one series."""
    likelihood, predicted = filter_lanes(np.asarray(y, float)[:, None], np.asarray(params, float)[None], True)
    return float(likelihood[0]), predicted[:, 0]


def fill_series(y: np.ndarray, evaluations: int) -> np.ndarray:
    return fill_lanes(np.asarray(y, float)[:, None], evaluations)[:, 0]


def kalman_fill(panel: DataFrame, evaluations: int = 200, params: tuple[float, ...] | None = None) -> DataFrame:
    """(station, date, dn, filled, was_missing); with ``params`` (a, b, A, C) nothing is searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), STATIONS):
                part = batch.slice(k, STATIONS)
                series = [np.array(x.as_py(), float) for x in part.column("y")]  # null is NaN
                y = np.full((max(map(len, series)), len(series)), np.nan)
                for j, own in enumerate(series):
                    y[: len(own), j] = own
                filled = fill_lanes(y, evaluations, params)
                yield pa.record_batch([part.column("station"), part.column("days"), part.column("y"), pa.array([filled[: len(own), j] for j, own in enumerate(series)], pa.list_(pa.float64()))], ["station", "days", "y", "filled"])

    day = F.struct("dn", "date", F.col("value").cast("double").alias("value"))
    series = panel.groupBy("station").agg(F.array_sort(F.collect_list(day)).alias("c"))  # days of a station
    series = series.select("station", F.transform("c", lambda x: F.struct(x["dn"].cast("int").alias("dn"), x["date"].alias("date"))).alias("days"), F.transform("c", lambda x: x["value"]).alias("y"))
    tasks = min(math.ceil(panel.select("station").distinct().count() / STATIONS) or 1, 20_000)
    filled = series.repartition(tasks).mapInArrow(run, "station string, days array<struct<dn: int, date: date>>, y array<double>, filled array<double>")
    cells = filled.select("station", F.explode(F.arrays_zip("days", "y", "filled")).alias("c"))
    return cells.select("station", F.col("c.days.date").alias("date"), F.col("c.days.dn").alias("dn"), F.col("c.filled").alias("filled"), F.col("c.y").isNull().alias("was_missing"))


def kalman_fill_outside(seed: DataFrame, panel: DataFrame, evaluations: int = 200) -> DataFrame:
    """The seed's days take part in the series; only the panel's days come back."""
    columns = ("station", "date", "dn", "value")
    filled = kalman_fill(seed.select(*columns).unionByName(panel.select(*columns)), evaluations)
    return filled.join(panel.select("station", "date"), ["station", "date"], "left_semi")
