"""Iterative forests: weighted, with a chosen start, vanilla, and chained equations.

A panel is turned to rows of arrays once: a row a day, a place in its arrays a station. A pass hands each
station its days' features, grows the station's forest and predicts its missing days. With
``update="jacobi"`` all stations of a pass do so in one job, each in a task of its own, from what the pass
before left; with ``"gauss_seidel"`` one station follows the other and sees the predictions before it. Plans
don't grow with stations, trees or passes: predictions and trees are written to the shared folder.

Trees are tables, too (a row a station, arrays of nodes), and are joined to a station's days to replay
them. Settings are ``Param``s of the estimators, so that ``copy``, ``setParams`` and tuning work, and
estimators and models can be saved and loaded, alone or in a ``Pipeline``.
"""

from __future__ import annotations

import json
import math
import threading
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.base import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import day_of_year_cos, day_of_year_sin
from ..sources.checkpoints import cut, forget
from . import fills, spatial, trees

CALENDAR = ("day_of_year_sin", "day_of_year_cos")
#: Stations of a task that replays trees: a station's take less time than the task's start.
REPLAYED = 4
#: Trees of all stations that a task holds to replay all passes over its days; if there are more, a pass is a job of its own.
REPLAY_BYTES = 256 << 20
#: Days of such a task, by day number.
REPLAY_DAYS = 366
#: Partitions for each group that is a task's work, so that hardly any task gets several while others get none.
SPREAD = 4
_STEP = f"k int, date date, p double, old double, {trees.SCHEMA}"
_NAMES = [x.split()[0] for x in _STEP.split(", ")]
_PASSES = "k int, date date, old double, p array<double>"


@dataclass
class Settings:
    #: tables of (target, predictor, km) and (target, predictor, w); without either: no weights
    distances: DataFrame | None = None
    connectivity: DataFrame | None = None
    max_iter: int = 10
    n_estimators: int = 100
    random_state: int = 42
    distance_weighting_type: str = "inverse"
    decay_rate: float = 0.1
    #: 0: until nodes are pure
    max_depth: int = 10
    #: 0: a split may lie between any two values
    max_bins: int = 64
    calendar: bool = True
    initialization_method: str = "column_mean"
    tolerance: float = 1e-6
    subset: str = "sqrt"
    bootstrap: bool = True
    update: str = "gauss_seidel"
    #: tasks of a pass for each core of the session, as long as there are stations
    parallelism: int = 2
    #: folder of fitted seed models, which equal fits of other runs reuse
    cache: str | None = None
    #: stations' weights by target
    weights: dict[str, dict[str, float]] | None = field(default=None, repr=False)
    #: models of equal fits, where a run keeps them
    fits: "Fits | None" = field(default=None, repr=False)

    def once(self, name: str, fit):
        """``fit()``, or what an equal fit of this run gave."""
        return fit() if self.fits is None else self.fits.once(name, fit)

    @property
    def vanilla(self) -> bool:
        return self.distances is None or self.connectivity is None

    def weights_of(self, target: str, predictors: list[str]) -> list[float]:
        if self.vanilla:
            return [1.0] * len(predictors)
        if self.weights is None:
            rows = spatial.weights(self.distances, self.connectivity, self.distance_weighting_type, self.decay_rate).collect()  # a row a pair of stations
            found: dict[str, dict[str, float]] = {}
            for r in rows:
                found.setdefault(r["target"], {})[r["predictor"]] = r["weight"]
            self.weights = found
        own = self.weights.get(target, {})
        return [own.get(p, 0.0) for p in predictors]


class Fits:
    """Fits by name, each made once even if several threads ask for it."""

    def __init__(self) -> None:
        self._lock, self._locks, self._found = threading.Lock(), {}, {}

    def once(self, name: str, fit):
        with self._lock:
            own = self._locks.setdefault(name, threading.Lock())
        with own:
            if name not in self._found:
                self._found[name] = fit()
            return self._found[name]

    def get(self, name: str):
        """What was made, or None."""
        return self._found.get(name)


class Wide:
    """Days as rows: date, dn, calendar features, v (current values by station), m (was missing)."""

    def __init__(self, panel: DataFrame, stations: list[str], start: DataFrame | None = None, means: dict[str, float | None] | None = None):
        self.stations, self.n = stations, len(stations)
        spark = panel.sparkSession
        columns = [pa.array(range(self.n), pa.int32()), pa.array(stations, pa.string()), pa.array([(means or {}).get(s) for s in stations], pa.float64())]
        index = F.broadcast(spark.createDataFrame(pa.table(columns, ["k", "station", "mean"])))  # a row a station
        known = panel.select("station", "date", F.col("value").alias("o")).join(index, "station")
        if start is not None:
            known = known.join(start.select("station", "date", F.col("filled").alias("i")), ["station", "date"], "left")
        else:
            known = known.withColumn("i", F.lit(None).cast("double"))
        days = panel.select("date", "dn").distinct()
        grid = days.select("date", "dn", F.explode(F.array_repeat(F.lit(0), self.n)).alias("z")) if not self.n else days.select("date", "dn", F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))).alias("k")).join(index.select("k", "mean"), "k")
        if not self.n:
            self.df = cut(grid.select("date", "dn", *[F.lit(0.0).alias(c) for c in CALENDAR], F.array().cast("array<double>").alias("v"), F.array().cast("array<boolean>").alias("m")))
            return
        cells = grid.join(known.select("k", "date", "o", "i"), ["k", "date"], "left")
        held = F.array_sort(F.collect_list(F.struct("k", F.coalesce("o", "i", "mean").alias("v"), F.col("o").isNull().alias("m"))))
        rows = cells.groupBy("date", "dn").agg(held.alias("c"))
        self.df = cut(rows.select("date", "dn", day_of_year_sin(F.col("date")).alias(CALENDAR[0]), day_of_year_cos(F.col("date")).alias(CALENDAR[1]), F.transform("c", lambda x: x["v"]).alias("v"), F.transform("c", lambda x: x["m"]).alias("m")))

    def missing(self) -> list[int]:
        """Missing days of each station, in their order."""
        counts = self.df.select(F.posexplode("m").alias("k", "m")).groupBy("k").agg(F.count_if("m").alias("n")).collect()  # a row a station
        found = {r["k"]: r["n"] for r in counts}
        return [found.get(k, 0) for k in range(self.n)]

    def long(self) -> DataFrame:
        names = self.df.sparkSession.createDataFrame(pa.table([pa.array(range(self.n), pa.int32()), pa.array(self.stations, pa.string())], ["k", "station"]))
        cells = self.df.select("date", "dn", F.posexplode(F.arrays_zip("v", "m")).alias("k", "c"))
        return cells.join(F.broadcast(names), "k").select("station", "date", "dn", F.col("c.v").alias("filled"), F.col("c.m").alias("was_missing"))


def overlaid(days: DataFrame, predicted: DataFrame | None) -> DataFrame:
    """``days`` with the predictions (k, date, p), one a cell, in the place of missing values."""
    if predicted is None:
        return days
    by_day = predicted.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias("new"))  # stations of a day
    value = F.transform("v", lambda v, k: F.when(F.col("m")[k], F.coalesce(F.col("new")[k], v)).otherwise(v))
    return days.join(by_day, "date", "left").withColumn("v", value).drop("new")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def _rows(k: int, predicted: pa.Table, p: np.ndarray, forest: dict | None) -> pa.Table:
    """Predictions of a station, and its trees in a row without a date."""
    schema = pa.schema([("k", pa.int32()), ("date", pa.date32()), ("p", pa.float64()), ("old", pa.float64()), ("trees", pa.int32()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("child", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])
    n = len(predicted)
    empty = [pa.nulls(n, schema.field(c).type) for c in _NAMES[4:]]
    found = pa.table([pa.array(np.full(n, k), pa.int32()), predicted["date"], pa.array(p, pa.float64()), predicted["y"], *empty], schema=schema)
    if forest is None:
        return found
    own = {"k": k, "trees": forest["trees"]} | {c: np.asarray(forest[c]).tolist() for c in trees.COLUMNS}
    return pa.concat_tables([found, pa.Table.from_pylist([own], schema=schema)])


def _fit_station(options: dict):
    """Grow the forest of a station's days and predict its missing ones."""

    def run(table: pa.Table) -> pa.Table:
        k = table["k"][0].as_py()
        table = table.sort_by("date")
        x, y = _matrix(table["x"]), table["y"].to_numpy(zero_copy_only=False)
        missing = table["missing"].to_numpy(zero_copy_only=False).astype(bool)
        learn = ~np.isnan(y) & (~missing if options["known_only"] else True)
        if not learn.any() or not x.shape[1]:
            return _rows(k, table.slice(0, 0), np.zeros(0), None)
        width = x.shape[1]
        features = {"sqrt": max(int(np.sqrt(width)), 1), "all": width, "onethird": max(width // 3, 1)}[options["subset"]]
        forest = trees.grow(x[learn], y[learn], options["n_estimators"], features, (options["random_state"], k), options["max_depth"], options["max_bins"], options["bootstrap"])
        asked = table.filter(pa.array(missing))
        return _rows(k, asked, trees.predict(forest, x[missing]), forest)

    return run


def _replay_station(key: tuple, days: pa.Table, models: pa.Table) -> pa.Table:
    """Predict a station's missing days by its stored trees."""
    k = key[0].as_py()
    if not len(models) or not len(days):
        return _rows(k, days.slice(0, 0), np.zeros(0), None)
    forest = models.slice(0, 1).to_pylist()[0]
    return _rows(k, days, trees.predict(forest, _matrix(days["x"])), None)


def _replay_days(passes: int, calendar: bool):
    """All passes side by side over a block of days: a missing value's predictions pass by pass, up to the first pass that moved nothing in its day.

    A day's values follow from its own alone, so that no pass waits for other days."""

    def run(days: pa.Table, models: pa.Table) -> pa.Table:
        schema = pa.schema([("k", pa.int32()), ("date", pa.date32()), ("old", pa.float64()), ("p", pa.list_(pa.float64()))])
        if not len(days) or not len(models):
            return schema.empty_table()
        value, missing = _matrix(days["v"]), _matrix(days["m"]).astype(bool)
        around = np.stack([days[c].to_numpy() for c in CALENDAR], 1) if calendar else np.zeros((len(days), 0))
        stations, columns = models["k"].to_numpy(), {c: models[c].combine_chunks() for c in trees.COLUMNS}
        forests = [{"trees": n.as_py()} | {c: columns[c][i].values.to_numpy() for c in trees.COLUMNS} for i, n in enumerate(models["trees"])]
        factors = [np.array(f) for f in models["f"].to_pylist()]
        found, lengths, moving = np.empty((passes, *value.shape)), np.zeros(len(days), int), np.arange(len(days))
        now = value
        for turn in range(passes):
            before, now = now, now.copy()
            for k, forest, f in zip(stations, forests, factors):
                rows = moving[missing[moving, k]]
                if len(rows):
                    others = np.delete(np.where(np.isnan(before[rows]), 0.0, before[rows]) * f, k, 1) if len(f) else np.zeros((len(rows), 0))
                    now[rows, k] = trees.predict(forest, np.concatenate([others, around[rows]], 1))
            found[turn], lengths[moving] = now, turn + 1
            a, b = now[moving], before[moving]
            moving = moving[~((a == b) | (np.isnan(a) & np.isnan(b))).all(1)]
            if not len(moving):
                break
        day, place = np.nonzero(missing[:, stations])
        k, n = stations[place], lengths[day]
        flat = found[:, day, k].T[np.arange(passes) < n[:, None]]
        own = [pa.array(k, pa.int32()), days["date"].take(pa.array(day)), pa.array(value[day, k], pa.float64(), from_pandas=True), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat, pa.float64()))]
        return pa.table(own, schema=schema)

    return run


class IterativeForest(Estimator, MLWritable, MLReadable):
    """Start: the training means. A forest learns from known cells only; a pass runs forward and backward; converged by the L2 norm."""

    backward, known_only, norm = True, True, "l2"

    max_iter = Param(Params._dummy(), "max_iter", "passes at most", TypeConverters.toInt)
    n_estimators = Param(Params._dummy(), "n_estimators", "trees of a forest", TypeConverters.toInt)
    random_state = Param(Params._dummy(), "random_state", "seed of the forests", TypeConverters.toInt)
    max_depth = Param(Params._dummy(), "max_depth", "depth of a tree at most, 0 without a limit", TypeConverters.toInt)
    max_bins = Param(Params._dummy(), "max_bins", "bins of a feature, 0 for all values", TypeConverters.toInt)
    subset = Param(Params._dummy(), "subset", "features a split looks at", TypeConverters.toString)
    bootstrap = Param(Params._dummy(), "bootstrap", "whether a tree draws its days", TypeConverters.toBoolean)
    distance_weighting_type = Param(Params._dummy(), "distance_weighting_type", "inverse or exponential", TypeConverters.toString)
    decay_rate = Param(Params._dummy(), "decay_rate", "of exponential weights", TypeConverters.toFloat)
    initialization_method = Param(Params._dummy(), "initialization_method", "fill to start from", TypeConverters.toString)
    calendar = Param(Params._dummy(), "calendar", "whether the day of the year is a feature", TypeConverters.toBoolean)
    tolerance = Param(Params._dummy(), "tolerance", "change that ends the passes", TypeConverters.toFloat)
    update = Param(Params._dummy(), "update", "gauss_seidel or jacobi", TypeConverters.toString)
    parallelism = Param(Params._dummy(), "parallelism", "tasks of a pass for each core", TypeConverters.toInt)

    def __init__(self, settings: Settings | None = None, **options):
        super().__init__()
        self._settings = settings or Settings(**options)
        self._set(**{p.name: getattr(self._settings, p.name) for p in self.params})

    def setParams(self, **options) -> "IterativeForest":
        return self._set(**options)

    @property
    def settings(self) -> Settings:
        now = {p.name: self.getOrDefault(p) for p in self.params}
        if any(getattr(self._settings, k) != v for k, v in now.items()):
            self._settings = replace(self._settings, weights=None, **now)
        return self._settings

    # -- what kinds of forests differ in

    def start(self, panel: DataFrame) -> DataFrame | None:
        return None

    def factors(self, k: int, stations: list[str]) -> list[float] | None:
        """What the stations' readings are multiplied by (own: left out), none for the calendar alone; None if nothing but zeros could come of them."""
        s = self.settings
        others = [j for j in range(len(stations)) if j != k]
        weights = dict(zip(others, s.weights_of(stations[k], [stations[j] for j in others])))
        if not s.calendar and not any(weights.values()):
            return None
        return [float(weights.get(j, 0.0)) for j in range(len(stations))]

    def order(self, missing: list[int]) -> list[int]:
        return list(range(len(missing)))

    # -- the algorithm

    def _factors(self, spark: SparkSession, names: list[str], stations: list[int]) -> DataFrame:
        """(k, f) of the stations that have features, ``f`` of all stations."""
        factors = [(k, f) for k in stations if (f := self.factors(k, names)) is not None]
        columns = [pa.array([k for k, _ in factors], pa.int32()), pa.array([f for _, f in factors], pa.list_(pa.float64()))]
        return spark.createDataFrame(pa.table(columns, ["k", "f"]))  # of known size, by which the join is chosen

    def _cells(self, days: DataFrame, factors: DataFrame, stations: list[int]) -> DataFrame:
        """(k, date, x, y, missing) of the stations' days: features, current value. The plan's size doesn't depend on the number of trees or passes."""
        each = days.select("date", *CALENDAR, "v", "m", F.explode(F.array(*[F.lit(k) for k in stations]).cast("array<int>")).alias("k"))
        weighted = F.filter(F.zip_with("v", "f", lambda v, f: F.coalesce(v, F.lit(0.0)) * f), lambda v, j: j != F.col("k"))
        others = F.when(F.size("f") > 0, weighted).otherwise(F.array().cast("array<double>"))
        x = F.concat(others, F.array(*CALENDAR)) if self.settings.calendar else others
        return each.join(F.broadcast(factors), "k").select("k", "date", x.alias("x"), F.col("v")[F.col("k")].alias("y"), F.col("m")[F.col("k")].alias("missing"))

    def _step(self, days: DataFrame, factors: DataFrame, stations: list[int], models: DataFrame | None) -> DataFrame:
        """Trees (where there are no ``models``) and predictions of the stations, a task a station; written."""
        s = self.settings
        cells = self._cells(days, factors, stations)
        tasks = max(min(len(stations), s.parallelism * days.sparkSession.sparkContext.defaultParallelism), 1)  # a task's bytes are few, its work isn't
        if models is None:
            options = {c: getattr(s, c) for c in ("n_estimators", "subset", "random_state", "max_depth", "max_bins", "bootstrap")} | {"known_only": self.known_only}
            return cut(cells.repartition(SPREAD * tasks, "k").groupBy("k").applyInArrow(_fit_station(options), _STEP))
        tasks = min(tasks, math.ceil(len(stations) / REPLAYED) or 1)
        own = models.select("k", "trees", *trees.COLUMNS).where(F.col("k").isin(stations)).repartition(tasks, "k").groupBy("k")
        asked = cells.where("missing").repartition(tasks, "k").groupBy("k")
        return cut(asked.cogroup(own).applyInArrow(_replay_station, _STEP))

    def _replay(self, wide: Wide, models: DataFrame) -> None:
        """All passes of stored trees in one job, a task a block of days; ends with the pass of all days that moves nothing."""
        s = self.settings
        block = F.floor(F.col("dn") / REPLAY_DAYS).cast("int")
        asked = wide.df.where(F.exists("m", lambda m: m)).withColumn("b", block)
        blocks = [r["b"] for r in asked.select("b").distinct().collect()]  # bounded by the calendar
        if not blocks:
            return
        tasks = SPREAD * len(blocks)
        factors = self._factors(wide.df.sparkSession, wide.stations, list(range(wide.n)))
        own = models.select("k", "trees", *trees.COLUMNS).join(F.broadcast(factors), "k").withColumn("b", F.explode(F.array(*[F.lit(b) for b in blocks])))
        days = asked.select("b", "date", *CALENDAR, "v", "m").repartition(tasks, "b").groupBy("b")
        found = cut(days.cogroup(own.repartition(tasks, "b").groupBy("b")).applyInArrow(_replay_days(s.max_iter, s.calendar), _PASSES))
        moved = found.select(F.posexplode(F.transform("p", lambda p, i: F.abs(p - F.when(i == 0, F.col("old")).otherwise(F.col("p")[F.greatest(i - 1, F.lit(0))])))).alias("turn", "m"))
        how = F.sqrt(F.sum(F.col("m") * F.col("m"))) if self.norm == "l2" else F.max("m")
        change = {r["turn"]: r["c"] or 0.0 for r in moved.groupBy("turn").agg(how.alias("c")).collect()}  # a row a pass
        last = next((t for t in range(s.max_iter) if change.get(t, 0.0) < s.tolerance), s.max_iter - 1)
        wide.df = overlaid(wide.df, found.select("k", "date", F.element_at("p", F.least(F.lit(last + 1), F.size("p"))).alias("p")))

    def _change(self, steps: list[DataFrame], before: DataFrame) -> float:
        """How far the last predictions of a pass are from the values before it."""
        old = before.select("date", F.posexplode("v").alias("k", "before"))
        moved = _union(steps).where("p IS NOT NULL").join(old, ["k", "date"]).select(F.abs(F.col("p") - F.col("before")).alias("m"))
        how = F.sqrt(F.sum(F.col("m") * F.col("m"))) if self.norm == "l2" else F.max("m")
        return moved.agg(F.coalesce(how, F.lit(0.0))).first()[0]

    def _rounds(self, wide: Wide, missing: list[int], models: DataFrame | None) -> DataFrame | None:
        """Passes until nothing moves: trees are grown anew, or ``models`` are replayed for stations that miss something. The last trees; written."""
        s = self.settings
        order = [k for k in self.order(missing) if models is None or missing[k]]
        factors = self._factors(wide.df.sparkSession, wide.stations, order)
        grown: dict[int, DataFrame] = {}
        for turn in range(s.max_iter):
            jacobi = s.update == "jacobi"
            groups = [order] if jacobi else [[k] for k in order + (order[::-1] if self.backward else [])]
            last: dict[int, DataFrame] = {}
            for group in groups:
                seen = list({id(t): t for t in last.values()}.values())
                days = overlaid(wide.df, _union(seen).where("p IS NOT NULL") if seen else None)
                step = self._step(days, factors, group, models)
                for k in group:
                    if (old := last.get(k)) is not None and not jacobi:
                        forget(old)
                    last[k] = step
            steps = list({id(t): t for t in last.values()}.values())
            for t in {id(t): t for t in grown.values()}.values():
                forget(t)
            grown, new = last, overlaid(wide.df, _union(steps).where("p IS NOT NULL"))
            if turn + 1 == s.max_iter:  # nobody reads the values after a last fit; a last fill is put together where it is read
                if models is not None:
                    wide.df, grown = new, {}
                break
            before, wide.df = wide.df, cut(new)
            done = self._change(steps, before) < s.tolerance
            forget(before)
            if done:
                break
        steps = list({id(t): t for t in grown.values()}.values())
        found = cut(_union(steps).where("date IS NULL").select("k", "trees", *trees.COLUMNS)) if models is None and steps else None
        for t in steps:
            forget(t)
        return found

    def _fit(self, panel: DataFrame) -> "IterativeForestModel":
        rows = panel.groupBy("station").agg(F.avg("value").alias("m")).orderBy("station").collect()  # a row a station
        stations, means = [r["station"] for r in rows], {r["station"]: r["m"] for r in rows}
        wide = Wide(panel, stations, self.start(panel), means)
        if any(missing := wide.missing()):
            models = self._rounds(wide, missing, None)
        else:
            step = self._step(wide.df, self._factors(wide.df.sparkSession, stations, list(range(wide.n))), list(range(wide.n)), None)
            models = cut(step.where("date IS NULL").select("k", "trees", *trees.COLUMNS))
            forget(step)
        forget(wide.df)
        return IterativeForestModel(self, stations, means, models)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def _union(tables: list[DataFrame]) -> DataFrame:
    """Written tables of one schema, read together."""
    paths = [t._lacuna_cut for t in tables]
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths)


class IterativeForestModel(Model, MLWritable, MLReadable):
    """Fills panels by replaying the last forests: (station, date, dn, filled, was_missing). ``models``: (k, trees, feature, threshold, child, value)."""

    def __init__(self, parent: IterativeForest, stations: list[str], means: dict[str, float | None], models: DataFrame | None):
        super().__init__()
        self.forest, self.stations, self.means, self.models = parent, stations, means, models
        self._bytes: int | None = None

    def _held_at_once(self) -> bool:
        """Whether a task can hold the trees of all stations: counted once a model."""
        if self._bytes is None:
            self._bytes = 24 * (self.models.agg(F.sum(F.size("feature"))).first()[0] or 0)  # two ints and two doubles a node
        return self._bytes <= REPLAY_BYTES

    def _transform(self, panel: DataFrame) -> DataFrame:
        forest = self.forest
        wide = Wide(panel, self.stations, forest.start(panel), self.means)
        if self.models is not None and wide.n:
            jacobi = forest.settings.update == "jacobi"
            missing = [1] * wide.n if jacobi else wide.missing()  # one job asks for all stations anyway
            if jacobi and forest.settings.max_iter > 1 and self._held_at_once():
                forest._replay(wide, self.models)
            elif any(missing):
                forest._rounds(wide, missing, self.models)
        return wide.long()

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class InitialisedForest(IterativeForest):
    """Starts from a deterministic fill (of whatever is fitted or transformed), learns from all rows, runs forward; converged by the largest change."""

    backward, known_only, norm = False, False, "max"

    def start(self, panel: DataFrame) -> DataFrame:
        return fills.initialise(panel, self.settings.initialization_method)

    def factors(self, k: int, stations: list[str]) -> list[float] | None:
        if self.settings.vanilla:  # without weights only the calendar counts
            return [] if self.settings.calendar else None
        return super().factors(k, stations)


class ChainedForest(IterativeForest):
    """Chained equations: small forests on all features, in the order of missing cells, learning from known cells."""

    backward, known_only, norm = False, True, "max"

    def __init__(self, settings: Settings | None = None, **options):
        super().__init__(settings, **({"n_estimators": 10, "subset": "all"} | options if settings is None else {}))

    def order(self, missing: list[int]) -> list[int]:
        return sorted(range(len(missing)), key=lambda k: (missing[k], k))


KINDS = {c.__name__: c for c in (IterativeForest, InitialisedForest, ChainedForest)}


class _Writer(MLWriter):
    """``metadata`` as MLlib reads it, the tables of distances and connectivity, and a model's stations and trees."""

    def __init__(self, instance: IterativeForest | IterativeForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        own = self.instance
        forest = own.forest if isinstance(own, IterativeForestModel) else own
        kind = type(own)
        about = {"class": f"{kind.__module__}.{kind.__name__}", "uid": own.uid, "timestamp": 0, "sparkVersion": spark.version, "paramMap": {}, "defaultParamMap": {}}
        about |= {"forest": type(forest).__name__, "settings": {p.name: forest.getOrDefault(p) for p in forest.params}, "tables": [c for c in ("distances", "connectivity") if getattr(forest.settings, c) is not None]}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        for c in about["tables"]:
            getattr(forest.settings, c).write.parquet(f"{path}/{c}")
        if forest is not own:
            rows = [(k, s, own.means.get(s)) for k, s in enumerate(own.stations)]
            spark.createDataFrame(rows, "k int, station string, mean double").coalesce(1).write.parquet(f"{path}/stations")
            if own.models is not None:
                own.models.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str):
        spark = self.sparkSession
        about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        tables = {c: spark.read.parquet(f"{path}/{c}") for c in about["tables"]}
        forest = KINDS[about["forest"]](Settings(**tables, **about["settings"]))
        if about["class"].rpartition(".")[2] != IterativeForestModel.__name__:
            forest._resetUid(about["uid"])
            return forest
        rows = spark.read.parquet(f"{path}/stations").orderBy("k").collect()  # a row a station
        try:
            models = spark.read.parquet(f"{path}/trees")
        except AnalysisException:  # there was nothing to learn from
            models = None
        model = IterativeForestModel(forest, [r["station"] for r in rows], {r["station"]: r["mean"] for r in rows}, models)
        model._resetUid(about["uid"])
        return model


def unfitted_fill(panel: DataFrame) -> DataFrame:
    """What a forest that was never fitted gives: means of the panel itself; null for a station without readings."""
    mean = panel.groupBy("station").agg(F.avg("value").alias("__mean"))
    joined = panel.join(F.broadcast(mean), "station")
    return joined.select("station", "date", "dn", F.coalesce("value", "__mean").alias("filled"), F.col("value").isNull().alias("was_missing"))
