"""Comparison of fills on artificial gaps outside of a seed block."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Callable

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, fills, gaps, metrics
from ..operators import panel as panels
from ..operators.forest import ChainedForest, Fits, IterativeForest, Settings
from ..operators.kalman import kalman_fill_outside
from ..operators.knn import knn_fill
from ..sources.checkpoints import cut, forget

GAP_LENGTHS, PERCENT, SEED_YEARS = (3, 7, 30, 100), 10.0, 3
#: Pairs of gap length and method that run side by side.
PARALLEL = 36
#: name: function(seed, gapped panel outside of it, whole gapped panel, seed's ends, settings) to (station, date, filled)
Method = Callable[[DataFrame, DataFrame, DataFrame, tuple, Settings], DataFrame]


def _deterministic(name: str) -> Method:
    return lambda seed, part, whole, ends, s: fills.fill(part, name)


def _scaled(panel: DataFrame, stats: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(stats), "station").withColumn("value", (F.col("value") - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def _chained(seed: DataFrame, part: DataFrame, whole: DataFrame, ends: tuple, s: Settings) -> DataFrame:
    """On scaled values; a station without a reading in a block counts as its seed's mean there."""
    from ..operators.knn import scale_stats

    stats = cut(scale_stats(seed))

    def block(p: DataFrame) -> DataFrame:
        known = p.groupBy("station").agg(F.count("value").alias("n"))
        return _scaled(p, stats).join(F.broadcast(known), "station").withColumn("value", F.when(F.col("n") == 0, 0.0).otherwise(F.col("value"))).drop("n")

    own = replace(s, distances=None, connectivity=None, n_estimators=min(10, s.n_estimators), subset="all")
    filled = s.once("chained", lambda: ChainedForest(own).fit(block(seed))).transform(block(part))
    return filled.join(F.broadcast(stats), "station").withColumn("filled", F.col("filled") * F.col("scale") + F.col("mean")).drop("mean", "scale")


def _vanilla(seed: DataFrame, part: DataFrame, whole: DataFrame, ends: tuple, s: Settings) -> DataFrame:
    """A pass goes forward and backward; side by side there is no way back, so that a pass is two."""
    own = replace(s, distances=None, connectivity=None, max_iter=s.max_iter * (2 if s.update == "jacobi" else 1))
    return s.once("vanilla", lambda: IterativeForest(own).fit(seed)).transform(part)


METHODS: dict[str, Method] = {
    "forest_chaining": lambda seed, part, whole, ends, s: blocks.chaining(whole, *ends, SEED_YEARS, s),
    "forest_expanding": lambda seed, part, whole, ends, s: blocks.expanding(whole, *ends, SEED_YEARS, s),
    "forest_seed_only": lambda seed, part, whole, ends, s: blocks.seed_only(whole, *ends, s),
    "forest_vanilla": _vanilla,
    "forest_chained_equations": _chained,
    "knn_k5": lambda seed, part, whole, ends, s: knn_fill(seed, part, calendar=True),
    "kalman_sarima": lambda seed, part, whole, ends, s: kalman_fill_outside(seed, part),
    "linear_interpolation": _deterministic("linear_time"),
    "historical_mean": _deterministic("historical_mean"),
}


RESULT = "gap_scenario string, method string, n long, " + ", ".join(f"{m} double" for m in metrics.NAMES) + ", error string"


class Ledger:
    """Finished pairs of gap length and method in a shared folder, one small table each, by a hash of all that they depend on."""

    def __init__(self, spark: SparkSession, path: str, about: object):
        self.spark, self.path, self.about = spark, path.rstrip("/"), about

    def key(self, length: int, method: str) -> str:
        return hashlib.md5(repr((self.about, length, method)).encode()).hexdigest()

    def finished(self) -> dict[str, tuple]:
        """Rows by key; a table that was begun and never committed has none."""
        try:
            rows = self.spark.read.schema(f"key string, {RESULT}").parquet(f"{self.path}/entry-*").collect()  # a row a pair
        except AnalysisException:  # nothing was written yet
            return {}
        return {r["key"]: tuple(r)[1:] for r in rows}

    def add(self, key: str, row: tuple) -> None:
        self.spark.createDataFrame([(key, *row)], f"key string, {RESULT}").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/entry-{key}")


def _about(whole: DataFrame, ends: tuple, settings: Settings, *more: object) -> tuple:
    """What a result depends on: readings, stations' tables, settings."""
    plain = sorted((k, v) for k, v in vars(settings).items() if k not in ("distances", "connectivity", "weights", "fits", "parallelism", "cache"))
    tables = [whole.select("station", "date", "value"), *[t for t in (settings.distances, settings.connectivity) if t is not None]]
    sums = [tuple(t.agg(F.count("*"), F.sum(F.xxhash64(*t.columns) % 1_000_000_007)).first()) for t in tables]
    return (sums, tuple(map(str, ends)), plain, *more)


def evaluate(panel: DataFrame, start, end, settings: Settings | None = None, gap_lengths=GAP_LENGTHS, percent: float = PERCENT, years: int = SEED_YEARS, methods: dict[str, Method] | None = None, seed: int = gaps.SEED, plot: Callable[[DataFrame, str, int], object] | None = None, ledger: str | None = None, parallel: int = PARALLEL) -> DataFrame:
    """(gap_scenario, method, n, the metrics, error), a row a pair; a method that fails has a row of nulls and its error.

    The seed block is found once, and forests that learn from it alone are fitted once for all gap lengths. Gaps are
    drawn in the days outside of it; each method's metrics are one small aggregate. ``parallel`` pairs run side by side,
    each method in a scheduler pool of its own (a session with ``spark.scheduler.mode=FAIR`` shares its tasks among
    them). What a run has finished is in the folder ``ledger``, if given; another run of equal inputs and settings goes on
    from there, and only tries failed pairs again. ``plot`` gets each method's cells (station, date, true_value, is_gap,
    filled), its name and the gap length."""
    settings = replace(settings or Settings(initialization_method="historical_mean"), fits=Fits())
    spark = panel.sparkSession
    whole = cut(panels.between(panel, start, end).select("station", "date", "dn", "value"))
    ends = panels.find_best_window(whole, start, end, blocks.window_days(years))
    block, outside = panels.between(whole, *ends), panels.outside(whole, *ends)
    asked = methods or METHODS
    book = Ledger(spark, ledger, _about(whole, ends, settings, percent, seed, years)) if ledger else None
    done = book.finished() if book else {}
    held = Fits()

    def gapped(length: int) -> DataFrame:
        return held.once(str(length), lambda: cut(gaps.apply_plan(outside, gaps.contiguous_gaps_by_percent(outside, length, percent, seed))))

    def run(length: int, name: str) -> tuple:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        error = None
        try:
            cells = gapped(length)
            part = cells.select("station", "date", "dn", "value")
            truth = cells.where("is_gap AND true_value IS NOT NULL").select("station", "date", "true_value")
            filled = asked[name](block, part, block.unionByName(part), ends, settings).select("station", "date", "filled")
            if plot:
                filled = cut(filled)
            found = metrics.evaluate(truth.join(filled, ["station", "date"])).first().asDict()
            if plot:
                plot(cells.select("station", "date", "true_value", "is_gap").join(filled, ["station", "date"]), name, length)
                forget(filled)
        except Exception as e:  # one method's failure leaves the others
            found, error = {"n": None} | dict.fromkeys(metrics.NAMES), f"{type(e).__name__}: {e}"[:500]
        row = (f"{length}-day_gap", name, found["n"], *[found[m] for m in metrics.NAMES], error)
        if book and error is None:
            book.add(book.key(length, name), row)
        return row

    pairs = [(length, name) for name in asked for length in gap_lengths]
    rows = [done[book.key(*p)] for p in pairs if book and book.key(*p) in done]
    with ThreadPoolExecutor(1 if plot else max(parallel, 1)) as pool:  # plots are drawn one after the other
        rows += list(pool.map(inheritable_thread_target(spark)(lambda p: run(*p)), [p for p in pairs if not (book and book.key(*p) in done)]))
    for length in gap_lengths:
        if (table := held.get(str(length))) is not None:
            forget(table)
    return spark.createDataFrame(rows, RESULT).orderBy("gap_scenario", "method")


def evaluate_gap_kinds(panel: DataFrame, contiguous=(7, 14, 30, 60, 180), points=(30, 60, 90, 180), method: str = "historical_mean", seed: int = gaps.SEED) -> DataFrame:
    """Metrics of one fill over both kinds of gaps."""
    cells = None
    for kind, sizes in (("contiguous", contiguous), ("single_point", points)):
        for size in sizes:
            plan = gaps.contiguous_gaps(panel, size, seed=seed) if kind == "contiguous" else gaps.point_gaps(panel, size, seed)
            part = gaps.apply_plan(panel, plan).withColumn("gap_type", F.lit(kind)).withColumn("gap_length", F.lit(size))
            cells = part if cells is None else cells.unionByName(part)
    filled = fills.fill(cells, method, keys=("gap_type", "gap_length", "station"))
    return metrics.evaluate(filled.where("is_gap"), ("gap_type", "gap_length"))
